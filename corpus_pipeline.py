"""Corpus pipeline: the stages that turn raw ``documents`` into token digests.

Every stage works on all that its predecessor kept, and all but the last return the columns
of ``documents``:

1. language ID drops documents in which no language is found (no text or no letters);
2. SimHash near-dedup keeps the document with the smallest doc_id of every group;
3. suffix-array dedup cuts the bytes that an earlier document also holds out of each text
   (``n_chars`` follows; a character that lost some of its bytes goes with them; a document
   of which nothing is left goes);
4. benchmark decontamination drops contaminated documents;
5. byte-level BPE encodes what is left and decodes it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterbook.llm import bpe, decontam, langid, simhash, suffix_dedup
from meterbook.llm.common import table, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs, shingle=3, max_bits=3)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE encoding and decoding", encode_stage),
]

#: SQL has neither the hash of the fingerprints nor the merge queue of the encoder; the tests
#: hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs

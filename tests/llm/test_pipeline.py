import re

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from brute import AWKWARD, DOCUMENTS, PASSAGE, contamination, fingerprint, groups, repeats, sha

from meterbook.llm import bpe

LONG = " ".join(f"benchmark{k}" for k in range(30))


def prose(k, n=80):
    return " ".join(f"{chr(97 + (k * 7 + j * 3) % 26)}{chr(97 + (k * k + j) % 26)}{chr(97 + j % 26)}{'aeiou'[(k + j) % 5]}" for j in range(n))


def rows():
    texts = [prose(k) for k in range(12)] + [prose(0), prose(1) + " extra", "Intro of " + PASSAGE + " " + prose(30), prose(31) + PASSAGE, LONG + " " + prose(32, 20), prose(33, 900) + " " + LONG, *AWKWARD]
    return [(k, t, "en" if t else None, "s", None if t is None else len(t)) for k, t in enumerate(texts)]


def brute(docs, items):
    kept = {i: t for i, t in docs if any(c.isalpha() for c in t or "")}
    ids = sorted(kept)
    root = groups([fingerprint(kept[i]) for i in ids])
    kept = {i: kept[i] for k, i in enumerate(ids) if root[k] == k}
    cut = repeats([(i, kept[i].encode()) for i in sorted(kept)])
    kept = {i: data.decode("utf-8", "ignore") for i, (_, data) in cut.items()}
    kept = {i: t for i, t in kept.items() if t}
    out = {}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for i, t in kept.items():
        n_words, hit, _ = contamination(t, items)
        if not (hit and 20 * len(hit) >= n_words):
            tokens = encoding.encode_ordinary(t)
            out[i] = (i, len(tokens), sha(" ".join(map(str, tokens))), sha(t))
    return sorted(out.values())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows(), DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, LONG), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_run_equals_brute_force(spark, folder):
    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    assert got == brute([r[:2] for r in rows()], [(1, LONG)])


def test_stages_return_documents(spark, folder):
    assert [re.sub(" .*", "", name) for name, _ in corpus_pipeline.STAGES] == ["language", "SimHash", "suffix-array", "benchmark", "byte-level"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_null_and_repeated_doc_ids(spark, folder, tmp_path):
    texts = [(None, prose(40)), (None, prose(41)), (3, prose(42)), (3, prose(42)), (3, prose(43)), (4, prose(42)), (None, prose(43))]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [r[0] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == [3, 3, None, None]

"""A content-addressed WARC archive.

An archive is a folder with two Parquet tables. ``payloads`` stores the bytes of each
different payload of at least ``SMALL`` bytes once, under its SHA-256. ``records`` has the
exact header bytes of every record and, for payloads under ``SMALL``, those bytes themselves.
Of the records with one stored payload that with the smallest page_id is the ``response``;
the others are ``revisit`` records that refer to it. Reading joins headers and payloads back
to the original records, byte for byte.

The digest is verified both ways: writing stops if two payloads with one SHA-256 differ in
length or in a second hash, reading stops if a payload does not have the digest in its header.

Payload bytes stay where they are scanned unless their digest occurs more than once: only
(digest, page_id, length) are grouped, and the digests with copies are joined back, which
Spark broadcasts if they are few and otherwise splits where one digest is hot.

Null html is an empty payload. Repeated page_ids each get a record; those that repeat the
smallest page_id of a payload are responses too. A null url has no WARC-Target-URI; line
breaks in a url are percent-encoded. Null page_ids count as larger than all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterbook.llm.common import scratch, written

#: Payloads with fewer bytes are kept with their record and never revisited.
SMALL = 100
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LAST = (1 << 63) - 1


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _header(page_id: Column, url: Column, digest: Column, size: Column, first: Column) -> Column:
    """The header block of a record; ``first`` is the page it revisits, or null."""
    revisits = first.isNotNull()
    safe = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisits, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(page_id)),
        _line("WARC-Date", F.lit(DATE)),
        F.coalesce(_line("WARC-Target-URI", safe), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(revisits, F.concat(_line("WARC-Profile", F.lit(_PROFILE)), _line("WARC-Refers-To", _urn(first)))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisits, F.lit(0).cast("long")).otherwise(size).cast("string")),
        F.lit("\r\n"),
    ).cast("binary")


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Archive ``pages`` under ``folder``."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    large = rows.filter(F.col("size") >= SMALL)
    seen = large.groupBy("digest").agg(
        F.count("*").alias("times"),
        F.min(F.coalesce("page_id", F.lit(_LAST))).alias("first"),
        (F.min("size") == F.max("size")).alias("one_size"),
        (F.min(F.xxhash64("payload")) == F.max(F.xxhash64("payload"))).alias("one_hash"),
    )
    verified = F.when(F.col("one_size") & F.col("one_hash"), F.col("first")).otherwise(F.raise_error(F.concat(F.lit("different payloads have the digest "), F.col("digest"))))
    # written, so that the planner knows their size before it moves any payload
    copies = written(seen.filter("times > 1").select("digest", verified.alias("first")), "warc-copies")

    own = F.coalesce("page_id", F.lit(_LAST))
    marked = large.select("page_id", "payload", "digest").join(copies, "digest", "left")
    single = marked.filter("first is null").select("digest", "payload")
    smallest = marked.filter(own == F.col("first")).select("digest", "payload").dropDuplicates(["digest"])
    single.unionByName(smallest).write.option("compression", "zstd").parquet(f"{folder}/payloads")

    headed = large.select("page_id", "url", "digest", "size").join(copies, "digest", "left").withColumn("payload", F.lit(None).cast("binary"))
    small = rows.filter(F.col("size") < SMALL).withColumn("first", F.lit(None).cast("long"))
    refers = F.when(own != F.col("first"), F.col("first"))
    records = headed.unionByName(small.select(*headed.columns))
    header = _header(F.col("page_id"), F.col("url"), F.col("digest"), F.col("size"), refers)
    stored = F.when(refers.isNull() & F.col("payload").isNull(), F.col("digest"))
    records.select(header.alias("header"), F.col("payload").alias("inline"), stored.alias("stored")).write.option("compression", "zstd").parquet(f"{folder}/records")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The original records of an archive: ``header`` and ``record``, the whole record's bytes."""
    heads = spark.read.schema("header binary, inline binary, stored string").parquet(f"{folder}/records")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads").withColumnRenamed("digest", "stored")
    end = F.lit(b"\r\n\r\n")
    full = heads.filter("stored is not null").join(payloads, "stored", "left")
    missing = F.raise_error(F.concat(F.lit("no payload "), F.col("stored"))).cast("binary")
    full = full.select("header", F.concat("header", F.coalesce("payload", missing), end).alias("record"))
    bare = heads.filter("stored is null").select("header", F.concat("header", F.coalesce("inline", F.lit(b"")), end).alias("record"))
    return full.unionByName(bare)


def _field(name: str, pattern: str = "[^\r\n]*") -> Column:
    found = F.regexp_extract(F.col("header").cast("string"), f"\r\n{name}: ({pattern})\r\n", 1)
    return F.when(found != "", found)


def parsed(found: DataFrame) -> DataFrame:
    """Of each record: page_id, type, digest, refers_to, url and payload, with the digest of a
    response verified against its payload's bytes."""
    length = _field("Content-Length").cast("int")
    payload = F.substring(F.col("record"), F.octet_length("header") + 1, length)
    whole = F.octet_length("record") == F.octet_length("header") + length + 4
    fields = found.select(
        _field("WARC-Record-ID", "<urn:page:-?[0-9]*>").alias("urn"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Payload-Digest", "sha256:[0-9a-f]{64}").alias("named"),
        _field("WARC-Refers-To", "<urn:page:-?[0-9]*>").alias("refers"),
        _field("WARC-Target-URI").alias("url"),
        payload.alias("payload"),
        whole.alias("whole"),
    )

    def number(urn: Column) -> Column:
        digits = F.regexp_extract(urn, "-?[0-9]+", 0)
        return F.when(digits != "", digits).cast("long")

    named = F.substring("named", 8, 64)
    digest = F.when(F.col("record_type") == "revisit", named).otherwise(F.sha2("payload", 256))
    checked = F.when(F.col("whole") & (digest == named), digest).otherwise(F.raise_error(F.concat(F.lit("wrong payload for "), F.col("urn"))))
    return fields.select(number(F.col("urn")).alias("page_id"), "record_type", checked.alias("payload_digest"), number(F.col("refers")).alias("refers_to"), "url", "payload")


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of an archive: page_id, ``payload_bytes`` and ``payload_digest`` of
    the full payload (a revisit's from the response that it refers to), ``record_type`` and
    ``refers_to``."""
    found = parsed(records(spark, folder))
    sized = found.withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload", "url")
    responses = sized.filter("record_type = 'response'")
    known = responses.filter(F.col("payload_bytes") >= SMALL).groupBy("payload_digest").agg(F.max("payload_bytes").alias("full"), F.min("page_id").alias("holder"))
    revisits = sized.filter("record_type = 'revisit'").join(known, "payload_digest", "left")
    agree = F.col("refers_to").eqNullSafe(F.col("holder"))
    full = F.when(agree, F.col("full")).otherwise(F.raise_error(F.concat(F.lit("a revisit of another response: "), F.col("payload_digest"))).cast("long"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(columns).unionByName(revisits.withColumn("payload_bytes", full).select(columns))


def digests(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a fresh archive and read it back."""
    folder = scratch(pages.sparkSession, "warc")
    write(pages, folder)
    return catalog(pages.sparkSession, folder)

"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

The canonical form of a URL drops scheme, fragment, ``www.``, default ports, a trailing slash
and tracking parameters, lower-cases the host and sorts the other parameters. The listed URLs
are hashed into a blocked Bloom filter: one 64-byte block a URL, ``BITS`` bits in it. Spark
builds it, eight words a block (an aggregation with ``bit_or``, combined before the shuffle);
its size has a fixed bound (``MAX_BLOCKS``) at any length of the list, so it is broadcast.
Only URLs whose bits are all set go on to an exact join with the list, which removes the
false positives; with a list beyond the filter's comfort more URLs go on, and the result
stays the same.

A rule is (host, path, verdict): it fits a URL whose host is the rule's or a subdomain of it
and whose path starts with the rule's. The longest fitting rule decides; without one the list
does: listed URLs are blocked, others allowed.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule, are never listed
and are allowed. Repeated pages are judged alike. An empty list blocks nothing by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook.llm.common import free_name, without

#: Bits set for a URL, nine bits of hash each.
BITS = 7
#: Filter bits for each listed URL, as far as the bound allows.
BITS_PER_URL = 12
#: At most so many blocks of 64 bytes: 8 MiB.
MAX_BLOCKS = 1 << 17
#: Query parameters (prefixes) that don't change what a URL names.
TRACKING = ("utm_", "ref=", "fbclid=", "gclid=")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``, or an empty string."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The canonical form, null for a URL without ``://``."""
    site = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    place = F.regexp_replace(path(url), r"/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~reduce(lambda a, b: a | b, [p.startswith(x) for x in TRACKING], F.lit(False)))
    asked = F.array_join(F.array_sort(kept), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(site, place, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise("")))


def _hashes(key: Column, blocks: int) -> list[Column]:
    """The block of a key and the hash that its bits come from."""
    return [F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), F.xxhash64(key, F.lit("bits"))]


def bloom_filter(listed: DataFrame, key: str = "canonical") -> np.ndarray:
    """The blocked Bloom filter of the keys, blocks by eight 64-bit words."""
    listed = listed.select(F.col(key).alias("key")).filter("key is not null").distinct()
    blocks = max(1, min(MAX_BLOCKS, math.ceil(listed.count() * BITS_PER_URL / 512)))
    block, bits = _hashes(F.col("key"), blocks)
    places = F.explode(F.array(*[F.shiftrightunsigned(bits, 9 * b).bitwiseAND(511) for b in range(BITS)]))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63).cast("int"))
    rows = listed.select(block.alias("block"), places.alias("place")).groupBy("block", F.shiftright("place", 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    found = rows.toArrow()
    out = np.zeros((blocks, 8), np.uint64)
    out[found.column("block").to_numpy(), found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _probed(urls: DataFrame, bloom: np.ndarray, maybe: str, key: str = "canonical_") -> DataFrame:
    """``urls`` with a boolean ``maybe``: all bits of its column ``key`` are in the filter."""
    shared = urls.sparkSession.sparkContext.broadcast(bloom)
    block, bits = _hashes(F.col(key), len(bloom))
    names = urls.columns
    block_at, bits_at = free_name(urls, "block_"), free_name(urls, "bits_")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in it:
            at = batch.column(block_at).to_numpy(zero_copy_only=False)
            hashed = batch.column(bits_at).to_numpy(zero_copy_only=False).view(np.uint64)
            found = batch.column(key).is_valid().to_numpy(zero_copy_only=False).copy()
            for b in range(BITS):
                place = (hashed >> np.uint64(9 * b)) & np.uint64(511)
                found &= (words[at, place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found)], names=[*names, maybe])

    schema = T.StructType([*urls.schema.fields, T.StructField(maybe, T.BooleanType(), False)])
    return urls.withColumn(block_at, block).withColumn(bits_at, bits).mapInArrow(run, schema)


def by_rules(rules: list[tuple[str, str, str]], host_: Column, path_: Column) -> tuple[Column, Column]:
    """The longest fitting rule (as host and path) and its verdict, null where none fits."""
    name = verdict = None
    for site, place, judged in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host_ == site) | host_.endswith(f".{site}")) & path_.startswith(place)
        name = (F if name is None else name).when(fits, F.lit(site + place))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(judged))
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", key: str = "canonical") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names, in
    whatever case, are replaced. ``listed`` has the canonical URLs to block in its column ``key``."""
    kept = without(pages, ["host", "path", "rule", "verdict"])
    name, maybe, hit = (free_name(pages, c) for c in ("canonical_", "maybe_", "listed_"))
    keyed = pages.select(*[F.col(f"`{c}`") for c in kept], canonical(F.col(url)).alias(name))
    probed = _probed(keyed, bloom_filter(listed, key), maybe, name)
    exact = listed.select(F.col(key).alias(name)).filter(F.col(name).isNotNull()).distinct().withColumn(hit, F.lit(True))
    hits = probed.filter(F.col(maybe)).join(exact, name, "left").withColumn(hit, F.coalesce(hit, F.lit(False)))
    both = hits.unionByName(probed.filter(~F.col(maybe)).withColumn(hit, F.lit(False)))
    placed = both.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    rule, verdict = by_rules(rules, F.col("host"), F.col("path"))
    otherwise = F.when(F.col(hit), "block").otherwise("allow")
    return placed.select(*[F.col(f"`{c}`") for c in kept], "host", "path", rule.alias("rule"), F.coalesce(verdict, otherwise).alias("verdict"))


def repeated(pages: DataFrame, url: str = "url") -> DataFrame:
    """The canonical URLs that several pages share."""
    named = pages.select(canonical(F.col(url)).alias("canonical")).filter("canonical is not null")
    return named.groupBy("canonical").count().filter("count > 1").select("canonical")


#: The rules of the registered query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def digests(pages: DataFrame) -> DataFrame:
    """The verdicts by ``RULES`` and a list of the URLs that several pages share."""
    pages = pages.select("page_id", "url")
    return judge(pages, repeated(pages), RULES).select("page_id", "host", "path", "rule", "verdict")

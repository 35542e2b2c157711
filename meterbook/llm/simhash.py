"""SimHash near-duplicate groups by a byte-position inverted index with count filtering.

A fingerprint is eight bytes. Two that differ in at most ``max_bits`` (three) bits differ in
at most three bytes, so they share the bytes of at least ``MIN_MATCHES`` (five) of the eight
positions: that is the guaranteed count. The inverted index holds one posting for every
choice of five positions, keyed by those positions and their bytes, so a pair that reaches
the count meets in some posting list whatever its size; single positions would give lists
that hold 1/256 of the corpus each. Within a list the bytes that each pair shares are
tallied, pairs that reach the count are retained, and the bit distance verifies them. A list
gives links that span its groups, not all its pairs.

A list may be hot (many near copies around one text). Lists over ``LIST_ROWS`` are dealt anew
by finer keys which together still hold every pair within the distance: the sixth shared
byte (three choices of it; at most 65,536 different fingerprints), or, where the three other
bytes all differ, hence in one bit each, which half of each byte that bit is in (eight
choices; at most 4,096). No list is cut and none grows with the corpus.

Exact copies of a fingerprint are one row before the index is built. Components are found by
joins over the links of different fingerprints (large-star, small-star), written to the
shared folder every round.

Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows
give repeated rows of the groups. The representative of a group is one row: the one with the
smallest doc_id, of several the one with the smallest fingerprint, then hash of the row. A null
doc_id is never a representative unless its whole group has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook.llm.common import slices, utf8, written

BYTES = 8
#: Bytes of two fingerprints within three bits that agree at least.
MIN_MATCHES = 5
#: Posting lists with more different fingerprints are dealt anew by finer keys.
LIST_ROWS = 2048
#: In lists up to this all rows are compared at once.
SHORT_ROWS = 16
#: Rows of a longer list compared with all others at once.
BLOCK_ROWS = 512
SEED = 42

_POSITIONS = list(combinations(range(BYTES), MIN_MATCHES))


def _mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


_MASKS = np.array([_mask(p) for p in _POSITIONS], np.uint64)
_ORDER = np.argsort(_MASKS)
_SORTED_MASKS = _MASKS[_ORDER]


def _mix(keys: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """A bijection of 64-bit keys for each salt."""
    with np.errstate(over="ignore"):
        x = keys + (np.asarray(salt).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64-bit SimHash of the word shingles of a text, repeats included."""
    words = text.lower().split()  # bytes: A-Z only, and the ASCII white space of the contract
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    starts = np.cumsum([0, *map(len, words)])[:-1] + np.arange(len(words))
    ends = np.append(starts[shingle:] - 1, len(joined)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends, strict=False)), np.uint64, len(ends))
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        block = hashes[at : at + 65_536]
        bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed 64-bit integer, and as ``row`` the column
    of that name, if one is given. No shuffle."""
    extra = [] if row is None else [row]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            found = np.array([fingerprint(x, shingle) for x in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", "row"][: 2 + len(extra)])

    kind = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("fp", T.LongType(), False), *[T.StructField("row", docs.schema[c].dataType) for c in extra]])
    return docs.select(F.col(doc_id), F.col(text), *[F.col(c) for c in extra]).mapInArrow(run, kind)


def _retained(a: np.ndarray, b: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Tally the positional bytes that a and b share (they broadcast), retain those that
    reach the guaranteed count and verify them: (near, first), where ``first`` is the mask of
    the first five shared positions, meaningful where near."""
    differ = a ^ b
    tally = np.zeros(differ.shape, np.uint8)
    first = np.zeros(differ.shape, np.uint64)
    for p in range(BYTES):
        byte = np.uint64(0xFF << (8 * p))
        same = (differ & byte) == 0
        first |= np.where(same & (tally < MIN_MATCHES), byte, np.uint64(0))
        tally += same
    return (tally >= MIN_MATCHES) & (np.bitwise_count(differ) <= max_bits), first


def _spanning(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one posting list: each member to one of its group, where groups are what the
    retained and verified pairs connect."""
    n = len(fps)
    root = np.arange(n)
    for at in range(0, n, BLOCK_ROWS):
        for to in range(at, n, BLOCK_ROWS):
            mine, other = root[at : at + BLOCK_ROWS], root[to : to + BLOCK_ROWS]
            if (mine == mine[0]).all() and (other == mine[0]).all():
                continue  # one group already
            differ = fps[at : at + BLOCK_ROWS, None] ^ fps[None, to : to + BLOCK_ROWS]
            i, j = np.nonzero(np.bitwise_count(differ) <= max_bits)
            near, _ = _retained(fps[at + i], fps[to + j], max_bits)
            pairs = np.unique(np.stack([mine[i[near]], other[j[near]]]), axis=1)
            for a, b in zip(*pairs.tolist(), strict=True):
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
            while not np.array_equal(root, root[root]):
                root = root[root]
    members = np.flatnonzero(root != np.arange(n))
    return fps[root[members]], fps[members]


def _linked(keys: np.ndarray, fps: np.ndarray, max_bits: int, finer: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole posting lists, rows sorted by key. Short lists compare all their
    rows at once, and a pair is taken in the first of the lists that it shares."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    after = np.repeat(starts + sizes, sizes) - np.arange(len(keys))  # rows of the list from here on
    after[np.repeat(sizes > SHORT_ROWS, sizes)] = 0
    found = [_spanning(fps[b : b + n], max_bits) for b, n in zip(starts[sizes > SHORT_ROWS].tolist(), sizes[sizes > SHORT_ROWS].tolist(), strict=True)]
    for step in range(1, SHORT_ROWS):
        i = np.flatnonzero(after > step)
        if not len(i):
            break
        a, b = fps[i], fps[i + step]
        near, first = _retained(a, b, max_bits)
        if not finer:
            near &= _mix(a & first, _ORDER[np.searchsorted(_SORTED_MASKS, first) % len(_MASKS)]) == keys[i]
        found.append((a[near], b[near]))
    return tuple(np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.uint64) for k in (0, 1))


def _lists(index: DataFrame, max_bits: int, finer: bool) -> DataFrame:
    """Links within the posting lists of ``index`` (key, fp)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def linked(end: int) -> Iterator[pa.RecordBatch]:
            if end:
                a, b = _linked(keys[:end], fps[:end], max_bits, finer)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (np.minimum(a, b), np.maximum(a, b))], names=["a", "b"])

        for batch in it:
            new = [batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1)]
            keys, fps = np.concatenate([keys, new[0]]), np.concatenate([fps, new[1]])
            last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if len(keys) and (keys != keys[-1]).any() else 0
            yield from linked(last)
            keys, fps = keys[last:], fps[last:]
        yield from linked(len(keys))

    return index.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _postings(distinct: DataFrame) -> DataFrame:
    """One row per fingerprint and choice of positions: (key, fp)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fps), 4096):
                fps = all_fps[at : at + 4096]
                keys = np.concatenate([_mix(fps & mask, k) for k, mask in enumerate(_MASKS)])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.tile(fps, len(_MASKS)).view(np.int64))], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def _finer(postings: DataFrame) -> DataFrame:
    """The postings of hot lists under finer keys."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            out_keys, out_fps = [], []
            for k, positions in enumerate(_POSITIONS):
                mine = np.flatnonzero(_mix(fps & _MASKS[k], k) == keys)
                if not len(mine):
                    continue
                fp, key = fps[mine], keys[mine]
                free = [p for p in range(BYTES) if p not in positions]
                for p in free:
                    out_keys.append(_mix(key ^ _mix(fp & np.uint64(0xFF << (8 * p)), p), 100 + p))
                    out_fps.append(fp)
                for halves in range(2 ** len(free)):
                    fixed = sum((0xF0 if halves >> n & 1 else 0x0F) << (8 * p) for n, p in enumerate(free))
                    out_keys.append(_mix(key ^ _mix(fp & np.uint64(fixed), halves), 200 + halves))
                    out_fps.append(fp)
            if out_keys:
                k, f = np.concatenate(out_keys).view(np.int64), np.concatenate(out_fps).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f)], names=["key", "fp"])

    return postings.mapInArrow(run, "key long, fp long")


def links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (a, b) that connect the fingerprints ``fp`` (different rows)
    exactly as all pairs within ``max_bits`` bits do."""
    if not 0 <= max_bits <= BYTES - MIN_MATCHES:
        raise ValueError(f"the index guarantees distances up to {BYTES - MIN_MATCHES}")
    postings = _postings(distinct)
    sizes = postings.groupBy("key").count()
    hot = sizes.filter(F.col("count") > LIST_ROWS).select("key")
    hot = written(hot, "simhash-hot")
    usual = _lists(postings.join(hot, "key", "left_anti"), max_bits, False)
    return usual.unionByName(_lists(_finer(postings.join(hot, "key", "left_semi")), max_bits, True)).distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and two sums of hashes: equal sets of edges have equal states."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row per node with the smallest node it
    reaches (``node``, ``root``), by alternating large-star and small-star rounds."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "components")
    before, now = None, _state(edges)
    while before != now:
        # large star: every neighbour above a node is linked to the least of its neighbourhood
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low"))
        least = least.select("u", F.least("u", "low").alias("low"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        # small star: every neighbour below a node, and the node, are linked to the least
        down = large.filter("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("low"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct("v", "low"), F.struct(F.col("u").alias("v"), "low"))).alias("x"))
        after = written(small.select(F.col("x.v").alias("u"), F.col("x.low").alias("v")).filter("u <> v").distinct(), "components")
        edges, before, now = after, now, _state(after)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _rooted(marked: DataFrame, low: Column, max_bits: int) -> DataFrame:
    """One row per fingerprint of ``marked``: ``fp``, ``low`` of its rows and the ``root`` of its
    group."""
    tasks = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out by number: each fingerprint becomes many postings, however few bytes they are now
    distinct = marked.groupBy("fp").agg(low.alias("low")).repartition(tasks, "fp")
    groups = components(links(distinct, max_bits))
    return distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ``fp`` and ``component_id``, the smallest doc_id of its
    group."""
    marked = written(fingerprints(docs, shingle, doc_id, text), "simhash")
    rooted = _rooted(marked, F.min("doc_id"), max_bits)
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def digests(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    found = near_duplicates(docs, shingle, max_bits)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of ``docs`` for each group: see the module's text."""
    row = "row"
    while row in docs.columns:
        row += "_"
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # two hashes of all columns (which of them are null counts): equal for repeated rows only
    values = [*[c.isNull() for c in columns], *columns]
    keyed = docs.withColumn(row, F.struct(F.xxhash64(F.lit(1), *values).alias("a"), F.xxhash64(F.lit(2), *values).alias("b")))
    marked = written(fingerprints(keyed, shingle, row=row), "simhash")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "row")
    lows = _rooted(marked, F.min(key), max_bits).groupBy("root").agg(F.min("low").alias("low"))
    kept = lows.select(F.col("low.row").alias(row))
    # repeated rows are one before they are dealt out
    return keyed.dropDuplicates([row]).join(kept, row, "left_semi").select(*columns)

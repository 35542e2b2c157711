"""Benchmark decontamination with an FM-index per training shard.

The windows of the benchmark items (``WINDOW`` consecutive words, or the whole item if it has
fewer) are the queries, in blocks of bounded size that are broadcast; every document is
searched for all of them. A shard is some megabytes of whole documents within one task. Its
words are numbered by the benchmark's vocabulary; a word pair that follows nowhere in the
benchmark ends a run, since no window reaches across it, and runs shorter than the shortest
window are left out: what remains holds every occurrence. Over those runs the shard builds an
FM-index: suffix order by prefix doubling, its Burrows-Wheeler transform in a wavelet matrix,
and every ``SAMPLE``-th text position. All windows step backwards together through
wavelet-matrix ranks; the rows that remain are located by walking to a sampled position, and
the word spans of a document are merged.

No shuffle. Null and empty texts have no words, are never hit and are not contaminated.
Repeated documents are judged each on its own; repeated or null item texts do no harm (null
has no words); rows of one item_id are one item. An empty benchmark leaves all clean.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook.llm.common import set_aside, utf8, without, written

WINDOW = 13
#: Text bytes of one shard.
SHARD_BYTES = 8_000_000
#: Bytes of benchmark text that are broadcast and searched at once.
BLOCK_BYTES = 8_000_000
#: Every so many positions of the indexed text keep their suffix position.
SAMPLE = 8

_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters a-z, digits and everything beyond ASCII."""
    return text.translate(_WORD_BYTES).split()


class Windows:
    """The distinct windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        by_words: dict[tuple[int, ...], set] = {}
        pairs = set()
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            pairs.update(zip(ids, ids[1:], strict=False))
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                by_words.setdefault(tuple(ids[at : at + window]), set()).add(item)
        self.windows = list(by_words)
        self.items = [sorted(x, key=str) for x in by_words.values()]
        self.shortest = min(map(len, self.windows), default=0)
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.words = np.zeros((len(self.windows), window), np.int64)  # right-aligned
        for k, w in enumerate(self.windows):
            self.words[k, window - len(w) :] = w
        self.base = len(self.vocabulary) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), np.int64)

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of word ids is a pair of neighbours in the benchmark."""
        if not len(self.pairs):
            return np.zeros(len(left), bool)
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return (left > 0) & (right > 0) & (self.pairs[at] == keys)


class WaveletMatrix:
    """Rank and access over a sequence of small integers."""

    def __init__(self, sequence: np.ndarray):
        self.levels = max(1, int(sequence.max(initial=0)).bit_length())
        self.ones: list[np.ndarray] = []  # number of one bits before each position
        self.zeros: list[int] = []
        for level in reversed(range(self.levels)):
            bits = (sequence >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bits)]).astype(np.int32))
            self.zeros.append(int(len(sequence) - bits.sum()))
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        low, high = np.zeros_like(ends), ends
        for k, level in enumerate(reversed(range(self.levels))):
            one = (symbols >> level) & 1 == 1
            ones_low, ones_high = self.ones[k][low], self.ones[k][high]
            low = np.where(one, self.zeros[k] + ones_low, low - ones_low)
            high = np.where(one, self.zeros[k] + ones_high, high - ones_high)
        return np.where(symbols >> self.levels == 0, high - low, 0)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the given positions."""
        out = np.zeros_like(at)
        for k, level in enumerate(reversed(range(self.levels))):
            before = self.ones[k][at]
            one = self.ones[k][at + 1] > before
            out |= one.astype(out.dtype) << level
            at = np.where(one, self.zeros[k] + before, at - before)
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` (it ends in a unique least symbol) in suffix order, by prefix
    doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        next_rank = np.concatenate([rank[width:] + 1, np.zeros(min(width, len(rank)), np.int64)])
        keys = rank * (len(text) + 1) + next_rank[: len(rank)]
        order = np.argsort(keys, kind="stable")
        ahead = keys[order]
        new = np.empty_like(rank)
        new[order] = np.cumsum(np.append(0, ahead[1:] != ahead[:-1]))
        rank, width = new, width * 2
        if rank[order[-1]] == len(text) - 1:
            return order


class FMIndex:
    """Backward search and locate over one shard's text (symbols from 1 up)."""

    def __init__(self, text: np.ndarray):
        text = np.append(text, 0)
        order = suffix_order(text)
        transformed = text[order - 1]
        self.size = len(text)
        self.tree = WaveletMatrix(transformed)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])  # rows of smaller symbols
        marked = order % SAMPLE == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.samples = order[marked]

    def _step(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        known = np.minimum(symbols, len(self.first) - 1)
        return self.first[known] + self.tree.rank(symbols, rows)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row ranges of right-aligned patterns."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            symbols = patterns[live, -back]
            low[live] = self._step(symbols, low[live])
            high[live] = self._step(symbols, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out = np.zeros(len(rows), np.int64)
        todo, walked = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            here = rows[todo]
            done = self.marks[here + 1] > self.marks[here]
            out[todo[done]] = self.samples[self.marks[here[done]]] + walked
            todo, here = todo[~done], here[~done]
            rows[todo] = self._step(self.tree.access(here), here)
            walked += 1
        return out


def _search(texts: list[bytes], queries: Windows) -> tuple[list[int], list[list[tuple[int, int]]], list[list]]:
    """Number of words, merged hit spans (first word, past the last) and found items of each text."""
    known = queries.vocabulary.get
    ids = [np.array([known(w, 0) for w in words(t)], np.int64) for t in texts]
    counts = [len(x) for x in ids]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list] = [[] for _ in texts]
    # one zero after each document keeps runs within it
    flat = np.concatenate([np.append(x, 0) for x in ids]) if ids else np.zeros(0, np.int64)
    begins = np.cumsum([0, *(c + 1 for c in counts)])
    at = np.flatnonzero(flat)
    if not len(at) or not queries.windows:
        return counts, spans, items
    follows = np.append(False, (at[1:] == at[:-1] + 1) & queries.follows(flat[at[:-1]], flat[at[1:]]))
    run = np.cumsum(~follows) - 1
    long = np.bincount(run) >= queries.shortest
    if queries.shortest == 1:  # of single words only the windows themselves
        single = np.zeros(queries.base, bool)
        single[[w[0] for w in queries.windows if len(w) == 1]] = True
        long &= (np.bincount(run) > 1) | single[flat[at[~follows]]]
    at, run = at[long[run]], run[long[run]]
    if not len(at):
        return counts, spans, items
    # symbols: 1 between runs, word id + 1 else
    gap = np.append(False, run[1:] != run[:-1]).astype(np.int64)
    place = np.arange(len(at)) + np.cumsum(gap)
    text, source = np.ones(place[-1] + 1, np.int64), np.zeros(place[-1] + 1, np.int64)
    text[place], source[place] = flat[at] + 1, at
    index = FMIndex(text)
    low, high = index.search(queries.words + 1, queries.lengths)
    found = np.flatnonzero(high > low)
    times = (high - low)[found]
    rows = np.repeat(low[found] - np.cumsum(times) + times, times) + np.arange(times.sum())
    which = np.repeat(found, times)
    start = source[index.locate(rows)]
    cover = np.zeros(len(flat) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + queries.lengths[which], -1)
    hit = np.cumsum(cover) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        doc = int(np.searchsorted(begins, a, side="right")) - 1
        spans[doc].append((a - int(begins[doc]), b - int(begins[doc])))
    docs = np.searchsorted(begins, start, side="right") - 1
    for key in np.unique(docs * len(queries.windows) + which).tolist():
        doc, window = divmod(key, len(queries.windows))
        items[doc] += queries.items[window]
    return counts, spans, [sorted(set(x), key=str) for x in items]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_LOADED: dict[str, Windows] = {}


def _windows(key: str, block: Broadcast, window: int) -> Windows:
    """The windows of a broadcast block, built once in a Python worker."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Windows(block.value, window)
    return _LOADED[key]


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, bytes]]]:
    """The benchmark without repeated rows in blocks of at most ``BLOCK_BYTES``, one at a time.
    Rows are dealt to cells of a sixteenth of a block on average; blocks are filled with cells
    by their bytes, so only a cell that is larger by itself (a long text) makes a larger block."""
    rows = benchmark.select(F.col(item_id).alias("item"), F.col(text).cast("binary").alias("text")).filter("text is not null")
    rows = written(rows.distinct(), "benchmark")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cell = F.pmod(F.xxhash64("item", "text"), F.lit(max(1, math.ceil(16 * total / BLOCK_BYTES))))
    sizes = rows.groupBy(cell.alias("cell")).agg(F.sum(F.octet_length("text")).alias("n")).orderBy("cell").collect()
    start, size = 0, 0
    for k, r in enumerate(sizes):
        size += r.n
        if k + 1 == len(sizes) or size + sizes[k + 1].n > BLOCK_BYTES:
            if size:
                mine = rows.filter(cell.between(sizes[start].cell, r.cell))
                yield [(x.item, bytes(x.text)) for x in mine.toLocalIterator()]
            start, size = k + 1, 0


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, the merged ``spans`` of hit words and the ``items`` that occur,
    as strings in ascending order; columns of these names, in whatever case, are replaced."""
    kept = without(docs, FOUND.names)
    schema = T.StructType([docs.schema[c] for c in kept] + FOUND.fields)
    found_type = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def search(block: Broadcast, first: bool):
        key = uuid.uuid4().hex

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = _windows(key, block, window)
            for batch in it:
                texts = utf8(batch.column(text))
                sizes = np.cumsum([len(t) for t in texts])
                shards = np.searchsorted(sizes, np.arange(SHARD_BYTES, int(sizes[-1]) if len(sizes) else 0, SHARD_BYTES)).tolist()
                for a, b in zip([0, *shards], [*shards, len(texts)], strict=True):
                    if a == b:
                        continue
                    counts, spans, items = _search(texts[a:b], queries)
                    if not first:  # what earlier blocks of the benchmark have found
                        old = batch.slice(a, b - a)
                        spans = [_merge(x + [(s["start"], s["end"]) for s in y]) for x, y in zip(spans, old.column("spans").to_pylist(), strict=True)]
                        items = [sorted({*map(str, x), *y}) for x, y in zip(items, old.column("items").to_pylist(), strict=True)]
                    columns = [
                        pa.array(counts, pa.int64()),
                        pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], found_type.field("spans").type),
                        pa.array([[str(i) for i in x] for x in items], found_type.field("items").type),
                    ]
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], names=[*kept, *FOUND.names])

        return run

    out, first = docs.select(*[F.col(f"`{c}`") for c in kept]), True
    context = docs.sparkSession.sparkContext
    for items in _blocks(benchmark, item_id, item_text):
        out = out.mapInArrow(search(context.broadcast(items), first), schema)
        first = False
    return out.mapInArrow(search(context.broadcast([]), first), schema) if first else out


def judged(found: DataFrame) -> DataFrame:
    """``found`` with ``n_hit`` and ``contaminated``: a twentieth of the words or more are hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = judged(occurrences(docs.select("doc_id", "text"), benchmark))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns as they were."""
    renamed, names = set_aside(docs, [*FOUND.names, "n_hit", "contaminated"])
    kept = judged(occurrences(renamed, benchmark)).filter(~F.col("contaminated"))
    return kept.select(*[F.col(f"`{name}`").alias(c) for c, name in names.items()])

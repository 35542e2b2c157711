"""Removal of byte strings that an earlier document holds, by prefix-free parsing.

Every 50-byte string (a window) of a document is covered if it also starts in a document with
a smaller doc_id; covered bytes are removed. Windows never cross documents.

Parsing. A rolling hash runs over all 8-byte strings. Of those inside a window the one with
the least hash (the leftmost of equals) is the window's trigger; it depends on the window's
bytes alone, so equal windows have equal triggers at equal offsets. Consecutive windows with
the same trigger make a phrase, and neighbouring phrases overlap by 49 bytes: each window
lies whole in exactly one phrase, no phrase is longer than 92 bytes, and the order of the
corpus's suffixes to depth 50 never has to look past a phrase.

Dictionary and parse. Documents are dealt to parts by a hash of doc_id
and text. A part's distinct
phrases are its dictionary, in the order of first occurrence with the doc_id of that first
(smallest) document; where its phrases stand is its parse, which stays with the part and is
made again when needed. Only the dictionaries travel, cut into buckets by trigger, so a
passage in any number of documents costs a bucket one entry a part.

Hot triggers. The triggers of all phrases are counted first, in cells by their hash. A phrase
whose trigger's cell holds more than ``HOT`` phrases does not travel whole but in units: the
windows with the trigger in their left half share the 29 bytes from it on, the others the 30
bytes up to its end, and each half goes to the bucket of those bytes' hash. Halves are counted
the same way, and a half over the limit travels as single windows, each to the bucket of its
own hash. Equal windows always travel in the same way and meet; every window is in one unit. A
part sends a unit once, with its smallest doc_id there. All other phrases are one unit.

Corpus order. A bucket joins the dictionaries. A phrase whose smallest document overall comes
before a part's is covered there entirely. Phrases that share 29 bytes around the trigger with
a different phrase may also share windows: their suffixes are ranked to depth 50 by prefix
doubling (the dictionary's suffix array), equal ranks are one window, and the smallest
document of its phrases is the window's. The answer goes back to the part as a bit mask for
each phrase, and the part combines it with its parse: a later document than the part's first
with the phrase is covered, the first one as the mask says.

Null and empty texts have no bytes; shorter texts than a window are kept. Documents with the
same doc_id don't cover each other. A null doc_id counts as larger than all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook.llm.common import free_name, partitions_for, set_aside, slices, text_bytes, utf8, without

#: Bytes of a window.
DEPTH = 50
#: Bytes of a trigger.
GRAM = 8
#: Windows look for their trigger among so many strings.
CHOICES = DEPTH - GRAM + 1
#: Text bytes of a part.
PART_BYTES = 6_000_000
#: Bytes parsed at once; longer documents are parsed in overlapping pieces.
PIECE_BYTES = 1 << 20
#: Bytes on one side of the trigger which some side of every window has.
SIDE = (DEPTH - GRAM) // 2
#: Phrases with a trigger, or with a half, over this many travel in smaller units (from half of
#: this on some do): half as many as an average bucket holds.
HOT = PART_BYTES // 44
#: Counting cells for each part.
CELLS = 32
LAST = (1 << 63) - 1
_POSITION_BITS = np.uint64(22)


def _eight(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as an integer (zeros past the end)."""
    x = np.concatenate([raw, np.zeros(7, np.uint8)]).astype(np.uint64)
    x = (x[:-1] << np.uint64(8)) | x[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    return (x[:-4] << np.uint64(32)) | x[4:]


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the trigger-sized string from each position."""
    with np.errstate(over="ignore"):
        x = _eight(raw) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each position on."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def _cores(hashes: np.ndarray, at: np.ndarray, left: bool) -> np.ndarray:
    """A hash of the bytes that all windows of a half share: from triggers at ``at`` on, or (left)
    up to their ends. ``hashes`` are those of all trigger-sized strings."""
    out = np.full(len(at), left, np.uint64)
    with np.errstate(over="ignore"):
        for by in (-SIDE - 1, GRAM - SIDE - 1, 2 * GRAM - SIDE - 1, 0) if left else (0, GRAM, 2 * GRAM, SIDE):
            out = (out ^ hashes[at + by]) * np.uint64(0x94D049BB133111EB)
            out ^= out >> np.uint64(31)
    return out


def _halves(offset: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which phrases have windows with the trigger up to ``SIDE`` bytes from their start, and
    which have others."""
    return offset - count + 1 <= SIDE, offset > SIDE


class Parse:
    """The phrases of some documents: an iterator of pieces, and the dictionary they add up to.
    ``hot`` has the counting cells over the limit, of triggers and, from ``cells`` on, halves."""

    def __init__(self, docs: list[tuple[int, bytes]], buckets: int, hot: np.ndarray | None = None):
        self.docs = docs
        self.buckets = buckets
        self.cells = buckets * CELLS
        self.hot = np.zeros(0, np.int64) if hot is None else hot
        self.hot_phrases: list[int] = []
        self.phrases: dict[bytes, int] = {}
        self.first: list[int] = []  # doc_id where the phrase occurs first
        self.offset: list[int] = []  # of the trigger in the phrase
        self.bucket: list[int] = []

    def _pieces(self) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
        """Stretches of documents, (index, first window, past the last), some at a time."""
        some, size = [], 0
        for k, (_, text) in enumerate(self.docs):
            windows = len(text) - DEPTH + 1
            for a in range(0, windows, PIECE_BYTES):
                b = min(windows, a + PIECE_BYTES)
                some.append((k, a, b))
                size += b - a + DEPTH
                if size >= PIECE_BYTES:
                    yield some, b"".join(self.docs[i][1][x : y + DEPTH - 1] for i, x, y in some)
                    some, size = [], 0
        if some:
            yield some, b"".join(self.docs[i][1][x : y + DEPTH - 1] for i, x, y in some)

    def _found(self) -> Iterator[tuple]:
        """For each piece: its stretches, where they begin, its bytes, their hashes and of all
        phrase occurrences the stretch, start, number of windows and trigger."""
        for stretches, data in self._pieces():
            raw = np.frombuffer(data, np.uint8)
            hashes = _gram_hashes(raw)
            keyed = (hashes >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(raw), dtype=np.uint64)
            least = _sliding_min(keyed[: len(raw) - GRAM + 1], CHOICES)
            trigger = (least & np.uint64((1 << int(_POSITION_BITS)) - 1)).astype(np.int64)
            sizes = np.array([b - a for _, a, b in stretches], np.int64)
            begins = np.cumsum(sizes + DEPTH - 1) - sizes - DEPTH + 1
            # the windows of the stretches alone, without those that reach from one into the next
            windows = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            trigger = trigger[windows]
            new = np.append(True, (trigger[1:] != trigger[:-1]) | (windows[1:] != windows[:-1] + 1))
            at = np.flatnonzero(new)
            start, count = windows[at], np.diff(np.append(at, len(windows)))
            yield stretches, begins, data, hashes, np.searchsorted(np.cumsum(sizes), at, side="right"), start, count, trigger[at]

    def counted(self) -> np.ndarray:
        """How many phrase occurrences fall into each cell, and how many halves."""
        out = np.zeros(2 * self.cells, np.int64)
        for _, _, _, hashes, _, start, count, trigger in self._found():
            out[: self.cells] += np.bincount((hashes[trigger] % np.uint64(self.cells)).astype(np.int64), minlength=self.cells)
            for left, some in enumerate(_halves(trigger - start, count)):
                cores = _cores(hashes, trigger[some], bool(left))
                out[self.cells :] += np.bincount((cores % np.uint64(self.cells)).astype(np.int64), minlength=self.cells)
        return out

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each piece: document index, first window, number of windows and phrase of all
        its phrase occurrences, in order."""
        for stretches, begins, data, hashes, owner, start, count, trigger in self._found():
            end = start + count + DEPTH - 1
            phrase = self._named(data, start, end, trigger - start, hashes[trigger], owner, stretches)
            first_window = start - begins[owner] + np.array([a for _, a, _ in stretches])[owner]
            yield np.array([k for k, _, _ in stretches])[owner], first_window, count, phrase

    def _named(self, data: bytes, start: np.ndarray, end: np.ndarray, offset: np.ndarray, hashes: np.ndarray, owner: np.ndarray, stretches: list) -> np.ndarray:
        known = self.phrases
        before = len(known)
        names = [known.setdefault(data[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        out = np.array(names, np.int64)
        if len(known) > before:
            fresh, where = np.unique(out, return_index=True)
            where = where[fresh >= before]
            self.first += [self.docs[stretches[k][0]][0] for k in owner[where].tolist()]
            self.offset += offset[where].tolist()
            self.bucket += (hashes[where] % np.uint64(self.buckets)).tolist()
            if len(self.hot):
                self.hot_phrases += fresh[fresh >= before][np.isin((hashes[where] % np.uint64(self.cells)).astype(np.int64), self.hot)].tolist()
        return out



class Units:
    """What a parse sends: its phrases, and those with a hot trigger in pieces. Of each unit
    the bytes, the offset of the trigger, the smallest doc_id and the bucket."""

    def __init__(self, parse: Parse):
        self.parse = parse
        hot = np.array(parse.hot_phrases, np.int64)
        listed = list(parse.phrases)
        whole = np.ones(len(listed), bool)
        whole[hot] = False
        self.whole = np.flatnonzero(whole)
        self.texts = [listed[k] for k in self.whole.tolist()]
        offset, first = np.array(parse.offset, np.int64), np.array(parse.first, np.int64)
        self.pieces: list[tuple[int, int, int, int]] = []  # phrase, its first window, windows, unit
        pieces_of, offsets, firsts, buckets = {}, [], [], []
        for k, start, count, bucket in self._cut([listed[k] for k in hot.tolist()], hot, offset[hot]):
            text = listed[k][start : start + count + DEPTH - 1]
            unit = pieces_of.setdefault(text, len(pieces_of))
            if unit == len(offsets):
                offsets.append(offset[k] - start)
                firsts.append(first[k])
                buckets.append(bucket)
            firsts[unit] = min(firsts[unit], first[k])
            self.pieces.append((k, start, count, len(self.whole) + unit))
        self.texts += pieces_of
        self.offset = np.concatenate([offset[self.whole], np.array(offsets, np.int64)])
        self.first = np.concatenate([first[self.whole], np.array(firsts, np.int64)])
        self.bucket = np.concatenate([np.array(parse.bucket, np.int64)[self.whole], np.array(buckets, np.int64)])

    def _cut(self, texts: list[bytes], names: np.ndarray, offset: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(phrase, first window, number of windows, bucket) of the units of these phrases."""
        if not texts:
            return
        lengths = np.array([len(x) for x in texts], np.int64)
        count = lengths - DEPTH + 1
        hashes = _gram_hashes(np.frombuffer(b"".join(texts), np.uint8))
        trigger = np.cumsum(lengths) - lengths + offset
        right, left = _halves(offset, count)
        cells, buckets = np.uint64(self.parse.cells), self.parse.buckets
        for is_left, some in ((True, np.flatnonzero(left)), (False, np.flatnonzero(right))):
            cores = _cores(hashes, trigger[some], is_left)
            single = np.isin((cores % cells).astype(np.int64) + int(cells), self.parse.hot)
            for i, core, alone in zip(some.tolist(), cores.tolist(), single.tolist(), strict=True):
                o, n = int(offset[i]), int(count[i])
                a, b = (0, min(n, o - SIDE)) if is_left else (max(0, o - SIDE), n)
                if alone:
                    for w in range(a, b):
                        yield int(names[i]), w, 1, xxhash.xxh64_intdigest(texts[i][w : w + DEPTH]) % buckets
                else:
                    yield int(names[i]), a, b - a, core % buckets

    def by_bucket(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each bucket with its units in order."""
        order = np.argsort(self.bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(self.bucket[order])) + 1
        if len(order):
            for units in np.split(order, cuts):
                yield int(self.bucket[units[0]]), units

    def phrase_masks(self, masks: np.ndarray) -> np.ndarray:
        """The masks of the parse's phrases from those of the units."""
        out = np.zeros(len(self.parse.phrases), np.int64)
        out[self.whole] = masks[: len(self.whole)]
        for k, start, count, unit in self.pieces:
            every = (1 << count) - 1
            mask = every if self.parse.first[k] > self.first[unit] else int(masks[unit]) & every
            out[k] |= mask << start
        return out


def _sorted_docs(rows: pa.Table, doc_id: str, text: str) -> tuple[list[tuple[int, bytes]], list[int]]:
    """(doc_id, bytes) in ascending order, and where each was in the table."""
    ids = [LAST if i is None else i for i in rows.column(doc_id).to_pylist()]
    texts = utf8(rows.column(text))
    order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
    return [(ids[k], texts[k]) for k in order], order


def _dictionary(rows: pa.Table, doc_id: str, text: str, part: str, buckets: int, hot: np.ndarray) -> pa.Table:
    """A part's dictionary, one compressed row a bucket."""
    docs, _ = _sorted_docs(rows, doc_id, text)
    parse = Parse(docs, buckets, hot)
    for _ in parse:
        pass
    units = Units(parse)
    listed = units.texts
    lengths = np.array([len(x) for x in listed], np.uint8)
    offsets, first = units.offset.astype(np.uint8), units.first
    pack = zstandard.ZstdCompressor(level=3).compress
    out = []
    for bucket, phrases in units.by_bucket():
        body = b"".join([lengths[phrases].tobytes(), offsets[phrases].tobytes(), first[phrases].tobytes(), *[listed[k] for k in phrases.tolist()]])
        out.append({"bucket": bucket, part: rows.column(part)[0].as_py(), "n": len(phrases), "body": pack(body)})
    return pa.Table.from_pylist(out, schema=pa.schema([("bucket", pa.int32()), (part, pa.int32()), ("n", pa.int32()), ("body", pa.binary())]))


def _ranks(raw: np.ndarray) -> np.ndarray:
    """The rank of each position's next ``DEPTH`` bytes among all: the suffix array of the
    dictionary to that depth, by prefix doubling."""
    rank = np.unique(_eight(raw), return_inverse=True)[1].astype(np.int64)

    def joined(left: np.ndarray, right: np.ndarray, by: int) -> np.ndarray:
        shifted = np.concatenate([right[by:], np.zeros(min(by, len(right)), np.int64)])
        return np.unique(left * (len(raw) + 256) + shifted, return_inverse=True)[1].astype(np.int64)

    depth = 8
    while depth * 2 <= DEPTH:
        rank, depth = joined(rank, rank, depth), depth * 2
    return joined(rank, rank, DEPTH - depth)


def _masks(phrases: list[bytes], offsets: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """For each distinct phrase, which of its windows (bits) an earlier document holds than
    the smallest document with the phrase."""
    masks = np.zeros(len(phrases), np.int64)
    sides: dict[bytes, int] = {}
    maybe = np.zeros(len(phrases), bool)
    for k, (phrase, o) in enumerate(zip(phrases, offsets.tolist(), strict=True)):
        for side in (phrase[o - SIDE : o + GRAM] if o >= SIDE else b"", phrase[o : o + GRAM + SIDE]):
            if len(side) == GRAM + SIDE:
                other = sides.setdefault(side, k)
                if other != k:
                    maybe[k] = maybe[other] = True
    chosen = np.flatnonzero(maybe)
    if not len(chosen):
        return masks
    raw = np.frombuffer(b"".join([phrases[k] for k in chosen.tolist()]), np.uint8)
    lengths = np.array([len(phrases[k]) for k in chosen.tolist()], np.int64)
    begins = np.cumsum(lengths) - lengths
    counts = lengths - DEPTH + 1
    windows = np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    owner = np.repeat(chosen, counts)
    rank = _ranks(raw)[windows]
    least = np.full(rank.max() + 1, LAST, np.int64)
    np.minimum.at(least, rank, smallest[owner])
    covered = least[rank] < smallest[owner]
    bit = np.left_shift(np.int64(1), windows - np.repeat(begins, counts))
    np.bitwise_or.at(masks, owner[covered], bit[covered])
    return masks


#: Mask of a phrase that is covered entirely.
ALL = -1


def _resolve(rows: pa.Table, part: str) -> pa.Table:
    """The answers of one bucket: a compressed array of masks for each part."""
    unpack = zstandard.ZstdDecompressor().decompress
    known: dict[bytes, int] = {}
    offset_of: list[int] = []
    entries = []
    for row in rows.to_pylist():
        body, n = unpack(row["body"]), row["n"]
        lengths, offsets = np.frombuffer(body, np.uint8, n), np.frombuffer(body, np.uint8, n, n)
        first = np.frombuffer(body, np.int64, n, 2 * n)
        ends = 10 * n + np.cumsum(lengths, dtype=np.int64)
        before = len(known)
        names = np.array([known.setdefault(body[a:b], len(known)) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)], np.int64)
        offset_of += offsets[names >= before].tolist()
        entries.append((row[part], names, first))
    smallest = np.full(len(known), LAST, np.int64)
    for _, names, first in entries:
        np.minimum.at(smallest, names, first)
    masks = _masks(list(known), np.array(offset_of, np.int64), smallest)
    pack = zstandard.ZstdCompressor(level=1).compress
    out = []
    for number, names, first in entries:
        mine = np.where(first > smallest[names], ALL, masks[names])
        if mine.any():
            out.append({"bucket": rows.column("bucket")[0].as_py(), part: number, "masks": pack(mine.astype(np.int64).tobytes())})
    return pa.Table.from_pylist(out, schema=pa.schema([("bucket", pa.int32()), (part, pa.int32()), ("masks", pa.binary())]))


def _covered(parse: Parse, answers: dict[int, bytes]) -> list[np.ndarray]:
    """Of each document the covered bytes, as booleans (empty: none)."""
    found = []
    for piece in parse:
        found.append(piece)
    units = Units(parse)
    unit_masks = np.zeros(len(units.texts), np.int64)
    for bucket, mine in units.by_bucket():
        if bucket in answers:
            unit_masks[mine] = np.frombuffer(answers[bucket], np.int64)
    masks = units.phrase_masks(unit_masks)
    del units
    first = np.array(parse.first, np.int64)
    ids = np.array([i for i, _ in parse.docs], np.int64)
    change: dict[int, np.ndarray] = {}
    for doc, start, count, phrase in found:
        mask = np.where(ids[doc] > first[phrase], ALL, masks[phrase])
        some = np.flatnonzero(mask)
        for k, d, a, n, m in zip(some.tolist(), doc[some].tolist(), start[some].tolist(), count[some].tolist(), mask[some].tolist(), strict=True):
            if d not in change:
                change[d] = np.zeros(len(parse.docs[d][1]) + 1, np.int32)
            delta = change[d]
            if m == ALL:
                delta[a] += 1
                delta[a + n - 1 + DEPTH] -= 1
            else:
                for w in range(n):
                    if m >> w & 1:
                        delta[a + w] += 1
                        delta[a + w + DEPTH] -= 1
    return [np.cumsum(change[d])[:-1] > 0 if d in change else np.zeros(0, bool) for d in range(len(parse.docs))]


def _hot(docs: DataFrame, text: str, buckets: int, n_bytes: int) -> np.ndarray:
    """Counting cells, ascending, among them all with more than ``HOT`` phrases or halves in
    all documents (of ``n_bytes``). A task names its cells with its share, by bytes, of half
    that: what all tasks leave out of a cell is less than the other half."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros(2 * buckets * CELLS, np.int64), 0
        for batch in slices(it):
            texts = utf8(batch.column(0))
            size += sum(map(len, texts))
            total += Parse([(0, x) for x in texts], buckets).counted()
        some = np.flatnonzero((total > 0) & (total >= HOT * size / (2 * max(n_bytes, 1))))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    counts = docs.select(F.col(f"`{text}`")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return np.array(sorted(r.cell for r in counts.filter(F.col("n") > HOT / 2).select("cell").collect()), np.int64)


ADDED = ("n_bytes", "removed", "kept")
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``removed`` (the maximal removed runs, as byte offsets) and
    ``kept`` (the bytes that remain, or as text without characters that lost some of their
    bytes); columns of these names, in whatever case, are replaced.

    The documents are shuffled once and that shuffle is read twice; the dictionaries are the
    only other data of the corpus's size."""
    spark = docs.sparkSession
    given = without(docs, ADDED)
    docs = docs.select(*[F.col(f"`{c}`") for c in given])
    part = free_name(docs, "part")
    n_bytes = text_bytes(docs, text)
    parts = partitions_for(docs, text, PART_BYTES, n_bytes)
    # by the text too: rows without doc_id, or with one doc_id, don't cover each other and may part
    dealt = docs.withColumn(part, F.pmod(F.xxhash64(doc_id, text), F.lit(parts)).cast("int"))
    hot = _hot(docs, text, parts, n_bytes)
    out_schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("n_bytes long, removed array<struct<start: long, end: long>>, kept " + ("string" if as_text else "binary")).fields])

    def dictionary(rows: pa.Table) -> pa.Table:
        return _dictionary(rows, doc_id, text, part, parts, hot)

    def resolve(rows: pa.Table) -> pa.Table:
        return _resolve(rows, part)

    def apply(rows: pa.Table, answers: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        sorted_docs, order = _sorted_docs(rows, doc_id, text)
        masks = {a["bucket"]: unpack(a["masks"]) for a in answers.to_pylist()}
        covered = _covered(Parse(sorted_docs, parts, hot), masks)
        spans, kept = [], []
        for (_, data), hit in zip(sorted_docs, covered, strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()
            runs = list(zip(edges[::2], edges[1::2], strict=True))
            spans.append([{"start": a, "end": b} for a, b in runs])
            kept.append(b"".join(data[a:b] for a, b in zip([0, *edges[1::2]], [*edges[::2], len(data)], strict=True)))
        taken = rows.select(given).take(pa.array(order, pa.int64()))
        columns = [pa.array([len(data) for _, data in sorted_docs], pa.int64()), pa.array(spans, _SPANS), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())]
        return pa.table([*taken.columns, *columns], names=[*given, *ADDED])

    bodies = dealt.groupBy(part).applyInArrow(dictionary, f"bucket int, `{part}` int, n int, body binary")
    answers = bodies.groupBy("bucket").applyInArrow(resolve, f"bucket int, `{part}` int, masks binary")
    return dealt.groupBy(part).cogroup(answers.groupBy(part)).applyInArrow(apply, out_schema)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with the removed bytes cut out of ``text``, and ``n_chars``, where it is a column,
    set to the new length. A character that lost some of its bytes goes entirely; documents
    of which nothing is left go too, but empty ones stay. All other columns are as they were."""
    renamed, names = set_aside(docs, ADDED)
    found = remove_repeats(renamed, names[doc_id], names[text], as_text=True)
    whole = F.size("removed") == 0
    columns = {c: F.col(f"`{name}`") for c, name in names.items()}
    columns[text] = F.when(whole, columns[text]).otherwise(F.col("kept"))
    if n_chars in columns:
        columns[n_chars] = F.when(whole, columns[n_chars]).otherwise(F.length("kept").cast(docs.schema[n_chars].dataType))
    return found.filter(whole | (F.col("kept") != "")).select(*[column.alias(c) for c, column in columns.items()])


def digests(docs: DataFrame) -> DataFrame:
    found = remove_repeats(docs.select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

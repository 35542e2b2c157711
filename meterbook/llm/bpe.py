"""Byte-level BPE encoding and decoding.

A text is cut by the pre-token pattern and each piece is merged separately, always the
lowest rank first and the leftmost pair among equals. The queue of possible merges is a
hierarchical bitmap: bucket ``r`` holds the positions (in the linked list of tokens) whose
pair has rank ``r``; one bit for each non-empty bucket sits in a 64-bit leaf word and one
bit for each non-empty leaf in the root word, so find-first-set on two words gives the next
rank. A merge leaves the old entries of its neighbours in their buckets; they are stale and
skipped when they surface. A piece of n bytes needs O(n) queue steps, however long it is.

Null texts encode as empty. Empty texts have no ids. Rows keep their order of columns;
repeated rows are encoded independently. Ids decode to the exact bytes of the text.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cached pieces of one Python worker; a full cache is emptied, which costs time only.
CACHE_PIECES = 400_000
#: Longer pieces are encoded each time they occur.
CACHE_PIECE_CHARS = 64
#: Characters of text whose pieces are looked up together.
BLOCK_CHARS = 4_000_000

#: The code points of the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def _members(letter: str, last: int) -> str:
    """The code points up to ``last`` whose general category starts with ``letter``, as the
    body of a character class."""
    out, start = [], None
    for code in range(last + 2):
        inside = code <= last and unicodedata.category(chr(code))[0] == letter
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=8)
def compiled(pattern: str, last: int = sys.maxunicode) -> re.Pattern:
    r"""``pattern`` with ``\p{L}``, ``\p{N}``, ``\s`` and ``\S`` spelled out as character
    classes, so that the standard library's faster matcher can run it on texts whose code
    points are at most ``last``."""
    bodies = {r"\p{L}": _members("L", last), r"\p{N}": _members("N", last), r"\s": WHITE_SPACE}
    out, inside, at = [], False, 0
    while at < len(pattern):
        name = next((n for n in bodies if pattern.startswith(n, at)), None)
        if name:
            out.append(bodies[name] if inside else f"[{bodies[name]}]")
            at += len(name)
        elif pattern.startswith(r"\S", at):
            out.append(f"[^{WHITE_SPACE}]")
            at += 2
        else:
            step = 2 if pattern[at] == "\\" else 1
            inside = pattern[at] == "[" or (inside and pattern[at] != "]")
            out.append(pattern[at : at + step])
            at += step
    return re.compile("".join(out))


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64-bytes rank``."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class RankQueue:
    """Buckets of positions by merge rank under a two-level bitmap of the non-empty ones."""

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.leaves: dict[int, int] = {}
        self.root = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.leaves[word] = self.leaves.get(word, 0) | 1 << (rank & 63)
        self.root |= 1 << word

    def lowest(self) -> int:
        """The lowest rank with a non-empty bucket, by find-first-set in root and leaf."""
        word = (self.root & -self.root).bit_length() - 1
        leaf = self.leaves[word]
        return (word << 6) + (leaf & -leaf).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """Empty the bucket of ``rank`` and clear its bit."""
        word = rank >> 6
        leaf = self.leaves[word] & ~(1 << (rank & 63))
        self.leaves[word] = leaf
        if not leaf:
            self.root &= ~(1 << word)
        return self.buckets.pop(rank)


class Codec:
    """Encoder and decoder of one vocabulary (token id = merge rank; every single byte is a
    token). Its cache of short pieces is bounded and shared by the tasks of a Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = pattern
        self.cache: dict[str, bytes] = {}
        self.wall = max(ranks.values(), default=-1) + 1  # a token that merges with nothing
        self.vocabulary = [b""] * self.wall
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        merges = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    merges[left * (self.wall + 1) + right] = rank
        self.pair_keys = np.array(sorted(merges), np.int64)
        self.pair_ranks = np.array([merges[k] for k in self.pair_keys.tolist()], np.int64)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of tokens, -1 for none."""
        keys = left * (self.wall + 1) + right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge_one(self, piece: bytes) -> bytes:
        """The ids of one pre-token of any length, merge by merge."""
        get, n, queue = self.ranks.get, len(piece), RankQueue()
        whole = get(piece)
        if whole is not None:
            return np.array([whole], "<i4").tobytes()
        following = list(range(1, n + 1))  # start of the next token, n at the end
        previous = list(range(-1, n))
        pair = [-1] * n  # rank of the pair that starts here now
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                pair[i] = rank
                queue.push(rank, i)
        while queue.root:
            rank = queue.lowest()
            bucket = queue.buckets[rank]
            i = heappop(bucket)
            if not bucket:
                queue.take(rank)
            if pair[i] != rank:
                continue  # stale
            middle = following[i]
            after = following[i] = following[middle]
            previous[after] = i
            pair[middle] = pair[i] = -1
            starts = [(previous[i], after)] if i else []
            if after < n:
                starts.append((i, following[after]))
            for start, end in starts:
                rank = get(piece[start:end])
                pair[start] = -1 if rank is None else rank
                if rank is not None:
                    queue.push(rank, start)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : following[i]]])
            i = following[i]
        return np.array(ids, "<i4").tobytes()

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of many short pre-tokens with one queue for all: each step takes the bucket
        of the lowest rank and merges the leftmost live pair of every piece in it."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        starts = np.cumsum(lengths + 1) - lengths  # a wall stands before each piece, and at the end
        total = int(lengths.sum()) + len(pieces) + 1
        raw = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
        token = self.byte[raw]
        token[starts - 1] = token[-1] = self.wall
        owner = np.repeat(np.arange(len(pieces) + 1), np.append(lengths + 1, 1))
        following = np.arange(1, total + 1)
        previous = np.arange(-1, total)
        pair = np.append(self._pair_ranks(token[:-1], token[1:]), -1)
        queue = RankQueue()
        live = np.flatnonzero(pair >= 0)
        order = live[np.argsort(pair[live], kind="stable")]
        ranks, first = np.unique(pair[order], return_index=True)
        for rank, positions in zip(ranks.tolist(), np.split(order, first[1:]), strict=False):
            queue.push(rank, -1)
            queue.buckets[rank] = positions.tolist()
        while queue.root:
            rank = queue.lowest()
            at = np.array(queue.take(rank))
            at = at[pair[at] == rank]  # others are stale
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                whose = owner[at]
                leftmost = np.append(True, whose[1:] != whose[:-1])
                for position in at[~leftmost].tolist():
                    queue.push(rank, position)
                at = at[leftmost]
            middle = following[at]
            after = following[middle]
            following[at] = after
            previous[after] = at
            token[at] = rank
            pair[middle] = token[middle] = -1
            left = np.concatenate([previous[at], at])
            right = np.concatenate([at, after])
            new = self._pair_ranks(token[left], token[right])
            pair[left] = new
            for r, position in zip(new.tolist(), left.tolist(), strict=True):
                if r >= 0:
                    queue.push(r, position)
        kept = np.flatnonzero((token >= 0) & (token != self.wall))
        ids = token[kept].astype("<i4")
        ends = np.searchsorted(kept, starts + lengths).tolist()
        data, out, begin = ids.tobytes(), [], 0
        for end in ends:
            out.append(data[4 * begin : 4 * end])
            begin = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        split = [compiled(self.pattern, 0xFFFF if len(t.encode("utf-16-le")) == 2 * len(t) else sys.maxunicode).findall(t) for t in texts]
        get = self.cache.get
        found = [list(map(get, pieces)) for pieces in split]
        missing = {p for pieces, ids in zip(split, found, strict=True) if None in ids for p, i in zip(pieces, ids, strict=True) if i is None}
        if missing:
            short = [p for p in missing if len(p) <= CACHE_PIECE_CHARS]
            ready = dict(zip(short, self.merge_many([p.encode() for p in short]), strict=True)) if short else {}
            long = {p: self.merge_one(p.encode()) for p in missing if len(p) > CACHE_PIECE_CHARS}
            for pieces, ids in zip(split, found, strict=True):
                if None in ids:
                    ids[:] = [i if i is not None else ready.get(p) or long[p] for p, i in zip(pieces, ids, strict=True)]
            if len(self.cache) + len(ready) > CACHE_PIECES:
                self.cache.clear()
            self.cache.update(ready)
        return [b"".join(ids) for ids in found]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(load_ranks(path), pattern)


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of a column, null as empty, some million characters at a time, and where
    they begin."""
    block, size, begin = [], 0, 0
    for k, x in enumerate(column):
        block.append(x.as_py() or "")
        size += len(block[-1])
        if size >= BLOCK_CHARS or k == len(column) - 1:
            yield begin, block
            block, size, begin = [], 0, k + 1


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the column ``text`` replaced by ``ids``, an array of token ids, and on
    request by ``decoded``, the bytes which those ids decode to, in the same pass.

    The vocabulary file must be readable at ``path`` on every executor. No shuffle."""
    new = [ids] + [decoded] * bool(decoded)
    kept = [c for c in docs.columns if c not in (text, *new)]
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded or "", T.BinaryType(), False)]
    schema = T.StructType([docs.schema[c] for c in kept] + fields[: len(new)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path, pattern)
        for batch in it:
            for begin, texts in _blocks(batch.column(text)):
                parts = one.encode(texts)
                ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
                values = np.frombuffer(b"".join(parts), "<i4")
                columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))]
                if decoded:
                    columns.append(pa.array([one.decode(np.frombuffer(p, "<i4").tolist()) for p in parts], pa.binary()))
                mine = batch.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([*(mine.column(c) for c in kept), *columns], names=[*kept, *new])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes that ``ids`` stand for in a new binary column ``decoded``
    (null ids: empty). No shuffle."""
    kept = [c for c in tokens.columns if c != decoded]
    schema = T.StructType([tokens.schema[c] for c in kept] + [T.StructField(decoded, T.BinaryType(), False)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path, pattern)
        for batch in it:
            column = pa.array([one.decode(x.as_py() or []) for x in batch.column(ids)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), column], names=[*kept, decoded])

    return tokens.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: number of ids, digest of the ids in decimal, digest of what they decode to."""
    tokens = encode(docs.select(doc_id, text), path, pattern, text, decoded="decoded")
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokens.select(F.col(doc_id).alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

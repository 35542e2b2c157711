"""Product codes of vectors by Lloyd's rounds over cover trees.

Components become integers, a vector is cut into equal parts, and each part position has a
codebook of a few entries. All distances, sums and means are exact integers, so the result
does not depend on how the rows are spread.

Each block of rows gets a cover tree for each part position, built once and written to the
shared folder. A node is a point; the nodes below it lie within half the radius at which it was
made for every level that they are lower, and nodes made under one parent at one radius are
farther than it from each other. Nodes are stored in depth-first order, so what is below a node
is a range, and its count and its sum are differences of cumulative counts and sums. In a round
a node knows its distances to all entries and the greatest distance r to a node below: if
the nearest entry's distance plus r is less than the second's minus r, the triangle inequality
gives the whole range to the nearest. Only nodes where it does not are assigned by their own exact
distances, and their children looked at. Equal parts of a block are one node with a count.

A round is one pass over the trees; what leaves a task is a count and a sum for each entry. The
driver holds the codebooks (parts * entries * components numbers) and nothing of the rows.

Rows: a null vector, or one with a null or non-finite component, is dropped. The smallest vec_ids
give the first entries: null ids come last, equal ids in the order of their vectors; with fewer
rows than entries the codebooks are as long as there are rows. Repeated rows count each. The
dimension is that of the smallest of these rows whose length is a positive multiple of the
parts; vectors of another length have no code and no error (null) and take no part in the rounds.
A component so large that squared distances could leave 64 bits is an error. Null labels are one
label; other columns, whatever their names, are not read. A table without rows gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.llm.common import written

#: Rows, and components in all, of one block, hence of one set of trees.
BLOCK_ROWS, BLOCK_VALUES = 4096, 1 << 21
TREES = "vec_ids array<long>, labels array<string>, trees array<binary>"
SUMS = "part int, entry int, at int, total decimal(38,0)"


def _squares(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all of a few others."""
    reach = int(max(np.abs(points).max(initial=0), np.abs(others).max(initial=0)))
    kind = np.float64 if points.shape[1] * (2 * reach + 1) ** 2 < 1 << 53 else np.int64  # both exact
    p, o = points.astype(kind), others.astype(kind)
    return (np.einsum("ij,ij->i", p, p)[:, None] - 2 * (p @ o.T) + np.einsum("ij,ij->i", o, o)).astype(np.int64)


def _gaps(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances row by row."""
    gap = points - others
    return np.einsum("ij,ij->i", gap, gap)


class CoverTree:
    """A cover tree of integer points, its nodes in depth-first order."""

    def __init__(self, points: np.ndarray, weight: np.ndarray, size: np.ndarray, radius: np.ndarray, parent: np.ndarray, of: np.ndarray):
        self.points, self.weight, self.size, self.radius, self.parent, self.of = points, weight, size, radius, parent, of
        zero = np.zeros((1, points.shape[1]), np.int64)
        self.count_before = np.concatenate([[0], np.cumsum(weight)])
        self.sum_before = np.concatenate([zero, np.cumsum(points * weight[:, None], axis=0)])
        depth = np.zeros(len(points), np.int64)
        for k, p in enumerate(parent.tolist()):
            if p >= 0:
                depth[k] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)

    @classmethod
    def build(cls, rows: np.ndarray) -> CoverTree:
        points, of, weight = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        n = len(points)
        parent, radius, made = np.full(n, -1), np.zeros(n), [0]
        owner, away = np.zeros(n, np.int64), np.sqrt(_gaps(points, points[:1]))
        radius[0] = away.max()
        pending, reach = np.arange(1, n), radius[0]
        while len(pending):
            reach /= 2
            near = away[pending] <= reach
            stay, rest = [pending[near]], pending[~near]
            rest = rest[np.argsort(owner[rest], kind="stable")]
            above = owner[rest]
            while len(rest):  # the first of the rest of each ball leads what is near it
                first = np.concatenate([[True], above[1:] != above[:-1]])
                leader = rest[first][np.cumsum(first) - 1]
                gap = np.sqrt(_gaps(points[rest], points[leader]))
                mine = gap <= reach
                parent[rest[first]] = above[first]
                radius[rest[first]] = np.maximum.reduceat(np.where(mine, gap, 0), np.flatnonzero(first))
                owner[rest[mine]], away[rest[mine]] = leader[mine], gap[mine]
                made += rest[first].tolist()
                stay.append(rest[mine & ~first])
                rest, above = rest[~mine], above[~mine]
            pending = np.concatenate(stay)
        size, up = [1] * n, parent.tolist()
        for k in reversed(made[1:]):
            size[up[k]] += size[k]
        at, free = [0] * n, [0] * n  # the place of a node, and the next free one below it
        free[0] = 1
        for k in made[1:]:
            at[k] = free[up[k]]
            free[up[k]] += size[k]
            free[k] = at[k] + 1
        at, order = np.array(at), np.empty(n, np.int64)
        order[at] = np.arange(n)
        up = np.where(parent[order] >= 0, at[parent[order]], -1)
        return cls(points[order].astype(np.int64), weight[order], np.array(size)[order], radius[order], up, at[of.reshape(-1)])

    def dump(self) -> bytes:
        n, d = self.points.shape
        arrays = (self.points.astype("<i4"), self.weight.astype("<i4"), self.size.astype("<i4"), self.radius.astype("<f8"), self.parent.astype("<i4"), self.of.astype("<i4"))
        return np.array([n, d, len(self.of)], "<i8").tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def load(cls, data: bytes) -> CoverTree:
        n, d, rows = np.frombuffer(data, "<i8", 3).tolist()
        at, out = 24, []
        for kind, count in (("<i4", n * d), ("<i4", n), ("<i4", n), ("<f8", n), ("<i4", n), ("<i4", rows)):
            out.append(np.frombuffer(data, kind, count, at).astype(np.float64 if kind == "<f8" else np.int64))
            at += out[-1].size * np.dtype(kind).itemsize
        return cls(out[0].reshape(n, d), *out[1:])

    def ranges(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Disjoint ranges of nodes (first, end) that hold all, and the nearest entry of each."""
        again = [k for k in range(len(entries)) if (entries[:k] == entries[k]).all(axis=1).any()]  # equal to one before
        opened = np.zeros(len(self.points) + 1, bool)
        opened[-1] = True  # the parent -1 of the root
        found = []
        for level in self.levels:
            nodes = level[opened[self.parent[level]]]
            if not len(nodes):
                break
            squares = _squares(self.points[nodes], entries)
            squares[:, again] = np.iinfo(np.int64).max
            best = squares.argmin(axis=1)
            if len(entries) - len(again) > 1:
                two = np.sqrt(np.partition(squares, 1, axis=1)[:, :2].astype(np.float64))
                reach = self.radius[nodes]
                # rounding is far below this margin; a node that fails by it is looked into, no more
                sure = two[:, 0] + reach < two[:, 1] - reach - 1e-9 * (two[:, 1] + reach)
            else:
                sure = np.ones(len(nodes), bool)
            opened[nodes[~sure]] = True
            found.append((nodes, np.where(sure, nodes + self.size[nodes], nodes + 1), best))
        first, end, best = (np.concatenate(x) for x in zip(*found, strict=True))
        return first, end, best

    def sums(self, entries: np.ndarray) -> np.ndarray:
        """For each entry: how many rows are nearest to it, and their sum."""
        first, end, best = self.ranges(entries)
        out = np.zeros((len(entries), 1 + self.points.shape[1]), np.int64)
        np.add.at(out, best, np.column_stack([self.count_before[end] - self.count_before[first], self.sum_before[end] - self.sum_before[first]]))
        return out

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the nearest entry and the squared distance to it."""
        first, end, best = self.ranges(entries)
        order = np.argsort(first)
        code = np.repeat(best[order], (end - first)[order])
        return code[self.of], _gaps(self.points, entries[code])[self.of]


def _limit(dims: int) -> int:
    """The greatest component with which a vector's error and a distance fit in 64 bits."""
    return (isqrt(((1 << 63) - 1) // max(dims, 1)) - 1) // 2


def plant(vectors: DataFrame, dims: int, parts: int, scale: int) -> DataFrame:
    """Write the trees of ``vectors`` (vec_id, label, vector), block by block where the rows are."""
    limit = min(_limit(dims), (1 << 31) - 1)
    block = max(1, min(BLOCK_ROWS, BLOCK_VALUES // dims))

    def trees(ids: list, labels: list, rows: np.ndarray) -> pa.RecordBatch:
        whole = np.floor(rows * scale)
        if np.abs(whole).max(initial=0) > limit:
            raise ValueError(f"a component over {limit / scale:g} with {dims} dimensions: squared distances could leave 64 bits")
        whole = whole.astype(np.int64).reshape(len(rows), parts, -1)
        packed = [CoverTree.build(np.ascontiguousarray(whole[:, k])).dump() for k in range(parts)]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())), pa.array([packed], pa.list_(pa.binary()))], ["vec_ids", "labels", "trees"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows, held = [], [], [], 0
        for batch in it:
            for at in range(0, batch.num_rows, block):
                piece = batch.slice(at, block)
                ids += piece.column(0).to_pylist()
                labels += piece.column(1).to_pylist()
                rows.append(piece.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(piece.num_rows, dims))
                held += piece.num_rows
                if held >= block:
                    whole = np.concatenate(rows)
                    yield trees(ids[:block], labels[:block], whole[:block])
                    ids, labels, rows, held = ids[block:], labels[block:], [whole[block:]], held - block
        if held:
            yield trees(ids, labels, np.concatenate(rows))

    return written(vectors.mapInArrow(run, TREES), "vector-trees")


def rounds(trees: DataFrame, codebooks: np.ndarray, count: int) -> np.ndarray:
    """The codebooks (parts x entries x components) after ``count`` rounds."""
    for _ in range(count):
        books = codebooks

        def run(it: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            totals = np.zeros((books.shape[0], books.shape[1], 1 + books.shape[2]), object)
            for batch in it:
                for packed in batch.column(0):
                    for k, data in enumerate(packed):
                        totals[k] += CoverTree.load(data.as_py()).sums(books[k])
            part, entry, at = (x.ravel() for x in np.indices(totals.shape))
            keep = totals.ravel() != 0
            values = pa.array([int(x) for x in totals.ravel()[keep]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(part[keep], pa.int32()), pa.array(entry[keep], pa.int32()), pa.array(at[keep], pa.int32()), values], ["part", "entry", "at", "total"])

        sums = trees.select("trees").mapInArrow(run, SUMS).groupBy("part", "entry", "at").agg(F.sum("total").alias("total"))
        totals = np.zeros((books.shape[0], books.shape[1], 1 + books.shape[2]), object)
        for part, entry, at, total in sums.collect():  # as many rows as the codebooks have numbers
            totals[part, entry, at] = int(total)
        codebooks = books.copy()
        for part, entry in zip(*np.nonzero(totals[:, :, 0]), strict=True):
            codebooks[part, entry] = [int(x) // int(totals[part, entry, 0]) for x in totals[part, entry, 1:]]
    return codebooks


def coded(trees: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Each row of the trees: vec_id, label, ``code`` and ``error``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexes = np.array([f"{k:02x}" for k in range(codebooks.shape[1])], object)
        for batch in it:
            for row in range(batch.num_rows):
                ids, labels, packed = (batch.column(c)[row].values for c in range(3))
                code, error = np.full(len(ids), "", object), np.zeros(len(ids), np.int64)
                for k, data in enumerate(packed):
                    entry, square = CoverTree.load(data.as_py()).codes(codebooks[k])
                    code, error = code + hexes[entry], error + square
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return trees.mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, count: int = 6, scale: int = 4096, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Of each kept row vec_id, label, code (two hex digits a part, so at most 256 entries) and
    error, and the codebooks that decode them."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    rows = rows.filter(F.col("vector").isNotNull() & finite).withColumn("dims", F.size("vector"))
    usable = rows.filter((F.col("dims") > 0) & (F.col("dims") % parts == 0))
    by = (F.col("vec_id").asc_nulls_last(), F.col("whole").asc())
    whole = F.transform("vector", lambda x: F.floor(x * scale).cast("long"))
    first = usable.withColumn("whole", whole).orderBy(*by).limit(1).select("dims").collect()
    if not first:
        return _uncoded(rows), np.zeros((parts, 0, 0), np.int64)
    dims = first[0].dims
    mine = usable.filter(F.col("dims") == dims)
    smallest = [r.whole for r in mine.withColumn("whole", whole).orderBy(*by).limit(entries).select("whole").collect()]
    codebooks = np.array(smallest, np.int64).reshape(len(smallest), parts, -1).transpose(1, 0, 2)
    trees = plant(mine.select("vec_id", "label", "vector"), dims, parts, scale)
    codebooks = rounds(trees, np.ascontiguousarray(codebooks), count)
    return coded(trees, codebooks).unionByName(_uncoded(rows.filter(F.col("dims") != dims))), codebooks


def _uncoded(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))


def digests(vectors: DataFrame) -> DataFrame:
    """Per kept row: vec_id, code, error, the error summed over its label, and the digest of the
    codebooks."""
    rows, codebooks = compress(vectors)
    rows = written(rows, "vector-codes")
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

"""Documents packed into as few fixed-length sequences as can be found.

A document's token ids are cut into pieces of the sequence length only if there are more; the
last piece may be shorter. Pieces of full length are sequences of their own. The others are dealt
by a hash of their key into blocks of about ``BLOCK`` pieces, and each block is packed by a
grouping genetic algorithm whose genes are whole sequences: crossover injects well-filled
sequences of one parent into the other, drops the other's sequences that hold a piece twice, and
best-fits the pieces that lost their place, longest first; mutation does so with its emptiest
sequences and a few others. Several islands evolve a block, each a task's row of its own, and
after each epoch an island's elite moves to the next one. A block is done when an individual
reaches a lower bound for its pieces, or when an epoch brought no island forward. The first
individual is best fit in descending order; blocks where it reaches the bound need no islands.

A block leaves a part of a sequence empty, so the emptiest sequences of all blocks are opened
again, dealt into new blocks and packed anew, level by level, until one block is left or nothing
is won; a level's result is kept only if it has fewer sequences than were opened.

No task holds more than one block at a time (pieces as a key and a length), no group is hot (keys are unique)
and the driver sees counts only. Each level and epoch is a written table, so lost executors
repeat at most one of them.

Rows: null text is empty; a document without ids (possible only without an end id) has no piece.
Repeated rows and repeated or null doc_ids are documents of their own: pieces carry a key. A
sequence's id is the smallest key in it; its pieces stand in the order of their keys, without
gaps. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator
from operator import attrgetter, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.llm.common import written
from meterbook.llm.token_files import encoded

#: Pieces of one block.
BLOCK = 2000
ISLANDS, POPULATION, ELITE, GENERATIONS, EPOCHS = 3, 8, 2, 10, 4
#: Blocks (or islands) of one task.
ROWS = 32
#: Of the room that a block leaves empty, the share in the sequences that are opened again.
OPENED = 0.9

PIECES = "key long, doc_id long, piece int, start long, length long, ids_crc32 long"
Sequence = list[int]


def pieces(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """The pieces of every document, on request with their ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 40
        for batch, flat, counts in encoded(it, tokenizer, end_id):
            ends = np.cumsum(counts)
            n = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), n)
            number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = number * capacity
            length = np.minimum(counts[row] - start, capacity)
            at = (ends - counts)[row] + start
            whole = memoryview(flat.astype("<u4")).cast("B")
            crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            columns = [pa.array(key + np.arange(len(row))), batch.column(0).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if ids:
                cuts = np.append(at, ends[-1] if len(ends) else 0)
                columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat.astype(np.int32))))
            key += len(row)
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, PIECES + ", ids array<int>" * ids)


def bound(lengths: list[int], capacity: int) -> int:
    """A lower bound of the sequences: by the sum, by how many pieces over a capacity's k-th can
    share one, and by what pieces over half leave for those over a threshold."""
    x = np.sort(np.array(lengths, np.int64))
    n, before = len(x), np.concatenate([[0], np.cumsum(x)])
    best = -(-int(x.sum()) // capacity)
    for k in range(1, 17):
        best = max(best, -(-(n - int(np.searchsorted(x, capacity // (k + 1), "right"))) // k))
    half = int(np.searchsorted(x, capacity // 2, "right"))
    for least in np.unique(x[:half]).tolist():
        low, high = int(np.searchsorted(x, least, "left")), int(np.searchsorted(x, capacity - least, "right"))
        # pieces over capacity - least stand alone; those from half up to it have room for small ones
        room = (high - half) * capacity - int(before[high] - before[half])
        best = max(best, n - half + max(0, -(-(int(before[half] - before[low]) - room) // capacity)))
    return best


class Filled(list):
    """A sequence that knows its fill. Individuals share it, so it never changes once it is in one."""

    __slots__ = ("fill",)


_FILL = attrgetter("fill")


class Block:
    """The packing problem of one block, and individuals as lists of sequences of places."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity, self.bound = lengths, capacity, bound(lengths, capacity)

    def filled(self, individual: list[Sequence]) -> list[Filled]:
        """The individual with the fill of each sequence."""
        out = []
        for s in individual:
            if type(s) is not Filled:
                s = Filled(s)
                s.fill = sum(map(self.lengths.__getitem__, s))
            out.append(s)
        return out

    def worth(self, individual: list[Sequence]) -> tuple[int, int]:
        """Fewer sequences first, then the one with fuller and emptier sequences."""
        return len(individual), -sum(s.fill * s.fill for s in self.filled(individual))

    def best_fit(self, individual: list[Sequence], loose: Sequence) -> list[Sequence]:
        """Put each loose piece, longest first, where it leaves the least room."""
        out = self.filled(individual)
        holders: dict[int, list[int]] = {}
        for k, s in enumerate(out):
            holders.setdefault(self.capacity - s.fill, []).append(k)
        rooms = 0  # one bit for each amount of room that some sequence has
        for room in holders:
            rooms |= 1 << room
        own: dict[int, Filled] = {}
        for p in sorted(loose, key=self.lengths.__getitem__, reverse=True):
            length = self.lengths[p]
            enough = rooms >> length
            if enough:
                room = length + (enough & -enough).bit_length() - 1
                k = holders[room].pop()
                if not holders[room]:
                    rooms ^= 1 << room
                s = own.get(k)
                if s is None:
                    own[k] = out[k] = s = Filled(out[k])
                s.append(p)
            else:
                room, k = self.capacity, len(out)
                own[k] = s = Filled([p])
                out.append(s)
            room -= length
            s.fill = self.capacity - room
            holders.setdefault(room, []).append(k)
            rooms |= 1 << room
        return out

    def crossed(self, one: list[Sequence], other: list[Sequence], rng: random.Random) -> list[Sequence]:
        """``one`` with well-filled sequences of ``other`` injected."""
        one = self.filled(one)
        full = sorted(self.filled(other), key=_FILL, reverse=True)[: max(1, len(other) // 2)]
        injected = rng.sample(full, rng.randint(1, max(1, len(full) // 2)))
        held = {p for s in injected for p in s}
        kept = [s for s in one if held.isdisjoint(s)]
        loose = [p for s in one if not held.isdisjoint(s) for p in s if p not in held]
        return self.best_fit(kept + injected, loose)

    def mutated(self, one: list[Sequence], rng: random.Random) -> list[Sequence]:
        """``one`` with its emptiest sequences, and a few others, packed again."""
        one = self.filled(one)
        by_fill = sorted(one, key=_FILL)
        n = max(1, min(len(one), 2 + len(one) // 20))
        out = by_fill[:n] + rng.sample(by_fill[n:], min(n, len(one) - n))
        gone = {id(s) for s in out}
        loose = [p for s in out for p in s]
        rng.shuffle(loose)
        kept = [s for s in one if id(s) not in gone]
        first = loose[: len(loose) // 2]
        return self.best_fit(self.best_fit(kept, first), loose[len(first) :])

    def evolved(self, population: list[list[Sequence]], rng: random.Random) -> list[list[Sequence]]:
        """An epoch of an island: generations until one individual reaches the bound."""
        everything = list(range(len(self.lengths)))
        while len(population) < POPULATION:
            some = rng.sample(everything, len(everything) // 2)
            chosen = set(some)
            population.append(self.best_fit(self.best_fit([], some), [p for p in everything if p not in chosen]))
        ranked = sorted(((self.worth(x), x) for x in map(self.filled, population)), key=itemgetter(0))[:POPULATION]
        for _ in range(GENERATIONS):
            population = [x for _, x in ranked]
            if len(population[0]) <= self.bound:
                break
            children = []
            for _ in range(POPULATION // 2):
                a, b = (min(rng.sample(range(len(population)), 2)) for _ in range(2))
                child = self.crossed(population[a], population[b], rng)
                children.append(self.mutated(child, rng) if rng.random() < 0.5 else child)
            ranked = sorted([*ranked, *((self.worth(x), x) for x in children)], key=itemgetter(0))[:POPULATION]
        return [x for _, x in ranked]


def _dump(individual: list[Sequence], n: int) -> bytes:
    of = np.zeros(n, "<i4")
    for k, s in enumerate(individual):
        of[s] = k
    return of.tobytes()


def _load(data: bytes) -> list[Sequence]:
    out: dict[int, Sequence] = {}
    for p, k in enumerate(np.frombuffer(data, "<i4").tolist()):
        out.setdefault(k, []).append(p)
    return list(out.values())


_BLOCKS = "block long, keys array<long>, lengths array<int>, best binary, n int, least int"
_ISLANDS = "block long, island int, lengths array<int>, population array<binary>, n int, least int"


def _blocks(free: DataFrame, n_blocks: int, capacity: int, level: int) -> DataFrame:
    """The pieces (key, length) dealt into blocks, each with its best fit in descending order."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["key"].to_numpy())
        keys, lengths = table["key"].to_numpy()[order], table["length"].to_numpy()[order].tolist()
        block = Block(lengths, capacity)
        best = block.best_fit([], list(range(len(lengths))))
        row = {"block": table["block"][0].as_py(), "keys": keys.tolist(), "lengths": lengths, "best": _dump(best, len(lengths)), "n": len(best), "least": block.bound}
        return pa.Table.from_pylist([row], schema=_schema(_BLOCKS))

    dealt = free.select(F.pmod(F.xxhash64("key", F.lit(level)), F.lit(n_blocks)).alias("block"), "key", F.col("length").cast("int").alias("length"))
    return dealt.groupBy("block").applyInArrow(run, _BLOCKS)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def _epoch(islands: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """Evolve every island (block, island, lengths, population, guests) for an epoch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                block = Block(row["lengths"], capacity)
                start = [_load(x) for x in [*row["population"], *(row["guests"] or [])]]
                population = block.evolved(start, random.Random(f"{row['block']}/{row['island']}/{epoch}"))
                out = {"block": row["block"], "island": row["island"], "lengths": row["lengths"], "population": [_dump(x, len(row["lengths"])) for x in population], "n": len(population[0]), "least": block.bound}
                yield pa.RecordBatch.from_pylist([out], schema=_schema(_ISLANDS))

    return islands.select("block", "island", "lengths", "population", "guests").mapInArrow(run, _ISLANDS)


def _packed(blocks: DataFrame, capacity: int) -> DataFrame:
    """The blocks with the best individual that the islands find."""
    waiting = blocks.filter("n > least")
    if not (n_waiting := waiting.count()):
        return blocks
    tasks = math.ceil(n_waiting * ISLANDS / ROWS)
    found = waiting.select("block", "best", "n")
    islands = waiting.select("block", "lengths", F.array("best").alias("population"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.lit(None).cast("array<binary>").alias("guests"))
    for epoch in range(EPOCHS):
        state = written(_epoch(islands.repartition(tasks, "block", "island"), capacity, epoch), f"packing-islands-{epoch}")
        new = state.groupBy("block").agg(F.max_by(F.element_at("population", 1), F.struct(-F.col("n"), -F.col("island"))).alias("new"), F.min("n").alias("new_n"), F.max("least").alias("least"))
        won = F.coalesce(F.col("new_n") < F.col("n"), F.lit(False))
        # every block gets a first migration; later ones only after an epoch that won a sequence
        goes = (F.col("new_n") > F.col("least")) & (won | F.lit(epoch == 0))
        found = found.join(new, "block", "left").select("block", F.when(won, F.col("new")).otherwise(F.col("best")).alias("best"), F.when(won, F.col("new_n")).otherwise(F.col("n")).alias("n"), F.coalesce(goes, F.lit(False)).alias("goes"))
        found = written(found, f"packing-found-{epoch}")
        going = found.filter("goes").select("block")
        if epoch == EPOCHS - 1 or going.isEmpty():
            break
        guests = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("population", 1, ELITE).alias("guests"))
        islands = state.join(going, "block", "left_semi").join(guests, ["block", "island"])
        found = found.drop("goes")
    known = found.select("block", F.col("best").alias("found"))
    return blocks.join(known, "block", "left").select("block", "keys", "lengths", F.coalesce("found", "best").alias("best"))


def _placed(blocks: DataFrame, n_blocks: int, capacity: int) -> DataFrame:
    """Each piece of the blocks: key, length, sequence_id, offset, and whether its sequence is one of
    the emptiest, which hold most of the room that its block leaves."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in range(batch.num_rows):
                keys, lengths = (batch.column(c)[row].values.to_numpy().astype(np.int64) for c in (0, 1))
                of = np.frombuffer(batch.column(2)[row].as_py(), "<i4").astype(np.int64)
                order = np.argsort(of, kind="stable")  # keys ascend within a sequence
                size, start = lengths[order], np.concatenate([[True], np.diff(of[order]) != 0])
                total = np.cumsum(size) - size
                first = np.flatnonzero(start)
                number = np.cumsum(start) - 1
                room = capacity - np.add.reduceat(size, first)
                emptiest = np.argsort(-room, kind="stable")
                opened = np.zeros(len(room), bool)
                n = 1 + int(np.searchsorted(np.cumsum(room[emptiest]), OPENED * room.sum()))
                opened[emptiest[: min(n, max(1, len(room) // 2))]] = True
                columns = [keys[order], size, keys[order][first][number], total - total[first][number], (opened & (room > 0))[number]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "length", "sequence_id", "offset", "opened"])

    tasks = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_blocks / ROWS))
    return blocks.repartition(tasks, "block").select("keys", "lengths", "best").mapInArrow(run, "key long, length long, sequence_id long, offset long, opened boolean")


def pack(free: DataFrame, capacity: int) -> DataFrame:
    """Place pieces (key, length; lengths from 1 to ``capacity``, keys unique) in sequences: key,
    ``sequence_id`` and ``offset``."""
    whole = free.filter(F.col("length") == capacity).select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    free = free.filter(F.col("length") < capacity).select("key", "length")
    done, opened, level = [whole], None, 0
    while (n := free.count()) > 0:
        n_blocks = math.ceil(n / BLOCK)
        blocks = written(_blocks(free, n_blocks, capacity, level), f"packing-blocks-{level}")
        placed = written(_placed(_packed(blocks, capacity), n_blocks, capacity), f"packing-placed-{level}")
        if opened is not None and _sequences(placed) >= _sequences(opened):
            break  # packing them again won nothing: they stay where they were
        done.append(placed.filter("not opened"))
        opened, level = placed.filter("opened"), level + 1
        if n_blocks == 1:
            break
        free = opened.select("key", "length")
    if opened is not None:
        done.append(opened)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more.select("key", "sequence_id", "offset"))
    return out


def _sequences(placed: DataFrame) -> int:
    return placed.filter("offset = 0").count()


def packed(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id and offset,
    on request with its ids."""
    cut = written(pieces(docs, tokenizer, end_id, capacity, doc_id, text, ids), "packing-pieces")
    return cut.join(pack(cut.select("key", "length"), capacity), "key").drop("key")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id`` and ``ids``, from :func:`packed` with ids.
    A group is at most a sequence long."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import AWKWARD, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meterbook.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def cut(text, capacity, end=1):
    ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end]
    return [(k, at, ids[at : at + capacity]) for k, at in enumerate(range(0, len(ids), capacity))]


def held(rows, capacity):
    """Check that sequences are gapless and not too long; how many there are."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_pieces_and_places(spark, capacity):
    texts = [*AWKWARD, AWKWARD[13], "repeated row", "repeated row"]
    ids = [*range(len(AWKWARD)), 3, 40, 40]
    ids[5] = None
    rows = packing.packed(documents(spark, texts, ids), PATH, 1, capacity).collect()
    want = [(i, k, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in zip(ids, texts, strict=True) for k, at, x in cut(t, capacity)]
    assert sorted((r[:5] for r in map(tuple, rows)), key=repr) == sorted(want, key=repr)
    assert held(rows, capacity) == packing.bound([r.length for r in rows], capacity)


def test_sequences_hold_the_ids(spark):
    texts = [*AWKWARD, " ".join(map(str, range(3000)))]
    placed = packing.packed(documents(spark, texts), PATH, 1, 512, ids=True)
    rows = placed.collect()
    sequences = {r.sequence_id: r.ids for r in packing.sequences(placed).collect()}
    of = {(i, k): x for i, t in enumerate(texts) for k, _, x in cut(t, 512)}
    for r in rows:
        assert sequences[r.sequence_id][r.offset : r.offset + r.length] == of[r.doc_id, r.piece]
    assert sum(map(len, sequences.values())) == sum(map(len, of.values()))


def test_empty_tables(spark):
    assert packing.packed(documents(spark, []), PATH, 1, 64).collect() == []
    assert packing.packed(documents(spark, [None, ""]), PATH, None, 64).collect() == []


def lengths_table(spark, lengths):
    return spark.createDataFrame(list(enumerate(lengths)), "key long, length long")


def count(spark, lengths, capacity):
    table = lengths_table(spark, lengths)
    rows = packing.pack(table, capacity).join(table, "key").collect()
    assert sorted(r.key for r in rows) == list(range(len(lengths)))
    return held(rows, capacity)


def test_levels_join_what_blocks_leave(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 40)
    rng = random.Random(3)
    lengths = [rng.randint(1, 60) for _ in range(900)] + [100] * 20
    n = count(spark, lengths, 100)
    assert packing.bound(lengths, 100) <= n <= packing.bound(lengths, 100) + 1


def test_islands_win_what_best_fit_leaves(spark):
    rng = random.Random(1)
    lengths = []  # triples that fill a sequence exactly
    for _ in range(30):
        a, b = rng.randint(260, 380), rng.randint(260, 380)
        lengths += [a, b, 1000 - a - b]
    first = len(packing.Block(lengths, 1000).best_fit([], list(range(90))))
    assert 30 <= count(spark, lengths, 1000) < first


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40), st.integers(0, 99))
def test_individuals_stay_whole(lengths, seed):
    rng, block = random.Random(seed), packing.Block(lengths, 30)
    one = block.best_fit([], list(range(len(lengths))))
    other = packing._load(packing._dump([[k] for k in range(len(lengths))], len(lengths)))
    for new in [one, block.crossed(one, other, rng), block.crossed(other, one, rng), block.mutated(one, rng), *block.evolved([one, other], rng)]:
        assert sorted(p for s in new for p in s) == list(range(len(lengths)))
        assert all(sum(lengths[p] for p in s) <= 30 for s in new) and len(new) >= block.bound


def test_what_stays_in_place_is_not_summed_again():
    class Read(list):
        n = 0

        def __getitem__(self, k):
            Read.n += 1
            return super().__getitem__(k)

    rng = random.Random(2)
    block = packing.Block(Read(rng.randint(1, 30) for _ in range(300)), 100)
    one = block.best_fit([], list(range(290)))
    whole, Read.n = [s[:] for s in one], 0
    new = block.best_fit(one, list(range(290, 300)))
    block.worth(new), block.worth(one)
    assert Read.n <= 20  # ten pieces, sorted and placed
    assert one == whole and sorted(p for s in new for p in s) == list(range(300))
    assert [s.fill for s in new] == [sum(block.lengths[p] for p in s) for s in new]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_bound_never_exceeds_the_optimum(lengths):
    def fewest(rest, rooms):
        if not rest:
            return len(rooms)
        best = fewest(rest[1:], [*rooms, 12 - rest[0]])
        for k, room in enumerate(rooms):
            if room >= rest[0]:
                best = min(best, fewest(rest[1:], [*rooms[:k], room - rest[0], *rooms[k + 1 :]]))
        return best

    assert packing.bound(lengths, 12) <= fewest(lengths, [])

import random

import numpy as np
import pytest
from brute import AWKWARD, PASSAGE, contamination, documents, sha

from meterbook.llm import decontam

BENCH = "item_id long, text string"


def items(spark, rows):
    return spark.createDataFrame(rows, BENCH)


def test_index_finds_all_occurrences():
    rng = random.Random(8)
    for alphabet, size in ((2, 300), (5, 800), (60, 500), (1, 40)):
        text = np.array([rng.randint(1, alphabet) for _ in range(size)])
        index = decontam.FMIndex(text)
        patterns = [[rng.randint(1, alphabet + 1) for _ in range(rng.randint(1, 4))] for _ in range(60)] + [text[5:9].tolist(), text[-3:].tolist(), text[:4].tolist()]
        padded = np.zeros((len(patterns), 4), np.int64)
        for k, p in enumerate(patterns):
            padded[k, 4 - len(p) :] = p
        low, high = index.search(padded, np.array([len(p) for p in patterns]))
        for p, a, b in zip(patterns, low.tolist(), high.tolist(), strict=True):
            want = [k for k in range(size - len(p) + 1) if text[k : k + len(p)].tolist() == p]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_wavelet_matrix():
    rng = random.Random(9)
    sequence = np.array([rng.randint(0, 20) for _ in range(200)])
    tree = decontam.WaveletMatrix(sequence)
    assert tree.access(np.arange(200)).tolist() == sequence.tolist()
    for symbol in (0, 3, 20, 25, 40):
        ends = np.arange(201)
        assert tree.rank(np.full(201, symbol), ends).tolist() == [int((sequence[:e] == symbol).sum()) for e in range(201)]


def test_suffix_order():
    rng = random.Random(10)
    text = np.array([rng.randint(1, 3) for _ in range(300)] + [0])
    assert decontam.suffix_order(text).tolist() == sorted(range(301), key=lambda k: text[k:].tolist())


LONG = " ".join(f"w{k}" for k in range(60))
ITEMS = [(1, LONG), (2, "Just Five words, no more!"), (3, PASSAGE), (10, PASSAGE), (4, None), (5, "  .,;"), (6, "one"), (2, "another text of the same item")]
TEXTS = [
    *AWKWARD,
    LONG,
    " ".join(LONG.split()[10:25]),
    "filler " * 300 + " ".join(LONG.split()[3:16]) + " filler",
    "filler " * 200 + " ".join(LONG.split()[3:15]),
    "just FIVE words no more",
    "just five words no just five words no more just five words no more",
    "one",
    "none one-one",
    PASSAGE.upper() + " " + LONG,
    "another text of the same item and just five words no more",
]


def check(spark, texts, bench):
    rows = decontam.judged(decontam.occurrences(documents(spark, texts), items(spark, bench))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n_words, hit, found = contamination(texts[r.doc_id], [b for b in bench if b[1]])
        assert (r.n_words, r.items, r.n_hit, r.contaminated) == (n_words, found, len(hit), len(hit) > 0 and 20 * len(hit) >= n_words), texts[r.doc_id]
        assert [w for s in r.spans for w in range(s.start, s.end)] == hit
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_occurrences(spark):
    check(spark, TEXTS, ITEMS)


def test_only_long_items(spark):
    check(spark, TEXTS, [i for i in ITEMS if i[0] in (1, 3, 10)])


@pytest.mark.parametrize("size", [40, 200])
def test_benchmark_in_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
    check(spark, TEXTS, ITEMS)


def test_random_texts(spark):
    rng = random.Random(11)
    words = ["a", "b", "c", "d"]
    bench = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 20)))) for k in range(15)]
    texts = [" ".join(rng.choice([*words, "x"]) for _ in range(rng.randint(0, 120))) + " " + (bench[k % 15][1] if k % 3 else "") for k in range(60)]
    check(spark, texts, bench)


def test_shards_within_a_batch():
    queries = decontam.Windows([(1, LONG.encode())], 13)
    counts, spans, found = decontam._search([LONG.encode(), b"", LONG.encode()[:40], LONG.encode()], queries)
    assert counts == [60, 0, len(LONG[:40].split()), 60]
    assert spans == [[(0, 60)], [], [], [(0, 60)]] and found == [[1], [], [], [1]]


def test_digest_and_clean(spark):
    docs = documents(spark, [LONG, "clean words only", None]).withColumnRenamed("lang", "spans").withColumnRenamed("source", "items")
    bench = items(spark, ITEMS).withColumnRenamed("item_id", "item_id")
    rows = {r.doc_id: r for r in decontam.digests(docs, bench).collect()}
    assert rows[0].items_sha256 == sha("1") and rows[0].n_items == 1 and rows[0].contaminated
    assert rows[1].items_sha256 == sha("") and not rows[1].contaminated and rows[2].n_words == 0
    kept = decontam.clean(documents(spark, [LONG, "clean words only", None]), bench)
    assert kept.columns == documents(spark, []).columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_empty_tables(spark):
    assert decontam.digests(documents(spark, []), items(spark, ITEMS)).count() == 0
    assert [r.n_hit for r in decontam.digests(documents(spark, [LONG]), items(spark, [])).collect()] == [0]


def test_blocks_are_bounded_whatever_repeats(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1000)
    rows = [(7, "one text that many rows repeat")] * 300 + [(k, f"item number {k} of the benchmark") for k in range(100)] + [(k, None) for k in range(5)]
    blocks = list(decontam._blocks(items(spark, rows).repartition(5), "item_id", "text"))
    assert sorted(x for b in blocks for x in b) == sorted({(i, t.encode()) for i, t in rows if t})
    assert len(blocks) > 2 and all(sum(len(t) for _, t in b) <= 1000 for b in blocks)


def test_each_block_is_sent_before_the_next_is_read(spark, monkeypatch):
    events = []

    def blocks(*args):
        for k in range(3):
            events.append("read")
            yield [(k, "w1 w2".encode())]

    monkeypatch.setattr(decontam, "_blocks", blocks)
    context = type(spark.sparkContext)
    monkeypatch.setattr(context, "broadcast", lambda self, value, f=context.broadcast: (events.append("sent"), f(self, value))[1])
    decontam.occurrences(documents(spark, ["w1 w2"]), items(spark, ITEMS))
    assert events == ["read", "sent"] * 3


def test_columns_that_differ_in_case(spark):
    docs = documents(spark, [PASSAGE, None, "some words of its own"])
    docs = docs.selectExpr("doc_id", "text", "lang AS N_Words", "source AS Items", "n_chars AS `n_hit`", "lang AS CONTAMINATED")
    kept = decontam.clean(docs, items(spark, [(1, PASSAGE)]))
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(1, None, "en", "src0", None, "en"), (2, "some words of its own", "en", "src0", 21, "en")]
    found = decontam.judged(decontam.occurrences(docs, items(spark, [(1, PASSAGE)])))
    assert sorted(found.columns) == ["contaminated", "doc_id", "items", "n_hit", "n_words", "spans", "text"] and found.filter("contaminated").count() == 1

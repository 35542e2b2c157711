import random

import numpy as np
from brute import AWKWARD, DOCUMENTS, PASSAGE, documents, repeats, sha

from meterbook.llm import suffix_dedup


def check(spark, docs):
    """(doc_id, bytes as text) against brute force."""
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCUMENTS)
    want = repeats([(i, (t or "").encode()) for i, t in docs])
    rows = suffix_dedup.remove_repeats(frame).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans, kept = want[r.doc_id]
        assert ([(s.start, s.end) for s in r.removed], bytes(r.kept)) == (spans, kept), r.doc_id


def test_awkward_documents(spark):
    check(spark, list(enumerate(AWKWARD)))


def test_random_repeats(spark):
    rng = random.Random(6)
    pool = ["".join(rng.choice("abé ") for _ in range(rng.randint(20, 140))) for _ in range(12)]
    docs = [(k, "".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for k in rng.sample(range(1000), 60)]
    check(spark, docs)


def test_low_entropy(spark):
    check(spark, [(1, "a" * 200), (2, "a" * 120), (3, "ab" * 90), (4, "ab" * 40), (5, "Ea " * 50 + "x" + "Ea " * 30)])


def test_pieces_of_a_long_document(spark, monkeypatch):
    parse = suffix_dedup.Parse([(1, PASSAGE.encode() * 40), (2, b"short"), (3, b"y" + PASSAGE.encode() * 2)], 7)
    whole = {(int(d), int(a) + k) for doc, start, n, _ in parse for d, a, c in zip(doc, start, n, strict=True) for k in range(c)}
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 100)
    again = suffix_dedup.Parse(parse.docs, 7)
    cut = [(int(d), int(a) + k) for doc, start, n, _ in again for d, a, c in zip(doc, start, n, strict=True) for k in range(c)]
    assert sorted(cut) == sorted(whole) == [(k, w) for k, (_, t) in enumerate(parse.docs) for w in range(len(t) - 49)]


def test_suffix_ranks_to_depth():
    rng = random.Random(7)
    data = bytes(rng.choice(b"ab") for _ in range(3000)) + b"abc" * 200
    ranks = suffix_dedup._ranks(np.frombuffer(data, np.uint8))
    windows = [data[k : k + 50] for k in range(len(data) - 49)]
    order = sorted(set(windows))
    place = {w: k for k, w in enumerate(order)}
    by_rank = {}
    for k, w in enumerate(windows):
        assert by_rank.setdefault(int(ranks[k]), w) == w
    assert [place[by_rank[r]] for r in sorted(by_rank)] == list(range(len(order)))


def test_same_and_null_ids_do_not_cover_each_other(spark):
    frame = spark.createDataFrame([(1, PASSAGE, "a", "s", 1), (1, PASSAGE, "b", "s", 1), (None, PASSAGE, "c", "s", 1)], DOCUMENTS)
    rows = {r.lang: r for r in suffix_dedup.remove_repeats(frame).collect()}
    assert not rows["a"].removed and not rows["b"].removed
    assert [(s.start, s.end) for s in rows["c"].removed] == [(0, len(PASSAGE))]


def test_cut_texts_and_clashing_columns(spark):
    docs = documents(spark, [PASSAGE, "Before. " + PASSAGE, PASSAGE, "", None, "é" + PASSAGE[:-1] + "é"])
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {0: (PASSAGE, len(PASSAGE)), 1: ("Before. ", 8), 3: ("", 0), 4: (None, None), 5: ("éé", 2)}
    clash = documents(spark, [PASSAGE, PASSAGE]).withColumnRenamed("lang", "part").withColumnRenamed("source", "kept")
    assert suffix_dedup.remove_repeats(clash).columns == ["doc_id", "text", "part", "n_chars", "n_bytes", "removed", "kept"]
    assert suffix_dedup.remove_repeats(clash).count() == 2
    assert suffix_dedup.digests(documents(spark, [])).count() == 0


def test_a_character_cut_in_half_goes(spark):
    # both texts share the bytes from the middle of a character on
    shared = PASSAGE[:60]
    docs = documents(spark, ["é" + shared, "ũ" + shared])  # c3 a9, c5 a9
    rows = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs).collect()}
    assert rows == {0: "é" + shared}


def test_digest_columns(spark):
    rows = {r.doc_id: r for r in suffix_dedup.digests(documents(spark, [PASSAGE, "Before. " + PASSAGE])).collect()}
    assert (rows[1].n_bytes, rows[1].n_removed, rows[1].n_spans) == (len(PASSAGE) + 8, len(PASSAGE) + 1 - 1, 1)
    assert rows[1].kept_sha256 == sha("Before. ")


def hot_docs():
    """Many different phrases of one trigger, some with one of its sides in common."""
    rng = random.Random(11)
    near = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    one, two = near(60), near(60)
    return [(k, near(rng.randint(0, 40)) + rng.choice([one[-rng.randint(20, 60) :], near(40)]) + "qzjxvwkq" + rng.choice([two[: rng.randint(20, 60)], near(40)]) + near(rng.randint(0, 40))) for k in rng.sample(range(1000), 150)]


def test_hot_triggers_and_halves_travel_in_units_without_loss(spark, monkeypatch):
    for limit in (0, 3, 12, 40):
        monkeypatch.setattr(suffix_dedup, "HOT", limit)
        check(spark, hot_docs())
        check(spark, list(enumerate(AWKWARD[:-2])))


def test_phrases_of_a_hot_trigger_are_dealt_to_many_buckets():
    docs = [(k, t.encode()) for k, t in hot_docs()]
    counts = suffix_dedup.Parse(docs, 16).counted()
    parse = suffix_dedup.Parse(docs, 16, np.flatnonzero(counts > 12))
    for _ in parse:
        pass
    units = suffix_dedup.Units(parse)
    assert max(np.bincount(parse.bucket)) > 3 * len(parse.phrases) / 16
    assert max(len(x) for _, x in units.by_bucket()) < 2 * len(units.texts) / 16
    windows = [(k, start + w) for k, start, n, _ in units.pieces for w in range(n)]
    assert len(windows) == len(set(windows)) == sum(len(t) - 49 for k, t in enumerate(parse.phrases) if k in set(parse.hot_phrases))


def test_hot_cells_are_found_over_all_tasks(spark, monkeypatch):
    docs = hot_docs()
    counts = suffix_dedup.Parse([(k, t.encode()) for k, t in docs], 8).counted()
    frame = documents(spark, [t for _, t in docs]).repartition(7)
    n_bytes = sum(len(t) for _, t in docs)
    for limit in (0, 10, 30):
        monkeypatch.setattr(suffix_dedup, "HOT", limit)
        found = suffix_dedup._hot(frame, "text", 8, n_bytes)
        assert set(np.flatnonzero(counts > limit)) <= set(found) <= set(np.flatnonzero(counts > limit / 2))


def test_rows_of_one_doc_id_are_dealt_to_many_parts(spark, monkeypatch, tmp_path):
    def dictionary(rows, *args, made=suffix_dedup._dictionary):
        with open(f"{tmp_path}/sizes", "a") as f:
            f.write(f"{rows.num_rows}\n")
        return made(rows, *args)

    monkeypatch.setattr(suffix_dedup, "_dictionary", dictionary)
    frame = documents(spark, [f"{k} {PASSAGE} {k}" for k in range(80)], [None] * 40 + [3] * 40)
    rows = suffix_dedup.remove_repeats(frame).collect()
    with open(f"{tmp_path}/sizes") as f:
        assert max(int(x) for x in f) < 30
    # a null doc_id is the largest: its rows lose what those of doc_id 3 hold
    assert all(bool(r.removed) == (r.doc_id is None) for r in rows)


def test_columns_that_differ_in_case(spark):
    frame = documents(spark, [PASSAGE, PASSAGE, "its own text", None]).selectExpr("doc_id", "text", "lang AS Removed", "source AS KEPT", "n_chars AS n_bytes", "lang AS Part", "n_chars")
    out = suffix_dedup.without_repeats(frame)
    assert out.columns == frame.columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, frame.filter("doc_id <> 1").collect()))
    found = suffix_dedup.remove_repeats(frame)
    assert found.columns == ["doc_id", "text", "Part", "n_chars", "n_bytes", "removed", "kept"]
    assert {r.doc_id: bytes(r.kept) for r in found.collect()} == {0: PASSAGE.encode(), 1: b"", 2: b"its own text", 3: b""}

import random

import numpy as np
from brute import AWKWARD, documents, fingerprint, groups

from meterbook.llm import simhash


def signed(x):
    return int(np.uint64(x).view(np.int64))


def near(rng, x, bits):
    for b in rng.sample(range(64), rng.randint(0, bits)):
        x ^= 1 << b
    return x


def random_prints(n_single=200, n_groups=10, hot=700):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(n_single)} | {0, 7, (1 << 64) - 1}
    for _ in range(n_groups):
        centre = rng.getrandbits(64)
        prints |= {near(rng, centre, 4) for _ in range(20)}
    centre = rng.getrandbits(64)
    prints |= {near(rng, centre, 4) for _ in range(hot)}
    return sorted(prints)


def partition(prints, root):
    out = {}
    for p in prints:
        out.setdefault(root.get(p, p), set()).add(p)
    return sorted(map(sorted, out.values()))


def check_links(spark, prints):
    rows = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.links(rows)).collect()}
    want = {p: prints[g] for p, g in zip(prints, groups(prints), strict=True)}
    assert partition(prints, found) == partition(prints, want)


def test_links_connect_like_all_pairs(spark):
    check_links(spark, random_prints())


def test_hot_lists_are_dealt_anew_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIST_ROWS", 12)
    check_links(spark, random_prints(50, 3, 300))


def test_every_pair_within_three_bits_is_retained():
    rng = random.Random(4)
    a = np.array([rng.getrandbits(64) for _ in range(4000)], np.uint64)
    b = np.array([near(rng, int(x), 6) for x in a], np.uint64)
    kept, _ = simhash._retained(a, b, 3)
    assert kept.tolist() == [(int(x) ^ int(y)).bit_count() <= 3 for x, y in zip(a, b, strict=True)]


def test_spanning_equals_brute_force():
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = sorted({near(rng, centre, 5) for _ in range(1300)})
    a, b = simhash._spanning(np.array(prints, np.uint64), 3)
    index = {p: k for k, p in enumerate(prints)}
    root = {int(y): int(x) for x, y in zip(a, b, strict=True)}
    want = groups(prints)
    assert partition(prints, root) == partition(prints, {p: prints[want[index[p]]] for p in prints})


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert simhash.components(edges.limit(0)).count() == 0


def test_awkward_documents(spark):
    texts = [*AWKWARD, AWKWARD[-1], AWKWARD[6] + " x", None, ""]
    ids = [10 * k for k in range(len(AWKWARD))] + [5, 6, 7, None]
    rows = simhash.digests(documents(spark, texts, ids)).collect()
    prints = [fingerprint(t) for t in texts]
    root = groups(prints)
    smallest = {}
    for i, g in zip(ids, root, strict=True):
        if i is not None:
            smallest[g] = min(i, smallest.get(g, i))
    want = [(i, f"{p:016x}", smallest[g]) for i, p, g in zip(ids, prints, root, strict=True)]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_representatives_keep_one_of_each_group_and_all_columns(spark):
    docs = documents(spark, ["one two three four"] * 3 + ["something else entirely here", None, ""]).withColumnRenamed("source", "fp").withColumnRenamed("lang", "component_id")
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4]
    assert simhash.representatives(documents(spark, [])).count() == 0


def test_representatives_are_one_row_of_each_group(spark):
    near, other = "one two three four", "something else entirely here"
    rows = [(None, near), (None, "alone and without a number"), (None, None), (4, ""), (7, other), (7, other), (8, other), (9, "first of two with one number"), (9, "second text, another group"), (5, near), (None, "twice without number"), (None, "twice without number")]
    kept = simhash.representatives(documents(spark, [t for _, t in rows], [i for i, _ in rows]).withColumnRenamed("lang", "row"))
    want = [(4, ""), (5, near), (7, other), (9, "first of two with one number"), (9, "second text, another group"), (None, "alone and without a number"), (None, "twice without number")]
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted(want, key=repr)
    langs = documents(spark, [near] * 3, [3, 3, 3], ["en", None, "fr"])
    assert simhash.representatives(langs).count() == 1


def test_of_one_doc_id_with_near_texts_one_row_stays(spark):
    copies = documents(spark, ["Same  words here", "same words HERE", None], [1, 1, 2])
    assert sorted(r.doc_id for r in simhash.representatives(copies).collect()) == [1, 2]

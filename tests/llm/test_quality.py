import random

import numpy as np
from brute import AWKWARD, documents

from meterbook.llm import quality


def plain_counts(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(w for w in __import__("re").split(r"[\x20\x09-\x0D]+", line)):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_counts_equal_brute_force():
    rng = random.Random(14)
    texts = [t or "" for t in AWKWARD if not t or len(t) < 3000]
    texts += ["".join(rng.choice("ab# \n\t\x0b\x1c\u2003é&") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for text in texts:
        assert quality.counts(text.encode())[:5] == plain_counts(text), repr(text)


def test_decision_list_learns_a_planted_rule():
    rng = np.random.default_rng(15)
    rows = rng.random((6000, len(quality.FEATURES)))
    bad = (rows[:, 1] > 0.8) & (rows[:, 4] < 0.5) | (rows[:, 6] > 0.95)
    rules = quality.decision_list(rows, bad, np.arange(6000) % 3 == 0)
    test = rng.random((4000, len(quality.FEATURES)))
    truth = (test[:, 1] > 0.8) & (test[:, 4] < 0.5) | (test[:, 6] > 0.95)
    dropped = np.zeros(4000, bool)
    for rule in rules:
        dropped |= quality._covered(rule, test)
    assert (dropped == truth).mean() > 0.98
    assert (dropped & ~truth).sum() < 0.05 * truth.sum()


def test_noise_gives_no_rules():
    rng = np.random.default_rng(16)
    rows = rng.random((3000, len(quality.FEATURES)))
    assert quality.decision_list(rows, rng.random(3000) < 0.1, np.arange(3000) % 3 == 0) == []
    assert quality.decision_list(rows[:0], np.zeros(0, bool), np.zeros(0, bool)) == []
    assert quality.decision_list(rows, np.zeros(3000, bool), np.arange(3000) % 3 == 0) == []


def labelled(spark, n=300):
    rng = random.Random(17)
    texts, marks = [], []
    for k in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(40)]
        bad = k % 5 == 0
        texts.append(" ".join(w + "#%&"[rng.randint(0, 2)] * 3 if bad else w for w in words) + ".")
        marks.append((k, 0 if bad else 1))
    return texts, marks


def test_held_out_accuracy(spark):
    texts, marks = labelled(spark)
    labels = spark.createDataFrame([m for m in marks if m[0] % 2] + [m for m in marks if m[0] % 4 == 0], "doc_id long, quality int")
    rows = quality.judge(documents(spark, texts), labels).collect()
    unseen = [r for r in rows if r.doc_id % 4 == 2]
    assert all(r.kept == bool(dict(marks)[r.doc_id]) for r in unseen)


def test_awkward_documents_and_labels(spark):
    labels = spark.createDataFrame([(0, 0), (None, 1), (1, None), (6, 1), (6, 0), (999, 0)], "doc_id long, quality int")
    docs = documents(spark, [*AWKWARD, AWKWARD[-1]], [*range(len(AWKWARD)), 3]).withColumnRenamed("lang", "n_words").withColumnRenamed("source", "kept")
    rows = quality.digests(docs, labels).collect()
    assert len(rows) == len(AWKWARD) + 1
    for r in rows[: len(AWKWARD)]:
        text = AWKWARD[r.doc_id] or ""
        if len(text) < 3000 and r.doc_id != 3:
            n, chars, symbols, dup, repeat = plain_counts(text)
            assert tuple(r)[1:6] == (n, chars, symbols, dup, repeat)
            assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert r.kept == (not r.base_failed)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.digests(documents(spark, []), none).count() == 0
    assert [r.kept for r in quality.digests(documents(spark, ["one two three four five six seven eight nine ten"]), none).collect()] == [True]


def test_columns_that_differ_in_case(spark):
    docs = documents(spark, ["a few words " * 9, None]).withColumnsRenamed({"lang": "N_WORDS", "source": "Kept", "n_chars": "h"})
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    found = quality.judge(docs, labels)
    assert sorted(c for c in found.columns if c.lower() in ("n_words", "kept")) == ["kept", "n_words"] and "h" in found.columns
    assert sorted((r.doc_id, r.n_words) for r in found.collect()) == [(0, 27), (1, 0)]

import zlib
from collections import Counter

import numpy as np
import pytest
from brute import AWKWARD, documents

from meterbook.llm import langid

EN = "the people of this town have always known that the old bridge would not last another winter without repair"
DE = "die leute dieser stadt haben immer gewusst dass die alte brücke keinen weiteren winter ohne reparatur überstehen würde"
FR = "les gens de cette ville ont toujours su que le vieux pont ne tiendrait pas un autre hiver sans réparation"


def plain_profile(texts, size=langid.PROFILE):
    """The most frequent n-grams by plain counting."""
    counts = Counter()
    for text in texts:
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            padded = f" {word} "
            counts.update(c for c in word)
            counts.update(padded[k : k + 2] for k in range(len(padded) - 1))
            counts.update(padded[k : k + 3] for k in range(len(padded) - 2))

    def code(gram):
        out = 0
        for c in gram:
            out = out << 21 | ord(c)
        return out

    return sorted((code(g) for g in counts), key=lambda g: (-dict((code(x), n) for x, n in counts.items())[g], g))[:size]


def test_profiles_equal_plain_counting():
    for text in (EN, DE, FR, "Ünïcödé 中文字 x", "a", "ab  cd--ef 12 é"):
        grams, counts = langid._counts(langid._characters(text))
        assert langid._top(grams, counts, 50).tolist() == plain_profile([text], 50)


def test_pieces_add_up(monkeypatch):
    characters = langid._characters(EN + " 7 " + DE)
    whole = langid._counts(characters)
    monkeypatch.setattr(langid, "PIECE", 10)
    parts = langid._counts(characters)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def test_distance_equals_plain():
    profiles = [(n, plain_profile([t], 40)) for n, t in (("de", DE), ("en", EN), ("fr", FR))]
    model = langid.Profiles(profiles, 40)
    for text in (EN[:40], DE[20:70], FR[:30], "xyz", EN + DE):
        mine = plain_profile([text], 40)
        away = {n: sum(abs(p.index(g) - k) if g in p else 40 for k, g in enumerate(mine)) for n, p in profiles}
        best = min(away, key=lambda n: (away[n], n))
        assert model.predict(text) == (best, pytest.approx(1 - away[best] / (40 * len(mine))))


def corpus(n=60):
    """Sentences of shuffled words in three languages."""
    rng = np.random.default_rng(18)
    texts, langs = [], []
    for k in range(n):
        name, text = [("en", EN), ("de", DE), ("fr", FR)][k % 3]
        texts.append(" ".join(rng.permutation(text.split())[:12]))
        langs.append(name)
    return texts, langs


def test_learned_profiles_and_held_out_accuracy(spark):
    texts, langs = corpus()
    docs = documents(spark, texts, langs=langs)
    learned = dict(langid.learn(docs.filter(~langid.held_out())))
    out = {k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 5 == 0}
    for name in ("de", "en", "fr"):
        assert learned[name] == plain_profile([t for k, t in enumerate(texts) if langs[k] == name and k not in out])
    rows = langid.digests(docs).collect()
    assert {r.doc_id for r in rows if r.held_out} == out
    assert all(r.lang_pred == langs[r.doc_id] and 0 < r.score <= 1 for r in rows)


def test_awkward_documents(spark):
    texts, langs = corpus(30)
    docs = documents(spark, [*texts, *AWKWARD, "12 34 !!"], langs=[*langs, *[None] * len(AWKWARD), "en"])
    rows = {r.doc_id: r for r in langid.digests(docs.withColumnRenamed("source", "score")).collect()}
    for k, text in enumerate([*AWKWARD, "12 34 !!"], len(texts)):
        assert (rows[k].lang_pred == "und") == (not any(c.isalpha() for c in text or "")), text
    kept = langid.identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.lang_pred != "und"}


def test_nothing_to_learn_from(spark):
    assert langid.digests(documents(spark, [])).count() == 0
    rows = langid.digests(documents(spark, [EN, None], [None, 3], [None, None])).collect()
    assert {(r.lang_pred, r.score, r.held_out) for r in rows} == {("und", 0.0, False)} or all(r.lang_pred == "und" for r in rows)


def test_more_languages_than_a_block(spark, monkeypatch):
    texts, langs = corpus(60)
    docs = documents(spark, [*texts, *AWKWARD], langs=[*[f"{g}-{k % 7}" for k, g in enumerate(langs)], *[None] * len(AWKWARD)])
    whole = {r.doc_id: (r.lang_pred, r.score) for r in langid.digests(docs).collect()}
    assert len({name for name, _ in whole.values()}) > 4
    profiles = list(langid.learn(docs.filter(~langid.held_out())))
    monkeypatch.setattr(langid, "LANGUAGES", 4)
    monkeypatch.setattr(langid, "HELD", 100)
    assert list(langid.learn(docs.filter(~langid.held_out()))) == profiles and len(profiles) > 15
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.digests(docs).collect()} == whole


def test_five_thousand_labels(spark):
    names = [f"l{k:04d}" for k in range(5000)]
    docs = documents(spark, [f"{EN[k % 50 : k % 50 + 12]} {chr(0x4E00 + k) * 3}" for k in range(5000)], langs=names)
    rows = langid.digests(docs).collect()
    assert all(r.lang_pred == names[r.doc_id] and r.score == 1.0 for r in rows if not r.held_out)


def test_columns_that_differ_in_case_only(spark):
    texts, langs = corpus(30)
    docs = documents(spark, [*texts, None], langs=[*langs, None]).withColumnRenamed("source", "Lang_Pred").withColumnRenamed("n_chars", "SCORE")
    kept = langid.identified(docs)
    assert kept.columns == docs.columns and kept.count() == 30 and kept.first().Lang_Pred == "src0"
    assert langid.predict(docs, langid.learn(docs)).columns == ["doc_id", "text", "lang", "lang_pred", "score"]

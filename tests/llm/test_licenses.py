import random
from collections import Counter

import pytest
from brute import AWKWARD, documents

from meterbook.llm import licenses

MIT = licenses.TEMPLATES["MIT"]


def brute(text, templates, similarity):
    """The best run of lines for each template, without pruning."""
    lines = [(k, licenses.words(x.encode())) for k, x in enumerate((text or "").split("\n"))]
    lines = [(k, w) for k, w in lines if w]
    best = {}
    for a in range(len(lines)):
        for b in range(a, min(len(lines), a + 60)):
            words = [w for _, x in lines[a : b + 1] for w in x]
            bag = Counter(zip(words, words[1:], strict=False))
            for name, other in templates.items():
                theirs = licenses.words(other.encode())
                their_bag = Counter(zip(theirs, theirs[1:], strict=False))
                total = bag.total() + their_bag.total()
                score = 2 * (bag & their_bag).total() / total if total else 0.0
                ranked = (score, -a, -(b - a), b)
                if score >= similarity and ranked > best.get(name, (0.0,)):
                    best[name] = ranked
    return sorted((name, score, lines[-a][0], lines[b][0] + 1) for name, (score, a, _, b) in best.items())


def wrapped(text, width):
    words = text.split()
    return "\n".join(" ".join(words[k : k + width]) for k in range(0, len(words), width))


def cases():
    rng = random.Random(12)
    prose = "Ordinary words of a text that the reader may use, copy or keep without limit."
    out = [t or "" for t in AWKWARD if not t or len(t) < 4000]
    for text in licenses.TEMPLATES.values():
        words = text.split()
        out += [text, prose + "\n" + wrapped(text, 9) + "\n\n" + prose, " ".join(w for w in words if rng.random() > 0.05), " ".join(w if rng.random() > 0.25 else "zzz" for w in words)]
    out += [prose + "\nReleased under the MIT License.\n" + prose + "\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", MIT + " " + MIT, wrapped(MIT, 3) * 2]
    return out


@pytest.mark.parametrize("similarity", [0.8, 0.95])
def test_scan_equals_brute_force(similarity):
    scanner = licenses.Templates(licenses.TEMPLATES, similarity)
    found = 0
    for text in cases():
        got = scanner.scan(text.encode())
        assert got == brute(text, licenses.TEMPLATES, similarity), text
        found += bool(got)
    assert found > 30


def test_random_lines_equal_brute_force():
    rng = random.Random(13)
    templates = {"a": "x y z x y", "b": "y z", "c": "z z z y x y z"}
    scanner = licenses.Templates(templates, 0.8)
    for _ in range(300):
        text = "\n".join(" ".join(rng.choice("xyzw") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(0, 6)))
        assert scanner.scan(text.encode()) == brute(text, templates, 0.8), text


def test_documents(spark):
    texts = [*AWKWARD, "Some prose.\nReleased under the MIT License.", MIT.lower(), MIT + "\n" + MIT]
    docs = documents(spark, texts).withColumnRenamed("lang", "licenses").withColumnRenamed("source", "score")
    rows = {r.doc_id: r for r in licenses.digests(docs).collect()}
    n = len(AWKWARD)
    assert all(rows[k].n_licenses == 0 and rows[k].best is None and rows[k].score == 0.0 for k in range(n))
    assert (rows[n].licenses, rows[n].score) == ("MIT (line)", 1.0)
    assert (rows[n + 1].best, rows[n + 2].best) == ("MIT", "MIT")
    assert licenses.digests(documents(spark, [])).count() == 0
    assert licenses.scan(docs, {}).first().licenses == []


def brute_windows(text, templates, similarity):
    """The best window of words for each template, without pruning."""
    words = [(w, k) for k, x in enumerate(text.split("\n")) for w in licenses.words(x.encode())]
    best = {}
    for a in range(len(words)):
        for b in range(a + 2, len(words) + 1):
            part = [w for w, _ in words[a:b]]
            bag = Counter(zip(part, part[1:], strict=False))
            for name, other in templates.items():
                theirs = licenses.words(other.encode())
                their_bag = Counter(zip(theirs, theirs[1:], strict=False))
                score = 2 * (bag & their_bag).total() / (bag.total() + their_bag.total())
                ranked = (score, -a, -b)
                if score >= similarity and ranked > best.get(name, (0.0,)):
                    best[name] = ranked
    return sorted((name, score, words[-a][1], words[-b - 1][1] + 1) for name, (score, a, b) in best.items())


@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_windows_of_words_equal_brute_force(similarity):
    rng = random.Random(14)
    templates = {"a": "x y z x y", "b": "y z", "c": "z z z y x y z", "one word": "x", "d": "x x x x y"}
    scanner = licenses.Templates(templates, similarity)
    for _ in range(300):
        text = "\n".join(" ".join(rng.choice("xyzw") for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 4)))
        assert scanner.find(text.encode()) == brute_windows(text, templates, similarity), text


def test_windows_are_at_least_as_near_as_runs_of_lines():
    scanner = licenses.Templates(licenses.TEMPLATES, 0.8)
    for text in cases():
        runs, windows = ({x[0]: x[1] for x in f(text.encode())} for f in (scanner.scan, scanner.find))
        assert all(windows[name] >= score for name, score in runs.items())


def test_nearest_licence_wins_within_lines_and_among_versions(spark):
    full = {name: text for name, text in licenses.all_templates().items() if name != "Apache-2.0 (notice)"}  # holds the line, a tie
    prose = "Ordinary words before it on the same line, and more of them so that the line is mostly prose. "
    texts = {name: prose + " ".join(text.split()) + " " + prose for name, text in full.items()}
    rows = licenses.digests(documents(spark, list(texts.values()))).collect()
    assert {name: (r.best, r.score) for name, r in zip(texts, sorted(rows, key=lambda r: r.doc_id), strict=True)} == {name: (name, 1.0) for name in texts}
    some = ["This work is licensed under the GNU General Public License, version 2.", "Licensed under CC BY-SA 4.0.", "Licensed under the MIT License.", full["BSD-3-Clause"]]
    rows = sorted(licenses.digests(documents(spark, some)).collect(), key=lambda r: r.doc_id)
    assert [r.best for r in rows] == ["GPL-2.0 (line)", "CC-BY-SA-4.0 (line)", "MIT (line)", "BSD-3-Clause"]


def test_starts_stepped_over_lose_nothing():
    rng = random.Random(15)
    template = " ".join(rng.choice("abcdef") for _ in range(41))
    scanner = licenses.Templates({"t": template}, 0.6)
    found = 0
    for _ in range(40):
        part = [w if rng.random() > 0.15 else "z" for w in template.split()]
        noise = [rng.choice("abcdefz") for _ in range(rng.randint(0, 25))]
        text = " ".join(noise + part + noise[::-1] + part[: rng.randint(0, 41)])
        got = scanner.find(text.encode())
        assert got == brute_windows(text, {"t": template}, 0.6), text
        found += bool(got)
    assert found > 10


def best_windows(words, templates, similarity):
    """(-coefficient, -length, first word, name, last word) of each template's best window."""
    for name, other in templates.items():
        theirs = licenses.words(other.encode())
        their_bag = Counter(zip(theirs, theirs[1:], strict=False))
        ranked = []
        for a in range(len(words)):
            for b in range(a + 2, len(words) + 1):
                bag = Counter(zip(words[a:b], words[a + 1 : b], strict=False))
                score = 2 * (bag & their_bag).total() / (bag.total() + their_bag.total())
                if score >= similarity:
                    ranked.append((-score, a, b - 1))
        if ranked:
            score, a, b = min(ranked)
            yield score, a - b, a, name, b


def brute_nearest(words, templates, similarity, at=0):
    found = sorted(best_windows(words, templates, similarity))
    if not found:
        return []
    score, _, a, name, b = found[0]
    before, after = brute_nearest(words[:a], templates, similarity, at), brute_nearest(words[b + 1 :], templates, similarity, at + b + 1)
    return [(name, -score, at + a, at + b), *before, *after]


def test_nearest_assignment_equals_brute_force():
    rng = random.Random(16)
    templates = {"a": "x y z x y", "b": "y z", "c": "z z z y x y z", "d": "x x x x y"}
    scanner = licenses.Templates(templates, 0.6)
    for _ in range(150):
        words = [rng.choice("xyzw") for _ in range(rng.randint(0, 18))]
        best = {}
        for name, score, first, last in brute_nearest([w.encode() for w in words], templates, 0.6):
            best[name] = min(best.get(name, (0.0,)), (-score, first, last))
        # a word a line: lines are words
        assert scanner.nearest("\n".join(words).encode()) == [(name, -s, a, b + 1) for name, (s, a, b) in sorted(best.items())], words


def test_one_licence_for_a_line_and_for_a_full_text(spark):
    templates = licenses.all_templates()
    texts = ["This work is licensed under the GNU General Public License, version 3.", templates["GPL-3.0"], "Licensed under the MIT License.\nprose between them\nLicensed under CC BY-SA 4.0."]
    docs = documents(spark, texts).withColumnRenamed("source", "Licenses")
    rows = sorted(licenses.digests(docs).collect(), key=lambda r: r.doc_id)
    assert [r.licenses for r in rows] == ["GPL-3.0 (line)", "GPL-3.0", "CC-BY-SA-4.0 (line),MIT (line)"]
    assert licenses.scan(docs).columns == ["doc_id", "lang", "n_chars", "licenses"]

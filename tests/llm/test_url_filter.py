import numpy as np
import pytest

from meterbook.llm import url_filter

PAGES = "page_id long, url string"


def judged(spark, urls, listed=(), rules=url_filter.RULES):
    pages = spark.createDataFrame(list(enumerate(urls)), PAGES)
    blocked = spark.createDataFrame([(u,) for u in listed], "canonical string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, blocked, rules).collect()}


def test_rules(spark):
    cases = [
        ("https://Sub.Example.ORG/es/x", ("sub.example.org", "/es/x", "example.org/es/", "block")),
        ("http://example.org/en/123", ("example.org", "/en/123", "example.org/en/1", "block")),
        ("http://example.org/en/23", ("example.org", "/en/23", "org/", "allow")),
        ("http://example.org", ("example.org", "", None, "allow")),
        ("http://notexample.org/es/", ("notexample.org", "/es/", "org/", "allow")),
        ("ftp://a.com/fr/?q=/de/", ("a.com", "/fr/", "com/fr/", "allow")),
        ("ftp://a.com/de/#/fr/", ("a.com", "/de/", "com/de/", "block")),
        ("http://a.com?x=://b/c", ("a.com", "", None, "allow")),
        ("http://a.com#y/z", ("a.com", "", None, "allow")),
        ("http://ÀB.COM/Fr/", ("Àb.com", "/Fr/", None, "allow")),
        ("no scheme/es/", ("", "", None, "allow")),
        (None, ("", "", None, "allow")),
        ("", ("", "", None, "allow")),
        ("://org/x", ("org", "/x", "org/", "allow")),
        ("x://a\nb.org/p\nq?r", ("a\nb.org", "/p\nq", "org/", "allow")),
    ]
    got = judged(spark, [u for u, _ in cases])
    assert got == {k: v for k, (_, v) in enumerate(cases)}


def test_canonical(spark):
    same = ["http://WWW.a.net/x/", "https://a.net/x#top", "a://a.net:443/x?utm_source=feed", "https://a.net/x?ref=1&gclid=2", "http://a.net:80/x//"]
    other = ["https://a.net/X", "https://b.a.net/x", "https://a.net/x?page=2", "https://a.net:8080/x", "a.net/x"]
    got = judged(spark, same + other, ["a.net/x"], [])
    assert [got[k][3] for k in range(len(same))] == ["block"] * len(same)
    assert [got[len(same) + k][3] for k in range(len(other))] == ["allow"] * len(other)
    assert {v[3] for v in judged(spark, ["http://a.net/?b=2&a=1", "http://a.net?a=1&b=2"], ["a.net?a=1&b=2"], []).values()} == {"block"}


@pytest.mark.parametrize("blocks", [1, 1 << 17])
def test_exact_at_any_filter_size(spark, monkeypatch, blocks):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", blocks)
    urls = [f"http://h{k}.net/p" for k in range(3000)]
    listed = [f"h{k}.net/p" for k in range(0, 3000, 3)]
    got = judged(spark, urls, listed + listed[:5] + [None], [])
    assert [got[k][3] for k in range(3000)] == ["block" if k % 3 == 0 else "allow" for k in range(3000)]


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.createDataFrame([(f"h{k}.net/p",) for k in range(2000)], "canonical string")
    bloom = url_filter.bloom_filter(listed)
    assert bloom.shape == (47, 8) and bloom.dtype == np.uint64
    pages = spark.createDataFrame([(f"h{k}.net/p",) for k in range(20_000)] + [(None,)], "canonical_ string")
    rows = url_filter._probed(pages, bloom, "maybe").collect()
    assert all(r.maybe for r in rows[:2000]) and not rows[-1].maybe
    assert sum(r.maybe for r in rows[2000:]) < 0.03 * 18_000


def test_repeated_pages_clashing_columns_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "c", 1), (1, "http://a.net/x", "c", 1), (2, "http://a.net/y", "c", 1)], "page_id long, url string, host string, rule long")
    rows = url_filter.judge(pages, url_filter.repeated(pages), [])
    assert rows.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted((r.page_id, r.verdict) for r in rows.collect()) == [(1, "block"), (1, "block"), (2, "allow")]
    assert url_filter.digests(pages.limit(0)).count() == 0


def test_columns_that_clash_are_kept_or_replaced(spark):
    rows = [(1, "http://a.net/x", "c", "b", 5, True, "l", "H", "R"), (2, "http://b.net/x", "c", "b", 5, True, "l", "H", "R")]
    pages = spark.createDataFrame(rows, PAGES + ", Canonical_ string, block_ string, BITS_ long, maybe_ boolean, listed_ string, Host string, RULE string")
    found = url_filter.judge(pages, spark.createDataFrame([("a.net/x",)], "canonical string"), [])
    assert found.columns == ["page_id", "url", "Canonical_", "block_", "BITS_", "maybe_", "listed_", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, found.collect())) == [
        (1, "http://a.net/x", "c", "b", 5, True, "l", "a.net", "/x", None, "block"),
        (2, "http://b.net/x", "c", "b", 5, True, "l", "b.net", "/x", None, "allow"),
    ]

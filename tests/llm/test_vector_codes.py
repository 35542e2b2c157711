import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterbook.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, Code string, DIMS int, `of` string, vector int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, g, "x", 1, "y", 2) for i, v, g in rows], SCHEMA)


def brute(rows, parts=8, entries=16, count=6):
    rows = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [int(np.floor(4096 * float(np.float32(x)))) for x in v], g) for i, v, g in rows]
    usable = sorted((x for x in whole if x[1] and len(x[1]) % parts == 0), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    if not usable:
        return [(i, None, None, None, hashlib.sha256(b"").hexdigest()) for i, _, _ in whole]
    dims = len(usable[0][1])
    first = [v for _, v, _ in usable if len(v) == dims][:entries]
    d = dims // parts
    books = [[v[k * d : k * d + d] for v in first] for k in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))

    own = [v for _, v, _ in whole if len(v) == dims]
    for _ in range(count):
        for k in range(parts):
            groups = [[] for _ in books[k]]
            for v in own:
                x = v[k * d : k * d + d]
                groups[nearest(x, books[k])[1]].append(x)
            books[k] = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else e for g, e in zip(groups, books[k], strict=True)]
    out, by_label = [], {}
    for i, v, g in whole:
        if len(v) != dims:
            out.append((i, None, None, g))
            by_label.setdefault(g, None)
            continue
        found = [nearest(v[k * d : k * d + d], books[k]) for k in range(parts)]
        error = sum(x for x, _ in found)
        out.append((i, "".join(f"{j:02x}" for _, j in found), error, g))
        by_label[g] = (by_label.get(g) or 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, by_label[g], digest) for i, c, e, g in out]


def got(spark, rows):
    return sorted(map(tuple, vector_codes.digests(table(spark, rows)).collect()), key=repr)


def noise(n, dims, seed=0, spread=0.2):
    rng = np.random.default_rng(seed)
    return rng.normal(0, spread, (n, dims)).astype(np.float32).tolist()


def test_codes_equal_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 37)
    vectors = noise(150, 16)
    vectors += [vectors[3]] * 60 + [[float(np.float32(x)) for x in v] for v in noise(20, 16, 1, 0.001)]
    rows = [(7 * k % 1000, v, [None, 0, 1][k % 3]) for k, v in enumerate(vectors)]
    assert got(spark, rows) == sorted(brute(rows), key=repr)


def test_awkward_rows(spark):
    rows = [(k, v, 1) for k, v in enumerate(noise(20, 8))]
    rows += [(3, None, 1), (4, [1.0] * 7 + [None], 1), (5, [1.0] * 7 + [float("nan")], None), (6, [1.0] * 7 + [float("-inf")], 1)]
    rows += [(None, [0.5] * 8, None), (None, [0.5] * 8, 2), (2, [-0.0] * 8, 1), (2, [-0.0] * 8, 1), (100, [], 5), (101, [1.0] * 9, 5), (102, [1.0] * 16, 1), (-1, [0.1], 7)]
    assert got(spark, rows) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 2)], [(1, [0.25] * 8, None)], [(k, [0.5] * 8, 0) for k in range(40)]])
def test_small_tables(spark, rows):
    assert got(spark, rows) == sorted(brute(rows), key=repr)


def test_components_out_of_range_are_an_error(spark):
    with pytest.raises(Exception, match="could leave 64 bits"):
        vector_codes.digests(table(spark, [(1, [3e38] * 8, 1), (2, [0.0] * 8, 1)])).collect()


POINTS = st.lists(st.lists(st.integers(-6, 6), min_size=2, max_size=2), min_size=1, max_size=60)


@settings(max_examples=200, deadline=None)
@given(POINTS, st.lists(st.lists(st.integers(-6, 6), min_size=2, max_size=2), min_size=1, max_size=5))
def test_tree_assigns_as_plain_comparison(points, entries):
    points, entries = np.array(points), np.array(entries)
    tree = vector_codes.CoverTree.load(vector_codes.CoverTree.build(points).dump())
    squares = ((points[:, None] - entries) ** 2).sum(axis=2)
    want = squares.argmin(axis=1)
    code, error = tree.codes(entries)
    assert code.tolist() == want.tolist() and error.tolist() == squares.min(axis=1).tolist()
    sums = tree.sums(entries)
    for j in range(len(entries)):
        assert sums[j].tolist() == [(want == j).sum(), *points[want == j].sum(axis=0)]


@settings(max_examples=100, deadline=None)
@given(POINTS)
def test_tree_covers_and_separates(points):
    tree = vector_codes.CoverTree.build(np.array(points))
    assert tree.weight.sum() == len(points) and (tree.points[tree.of] == np.array(points)).all()
    for k in range(len(tree.points)):
        below = tree.points[k : k + tree.size[k]]
        assert np.sqrt(((below - tree.points[k]) ** 2).sum(axis=1)).max() <= tree.radius[k] + 1e-9
        children = [c for c in range(k + 1, k + tree.size[k]) if tree.parent[c] == k]
        assert 1 + sum(tree.size[c] for c in children) == tree.size[k]


def test_whole_ranges_are_assigned_at_once():
    rng = np.random.default_rng(5)
    centres = rng.integers(-9000, 9000, (8, 4))
    points = np.repeat(centres, 500, axis=0) + rng.integers(-40, 40, (4000, 4))
    tree = vector_codes.CoverTree.build(points)
    first, end, _ = tree.ranges(centres)
    assert (end - first).sum() == len(tree.points) and len(first) < 200

"""Exact comparison of a Spark result with a DuckDB result (names, types, row multiset)."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

SPARK_TO_DUCK = {
    "string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "date": "DATE",
    "boolean": "BOOLEAN", "decimal(38,12)": "DECIMAL(38,12)", "timestamp_ntz": "TIMESTAMP",
}


def norm(v):
    if isinstance(v, float):
        return ("f", v.hex())
    if isinstance(v, Decimal):
        return ("d", str(v))
    return (type(v).__name__, v)


def compare(spark_df, duck_rel) -> list[str]:
    """Problems found (empty when equal). Floats are compared bit for bit."""
    s_cols = [(f.name, f.dataType.simpleString()) for f in spark_df.schema.fields]
    s_rows = spark_df.collect()
    d_cols = list(zip(duck_rel.columns, [str(t) for t in duck_rel.types]))
    d_rows = duck_rel.fetchall()
    problems = []
    if sorted(c for c, _ in s_cols) != sorted(c for c, _ in d_cols):
        return [f"columns spark={sorted(c for c, _ in s_cols)} duck={sorted(c for c, _ in d_cols)}"]
    dmap = dict(d_cols)
    for c, t in s_cols:
        if SPARK_TO_DUCK.get(t, t.upper()) != dmap[c]:
            problems.append(f"type {c}: spark={t} duck={dmap[c]}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
        return problems
    order = sorted(c for c, _ in s_cols)
    sidx = [[c for c, _ in s_cols].index(c) for c in order]
    didx = [[c for c, _ in d_cols].index(c) for c in order]
    sc = Counter(tuple(norm(r[i]) for i in sidx) for r in s_rows)
    dc = Counter(tuple(norm(r[i]) for i in didx) for r in d_rows)
    if sc != dc:
        problems.append(
            f"values differ in {sum((sc - dc).values())} rows; spark-only {list((sc - dc).elements())[:2]}; "
            f"duck-only {list((dc - sc).elements())[:2]}"
        )
    return problems

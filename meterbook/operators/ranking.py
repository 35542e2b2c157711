"""Rankings: top customers by cost, and an exact top-k per group."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterbook.functions.numbers import amount, is_strict, money_sum, to_double
from meterbook.functions.text import label_or
from meterbook.operators.filters import UsageFilter, apply_filter


def top_customers(df: DataFrame, k: int = 10, flt: UsageFilter | None = None, on_bad_number: str = "fail") -> DataFrame:
    """The ``k`` customers with the largest pricing total: ``label``, ``value``.

    Grouping is on the exact name (null and empty stay separate groups, both labelled
    ``Unknown``). The aggregate is partial per task before its shuffle, so a customer holding
    a third of the rows costs one row per task; the sort is a top-k, not a global sort.
    Ties in cost are broken by name so the result is deterministic.
    """
    if k < 1:
        raise ValueError("k starts at 1")
    costs = apply_filter(df, flt).groupBy("CustomerName").agg(
        money_sum(amount(df, "PricingPreTaxTotal", strict=is_strict(on_bad_number))).alias("_cost"))
    ranked = costs.orderBy(F.col("_cost").desc_nulls_last(), F.col("CustomerName").asc_nulls_last()).limit(k)
    return ranked.select(label_or("CustomerName", "Unknown").alias("label"), to_double("_cost").alias("value"))


def top_k_per_group(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[Column],
    k: int | None,
    rank_col: str = "rank",
) -> DataFrame:
    """The first ``k`` rows of each group in ``order_cols`` order (all rows when ``None``),
    with their rank.

    Written as ``row_number() <= k``: Catalyst plans a partial ``WindowGroupLimit`` before the
    shuffle, so each task sends at most ``k`` rows per group and a hot group cannot pile up
    in one reducer.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    ranked = df.withColumn(rank_col, F.row_number().over(w))
    return ranked.where(F.col(rank_col) <= k) if k else ranked

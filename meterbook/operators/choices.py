"""Choice lists for the dashboard: invoice numbers, filter options, domains per customer.

The browser built these from every loaded row; here they are distinct-aggregates whose
output is small, so no detail rows leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.functions.text import choice_label, non_blank
from meterbook.operators.filters import UsageFilter, apply_filter
from meterbook.operators.ranking import top_k_per_group


def invoice_list(df: DataFrame, flt: UsageFilter | None = None, limit: int | None = None) -> DataFrame:
    """Distinct non-blank invoice numbers (kept untrimmed) in ascending order: all of them
    (a sorted, range-partitioned result), or the first ``limit``."""
    base = apply_filter(df, flt).where(non_blank("InvoiceNumber"))
    ordered = base.select("InvoiceNumber").distinct().orderBy(F.col("InvoiceNumber").asc_nulls_last())
    return ordered.limit(limit) if limit else ordered


def filter_options(df: DataFrame, column: str = "CustomerName", max_options: int | None = None) -> DataFrame:
    """Choices for one filter column in label order (case-folded, then exact): distinct
    non-blank values (``value``), their trimmed ``label`` and the ``option`` text shown in a
    list. All of them, or the ``max_options`` first, whatever the file order."""
    values = df.where(non_blank(column)).select(F.col(column).alias("value")).distinct()
    labelled = values.select("value", F.trim("value").alias("label"), choice_label("value", "value").alias("option"))
    ordered = labelled.orderBy(F.lower("label"), F.col("label"), F.col("value"))
    return ordered.limit(max_options) if max_options else ordered


def customer_domains(df: DataFrame, max_per_customer: int | None = None) -> DataFrame:
    """Domains per customer (both present and non-empty): ``CustomerName``,
    ``CustomerDomainName``, ``domain_rank`` by name. All of them, or the first
    ``max_per_customer`` of each customer."""
    pairs = (
        df.where(F.coalesce(F.col("CustomerName"), F.lit("")) != "")
        .where(F.coalesce(F.col("CustomerDomainName"), F.lit("")) != "")
        .select("CustomerName", "CustomerDomainName")
        .distinct()
    )
    return top_k_per_group(
        pairs, ["CustomerName"], [F.col("CustomerDomainName").asc()], max_per_customer, rank_col="domain_rank"
    )


def all_domains(df: DataFrame, max_options: int | None = None) -> DataFrame:
    """Domain choices when no customer is selected, by name (the first ``max_options``)."""
    values = df.where(F.coalesce(F.col("CustomerDomainName"), F.lit("")) != "")
    ordered = values.select("CustomerDomainName").distinct().orderBy("CustomerDomainName")
    return ordered.limit(max_options) if max_options else ordered

"""One pass for a dashboard refresh: summary, top customers and daily spend together.

A refresh asks three questions of the same filtered rows. Written separately they are
three scans; here they are one scan and one aggregate with GROUPING SETS
``((), (CustomerName), (day))``. Each row is expanded three times in memory and
aggregated partially before a single shuffle. The aggregated rows (one total, one per
customer, one per day) are small and can be persisted and split into the three answers
without touching the data again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.functions.dates import usage_day
from meterbook.functions.numbers import amount, is_strict, money_sum, to_double
from meterbook.functions.text import label_or
from meterbook.operators.filters import UsageFilter, apply_filter
from meterbook.params import PricingParams

# Values of ``level`` in the aggregated rows.
LEVELS = ("total", "customer", "day")


def dashboard_rollup(df: DataFrame, flt: UsageFilter | None = None, on_bad_number: str = "fail") -> DataFrame:
    """Exact pricing / billing sums and row counts at three levels, from one scan:
    ``level`` (total, customer, day), ``CustomerName``, ``date``, ``pricing``, ``billing``
    (DECIMAL(38,12)) and ``records``."""
    strict = is_strict(on_bad_number)
    base = apply_filter(df, flt)
    rows = base.select(
        "CustomerName",
        usage_day(base).alias("date"),
        amount(base, "PricingPreTaxTotal", strict=strict).alias("_p"),
        amount(base, "BillingPreTaxTotal", strict=strict).alias("_b"),
    )
    g = rows.groupingSets([[], ["CustomerName"], ["date"]], "CustomerName", "date").agg(
        F.grouping_id("CustomerName", "date").alias("_gid"),
        money_sum(F.col("_p")).alias("pricing"),
        money_sum(F.col("_b")).alias("billing"),
        F.count(F.lit(1)).alias("records"),
    )
    level = F.when(F.col("_gid") == 3, F.lit("total")).when(F.col("_gid") == 1, F.lit("customer")).otherwise(F.lit("day"))
    return g.select(level.alias("level"), "CustomerName", "date", "pricing", "billing", "records")


@dataclass
class Dashboard:
    """The three answers of a refresh over one shared aggregate (call :meth:`persist` when
    more than one is collected)."""

    rollup: DataFrame
    params: PricingParams

    def persist(self) -> "Dashboard":
        self.rollup = self.rollup.persist()
        return self

    @property
    def summary(self) -> DataFrame:
        """Same columns as :func:`meterbook.operators.summary.billing_summary`."""
        p = self.params.for_grid()
        total = self.rollup.where(F.col("level") == "total")
        total_pricing = to_double("pricing") * F.lit(p.forex)
        vat_ex = total_pricing / F.lit(p.margin)
        return total.select(
            total_pricing.alias("total_pricing"),
            to_double("billing").alias("total_billing"),
            F.col("records").alias("total_records"),
            vat_ex.alias("total_vat_ex"),
            (vat_ex * F.lit(p.vat)).alias("total_vat_inc"),
        )

    def top_customers(self, k: int = 10) -> DataFrame:
        """Same rows as :func:`meterbook.operators.ranking.top_customers`."""
        if k < 1:
            raise ValueError("k starts at 1")
        per = self.rollup.where(F.col("level") == "customer")
        ranked = per.orderBy(F.col("pricing").desc_nulls_last(), F.col("CustomerName").asc_nulls_last()).limit(k)
        return ranked.select(label_or("CustomerName", "Unknown").alias("label"), to_double("pricing").alias("value"))

    @property
    def daily_spend(self) -> DataFrame:
        """Same rows as :func:`meterbook.operators.summary.daily_spend`."""
        per = self.rollup.where(F.col("level") == "day")
        return per.select("date", to_double("pricing").alias("value"), "records")


def dashboard(df: DataFrame, params: PricingParams = PricingParams(), flt: UsageFilter | None = None,
              on_bad_number: str = "fail") -> Dashboard:
    return Dashboard(dashboard_rollup(df, flt, on_bad_number), params)

"""Pricing columns: per-row double pricing of the grid, and customer pricing strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.functions.numbers import is_strict, lenient_double, strict_double
from meterbook.params import PricingParams
from meterbook.schema import COMPUTED_COLUMNS, is_helper


def drop_computed_names(df: DataFrame) -> DataFrame:
    """A source column named like a computed one (any case) gives way to the computed one;
    storage helper columns are not shown either."""
    computed = {n.lower() for n in COMPUTED_COLUMNS}
    hidden = [c for c in df.columns if c.lower() in computed or is_helper(c)]
    return df.drop(*hidden) if hidden else df


def grid_pricing(params: PricingParams, amount: str = "PricingPreTaxTotal", on_bad_number: str = "fail") -> dict:
    """Forex, PreTaxWithForex, Margin, TotalVATEx, VAT, TotalVATInc as double columns.

    ``PreTaxWithForex = price * forex``; ``TotalVATEx = price * forex / margin``;
    ``TotalVATInc = price * forex / margin * vat``. The price is cast strictly unless
    ``on_bad_number="null"`` (then an unreadable price gives null amounts).
    """
    p = params.for_grid()
    forex, margin, vat = F.lit(p.forex), F.lit(p.margin), F.lit(p.vat)
    price = strict_double(amount) if is_strict(on_bad_number) else lenient_double(amount)
    with_forex = price * forex
    vat_ex = with_forex / margin
    exprs = {
        "Forex": forex,
        "PreTaxWithForex": with_forex,
        "Margin": margin,
        "TotalVATEx": vat_ex,
        "VAT": vat,
        "TotalVATInc": vat_ex * vat,
    }
    return {name: e.alias(name) for name, e in exprs.items()}


def grid_pricing_columns(params: PricingParams, amount: str = "PricingPreTaxTotal", on_bad_number: str = "fail") -> list:
    return list(grid_pricing(params, amount, on_bad_number).values())


def with_grid_pricing(df: DataFrame, params: PricingParams, amount: str = "PricingPreTaxTotal",
                      on_bad_number: str = "fail") -> DataFrame:
    """Append the six computed pricing columns to every column of ``df``."""
    pricing = grid_pricing_columns(params, amount, on_bad_number)
    return drop_computed_names(df).select("*", *pricing)


def strategy_price(price, markup_percent, discount_percent):
    """``price * (1 + markup/100) * (1 - discount/100)``; no strategy means no change."""
    markup = F.coalesce(markup_percent, F.lit(0.0))
    discount = F.coalesce(discount_percent, F.lit(0.0))
    return price * (F.lit(1.0) + markup / F.lit(100.0)) * (F.lit(1.0) - discount / F.lit(100.0))


def with_strategy_pricing(df: DataFrame, strategies: DataFrame, amount: str = "PricingPreTaxTotal",
                          on_bad_number: str = "fail") -> DataFrame:
    """Left-join per-customer strategies (``customer_name, name, markup_percent,
    discount_percent``) and add ``StrategyName`` and ``StrategyPrice``.

    The join is an equi-join on the customer name; Spark broadcasts the strategy table
    only when its measured size is under the broadcast threshold, and shuffles both sides
    otherwise, so a strategy table as large as the customer base still works.
    """
    s = strategies.select(
        F.col("customer_name").alias("_s_customer"),
        F.col("name").alias("StrategyName"),
        F.col("markup_percent").alias("_s_markup"),
        F.col("discount_percent").alias("_s_discount"),
    )
    price = strict_double(amount) if is_strict(on_bad_number) else lenient_double(amount)
    joined = df.join(s, df["CustomerName"] == s["_s_customer"], "left")
    return joined.select(
        *[df[c] for c in df.columns],
        F.col("StrategyName"),
        strategy_price(price, F.col("_s_markup"), F.col("_s_discount")).alias("StrategyPrice"),
    )

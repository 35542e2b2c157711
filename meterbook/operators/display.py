"""Display forms of the grid and the invoice: money text and placeholder labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.functions.numbers import money_text
from meterbook.functions.text import first_usable, label_or

# Grid columns shown as money (2 decimals, thousands separators).
MONEY_COLUMNS = ("UnitPrice", "PricingPreTaxTotal", "BillingPreTaxTotal", "PreTaxWithForex", "TotalVATEx", "TotalVATInc")


def grid_display(grid: DataFrame) -> DataFrame:
    """The grid with its money columns as display text; other columns unchanged."""
    return grid.select(*[money_text(c).alias(c) if c in MONEY_COLUMNS else F.col(c) for c in grid.columns])


def invoice_display(items: DataFrame) -> DataFrame:
    """Printed invoice lines: ``-`` for a missing meter field, tag or entitlement (the
    entitlement shows its description, else its id), money and quantities as text."""
    scope = [c for c in ("customer_name", "customer_domain_name", "invoice_number") if c in items.columns]
    return items.select(
        *scope,
        *[label_or(c, "-").alias(c) for c in ("meter_category", "meter_sub_category", "meter_name", "meter_type", "unit")],
        money_text("quantity").alias("quantity"),
        money_text("unit_price").alias("unit_price"),
        money_text("total_vat_inc").alias("total_vat_inc"),
        label_or("tags", "-").alias("tags"),
        first_usable("entitlement_description", "entitlement_id", default="-").alias("entitlement"),
    )

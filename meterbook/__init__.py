"""meterbook — cloud-usage billing analytics on Spark DataFrames.

Land usage CSV exports as all-string tables, then search, filter, price, summarise,
rank and invoice them with built-in Spark column expressions and aggregates.
"""

from meterbook.params import DEFAULT_VAT, PricingParams
from meterbook.operators.filters import UsageFilter, invoice_scope

__all__ = ["DEFAULT_VAT", "PricingParams", "UsageFilter", "invoice_scope"]

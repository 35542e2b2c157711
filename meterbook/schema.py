"""Column contract of a usage export and the named column sets built on it.

Every stored usage column is a string (raw text is canonical); typed values are
derived with explicit casts where a report needs them.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The 55 header names of a partner usage export, in file order.
USAGE_COLUMNS = (
    "PartnerId", "PartnerName", "CustomerId", "CustomerName", "CustomerDomainName",
    "CustomerCountry", "MpnId", "Tier2MpnId", "InvoiceNumber", "ProductId", "SkuId",
    "AvailabilityId", "SkuName", "ProductName", "PublisherName", "PublisherId",
    "SubscriptionDescription", "SubscriptionId", "ChargeStartDate", "ChargeEndDate",
    "UsageDate", "MeterType", "MeterCategory", "MeterId", "MeterSubCategory", "MeterName",
    "MeterRegion", "Unit", "ResourceLocation", "ConsumedService", "ResourceGroup",
    "ResourceURI", "ChargeType", "UnitPrice", "Quantity", "UnitType", "BillingPreTaxTotal",
    "BillingCurrency", "PricingPreTaxTotal", "PricingCurrency", "ServiceInfo1",
    "ServiceInfo2", "Tags", "AdditionalInfo", "EffectiveUnitPrice", "PCToBCExchangeRate",
    "PCToBCExchangeRateDate", "EntitlementId", "EntitlementDescription",
    "PartnerEarnedCreditPercentage", "CreditPercentage", "CreditType", "BenefitId",
    "BenefitOrderId", "BenefitType",
)

USAGE_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in USAGE_COLUMNS])

# Columns the equality filter accepts (dashboard dropdowns / invoice scope).
EQUALITY_FILTER_COLUMNS = (
    "CustomerName", "CustomerDomainName", "InvoiceNumber", "ProductName", "ChargeType",
)

# Columns the free-text search reads.
SEARCH_COLUMNS = ("CustomerName", "ProductName")

# Grid columns that carry a contains-style header filter.
CONTAINS_FILTER_COLUMNS = (
    "EntitlementDescription", "EntitlementId", "MeterCategory", "MeterSubCategory",
    "MeterName", "MeterType",
)

# Computed pricing columns, in grid order.
COMPUTED_COLUMNS = ("Forex", "PreTaxWithForex", "Margin", "TotalVATEx", "VAT", "TotalVATInc")

# The standard 22-column grid (16 source + 6 computed), in display order.
STANDARD_VIEW = (
    "CustomerName", "CustomerDomainName", "EntitlementDescription", "EntitlementId", "Tags",
    "InvoiceNumber", "ProductName", "MeterCategory", "MeterSubCategory", "MeterName",
    "MeterType", "UsageDate", "Quantity", "UnitPrice", "PricingPreTaxTotal",
    "BillingPreTaxTotal", "Forex", "PreTaxWithForex", "Margin", "TotalVATEx", "VAT",
    "TotalVATInc",
)

# Column groups that can be shown or hidden together in the standard view.
COLUMN_GROUPS = {
    "entitlement": ("EntitlementDescription", "EntitlementId"),
    "meter": ("MeterCategory", "MeterSubCategory", "MeterName", "MeterType"),
}

# The seven keys of an invoice line.
INVOICE_KEYS = (
    "MeterCategory", "MeterSubCategory", "MeterName", "MeterType", "Unit",
    "EntitlementDescription", "EntitlementId",
)

# Extra keys that split one upload into per-customer invoices.
INVOICE_SCOPE_KEYS = ("CustomerName", "CustomerDomainName", "InvoiceNumber")

# Tie-breaker column persisted at ingest so that sorted pages never overlap.
ROW_ID = "_row_id"
UPLOAD_ID = "upload_id"
CORRUPT_RECORD = "_corrupt_record"
SOURCE_FILE = "_source_file"
LOWER_SUFFIX = "_lc"
DECIMAL_SUFFIX = "_dec"
DAY_SUFFIX = "_day"

# Amount and date columns stored a second time, parsed, at ingest.
AMOUNT_COLUMNS = ("Quantity", "PricingPreTaxTotal", "BillingPreTaxTotal")
DATE_COLUMNS = ("UsageDate", "ChargeStartDate", "ChargeEndDate")


def is_helper(column: str) -> bool:
    """Storage helper columns that reports do not show."""
    return column in (CORRUPT_RECORD, SOURCE_FILE) or column.endswith((LOWER_SUFFIX, DECIMAL_SUFFIX, DAY_SUFFIX))

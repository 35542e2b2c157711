"""Invoices: lines, subtotals, totals, period and export rows from aggregates of one scan.

Invoice parts with lines are rolled up from :func:`line_sums`, keyed by the seven line keys
(plus customer, domain and invoice number for a batch of invoices). Decimal sums are
associative, so totals and subtotals taken from the line sums equal those taken from the
rows, and the weighted unit price is recomputed from summed parts, never averaged. Totals
and period alone come from :func:`scope_sums`, which never forms lines.

Tags and spellings are group keys of a first hash aggregate and are merged by a second one
over its much smaller output, so a line with very many different tags is spread over all
tasks before they are listed, and no string state is kept while rows are read.

In a batch, invoices are compared ignoring case like the single-invoice filter. The folded
keys stay with every intermediate result; an invoice shows the smallest spelling among all
of its rows. The first aggregate's rows of a batch are dealt out once, by invoice: lines, their
tags, the spelling and the subtotals then come without another shuffle. These rows of one
invoice so meet in one task, as a sorted stream that spills; for an upload that is a single
invoice ask for that invoice, whose lines are spread.

That first aggregate costs a shuffle of its own, which pays where a line sums several rows. Where
most lines are one row it moves every row twice; ``rows_first`` deals the rows themselves out by
invoice, once, and aggregates them there.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterbook.functions.dates import period_label, stored_or_parsed
from meterbook.functions.numbers import (
    MONEY, amount, decimal_text, export_number, priced_decimal, to_double, weighted_price,
    weighted_price_double,
)
from meterbook.functions.text import blank_to_null, first_usable, label_or, packed, unpacked
from meterbook.operators.filters import UsageFilter, apply_filter
from meterbook.params import PricingParams
from meterbook.schema import AMOUNT_COLUMNS, DECIMAL_SUFFIX

# Output names of the line keys (schema.INVOICE_KEYS) and the batch scope keys
# (schema.INVOICE_SCOPE_KEYS).
LINE_NAMES = {
    "MeterCategory": "meter_category",
    "MeterSubCategory": "meter_sub_category",
    "MeterName": "meter_name",
    "MeterType": "meter_type",
    "Unit": "unit",
    "EntitlementDescription": "entitlement_description",
    "EntitlementId": "entitlement_id",
}
SCOPE_NAMES = {
    "CustomerName": "customer_name",
    "CustomerDomainName": "customer_domain_name",
    "InvoiceNumber": "invoice_number",
}
SCOPE_COLS = tuple(SCOPE_NAMES.values())
LINE_COLS = tuple(LINE_NAMES.values())


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


# Folded keys and spellings that intermediate results of a batch carry.
KEY_COLS = {n: f"_k_{n}" for n in SCOPE_COLS}
SPELLING_COLS = {n: f"_s_{n}" for n in SCOPE_COLS}


def _keys(sums: DataFrame) -> list[str]:
    return [k for k in KEY_COLS.values() if k in sums.columns]


def _scope(df: DataFrame) -> list[str]:
    return [c for c in SCOPE_COLS if c in df.columns]


def _days(base: DataFrame, period_mode: str) -> list[Column]:
    """The days of a row that count for the start and for the end of the period."""
    if period_mode not in ("date", "text"):
        raise ValueError("period_mode is 'date' or 'text'")
    if period_mode == "date":
        return [stored_or_parsed(base, c) for c in ("ChargeStartDate", "ChargeEndDate")]
    return [F.coalesce(F.col("UsageDate"), F.col(c)) for c in ("ChargeStartDate", "ChargeEndDate")]


def _measures(base: DataFrame, period_mode: str) -> list[Column]:
    """Exact (lenient) sums and the first / last usage day of a group of rows."""
    days = _days(base, period_mode)
    return [
        F.sum(amount(base, "Quantity", strict=False)).alias("_q"),
        F.sum(amount(base, "PricingPreTaxTotal", strict=False)).alias("_p"),
        F.sum(amount(base, "BillingPreTaxTotal", strict=False)).alias("_b"),
        F.min(days[0]).alias("_start"),
        F.max(days[1]).alias("_end"),
    ]


_MERGED = [F.sum, F.sum, F.sum, F.min, F.max]


def _merged_measures() -> list[Column]:
    return [f(c).alias(c) for f, c in zip(_MERGED, ("_q", "_p", "_b", "_start", "_end"))]


def _exact_scope(batch: bool) -> list[Column]:
    return [F.col(src).alias(SPELLING_COLS[n]) for src, n in SCOPE_NAMES.items()] if batch else []


def _folded(rows: DataFrame, batch: bool, *more: str) -> tuple[DataFrame, list[str]]:
    """``rows`` dealt out by the folded invoice keys and ``more``, and those column names. The
    explicit exchange also keeps the first aggregate in the plan where a caller needs no sums
    of it, so that no string is ever aggregated over the rows themselves."""
    keys = list(KEY_COLS.values()) if batch else []
    folded = {KEY_COLS[n]: F.lower(SPELLING_COLS[n]) for n in SCOPE_COLS} if batch else {}
    dealt = rows.repartition(*folded.values(), *more)  # folded again after it, so that the keys do not travel
    return (dealt.withColumns(folded) if batch else dealt), [*keys, *more]


def _rows_by_invoice(base: DataFrame, with_tags: bool, period_mode: str) -> tuple[DataFrame, list[str]]:
    """The rows dealt out by the folded invoice keys, in the columns of the first aggregate's rows,
    and the names of those keys. The line keys, tags and amounts of a row travel as one text (amounts
    that are stored parsed as they are); its days on their own, as not every caller needs them."""
    start, end = _days(base, period_mode)
    keys = [F.col(src).alias(name) for src, name in LINE_NAMES.items()]
    tag = [blank_to_null("Tags").alias("_tag")] if with_tags else []
    amounts = [c for c in AMOUNT_COLUMNS if c + DECIMAL_SUFFIX not in base.columns]
    stored = [c + DECIMAL_SUFFIX for c in AMOUNT_COLUMNS if c not in amounts]
    texts = [*LINE_COLS, *(["_tag"] if with_tags else []), *amounts]
    wide = base.select(*_exact_scope(True), *keys, *tag, *amounts, *stored, start.alias("_start"), end.alias("_end"))
    narrow = wide.select(*SPELLING_COLS.values(), packed(texts).alias("_texts"), *stored, "_start", "_end")
    dealt, invoice = _folded(narrow, True)
    rows = unpacked(dealt, "_texts", texts)
    sums = {n: amount(rows, c, strict=False) for n, c in zip(("_q", "_p", "_b"), AMOUNT_COLUMNS)}
    return rows.withColumns(sums).drop(*amounts, *stored), invoice


def _smallest_spelling(batch: bool) -> list[Column]:
    return [F.min(SPELLING_COLS[n]).alias(SPELLING_COLS[n]) for n in SCOPE_COLS] if batch else []


def line_sums(df: DataFrame, flt: UsageFilter | None = None, batch: bool = False, with_tags: bool = True,
              period_mode: str = "date", rows_first: bool = False) -> DataFrame:
    """Per invoice line: exact (lenient) sums of quantity, pricing and billing, the distinct
    non-blank tags, and the first / last usage day; in a ``batch`` also the folded invoice
    keys and the invoice's smallest spelling of each.

    ``period_mode="date"`` takes the earliest / latest readable usage date (chronological
    order, fixed-width buffers). ``"text"`` compares the date text as strings, like a
    VARCHAR column; string buffers then need a sort- or object-based aggregate.

    ``rows_first`` shuffles every row of a batch once, however few rows a line sums; without it
    the sums of equal rows are shuffled twice, which is less where a line sums several rows.
    """
    base = apply_filter(df, flt)
    if batch and rows_first:
        return _lines(*_rows_by_invoice(base, with_tags, period_mode), batch, with_tags)
    line_keys = [F.col(src).alias(name) for src, name in LINE_NAMES.items()]
    tag = [blank_to_null("Tags").alias("_tag")] if with_tags else []
    rows = base.groupBy(*_exact_scope(batch), *line_keys, *tag).agg(*_measures(base, period_mode))
    if not batch and not with_tags:
        return rows
    return _lines(*_folded(rows, batch, *([] if batch else LINE_COLS)), batch, with_tags)


def _lines(dealt: DataFrame, invoice: list[str], batch: bool, with_tags: bool) -> DataFrame:
    """The lines of rows, or of sums of equal rows, that are dealt out by invoice (or else by line)."""
    by = [*invoice, *LINE_COLS] if batch else invoice
    tags = F.nullif(F.array_join(F.array_sort(F.collect_set("_tag")), ", "), F.lit("")).alias("tags")
    lines = dealt.groupBy(*by).agg(
        *_smallest_spelling(batch), *_merged_measures(), *([tags] if with_tags else []))
    if not batch:
        return lines
    return lines.withColumns({c: F.min(c).over(Window.partitionBy(*invoice)) for c in SPELLING_COLS.values()})


def scope_sums(df: DataFrame, flt: UsageFilter | None = None, batch: bool = False,
               period_mode: str = "date") -> DataFrame:
    """The measures of :func:`line_sums` for whole invoices, aggregated from the rows directly:
    what totals and period need when no lines are shown."""
    base = apply_filter(df, flt)
    rows = base.groupBy(*_exact_scope(batch)).agg(*_measures(base, period_mode))
    if not batch:
        return rows
    dealt, by = _folded(rows, batch)
    return dealt.groupBy(*by).agg(*_smallest_spelling(batch), *_merged_measures())


def _shown(parts: DataFrame, sums: DataFrame) -> DataFrame:
    """``parts`` with the invoice's smallest spelling in place of its folded keys."""
    keys = _keys(parts)
    if not keys:
        return parts
    names = sums.groupBy(*[F.col(k).alias(f"{k}_n") for k in keys]).agg(
        *[F.min(SPELLING_COLS[n]).alias(n) for n in SCOPE_COLS])
    same = [F.col(k).eqNullSafe(F.col(f"{k}_n")) for k in keys]
    joined = parts.join(names, functools.reduce(operator.and_, same))
    return joined.select(*SCOPE_COLS, *[c for c in parts.columns if c not in keys and c not in SPELLING_COLS.values()])


def _spelled(df: DataFrame) -> list[Column]:
    """The invoice's spelling that the line sums of a batch carry, under the names shown."""
    return [F.col(c).alias(n) for n, c in SPELLING_COLS.items() if c in df.columns]


def _priced(sums: DataFrame, params: PricingParams) -> DataFrame:
    forex, margin, vat = params.for_invoice()
    q = F.coalesce(F.col("_q"), _zero())
    p = F.coalesce(F.col("_p"), _zero())
    b = F.coalesce(F.col("_b"), _zero())
    return sums.select(
        *[F.col(c) for c in sums.columns if not c.startswith("_") or c in KEY_COLS.values() or c in SPELLING_COLS.values()],
        q.alias("_qd"),
        F.coalesce(weighted_price("_p", "_q"), _zero()).alias("_ud"),
        F.coalesce(weighted_price_double("_p", "_q"), F.lit(0.0)).alias("_u"),
        p.alias("_pd"),
        b.alias("_bd"),
        priced_decimal(p, forex, margin, vat).alias("_vd"),
    )


def _amounts() -> list[Column]:
    return [
        to_double("_qd").alias("quantity"),
        decimal_text("_qd").alias("quantity_raw"),
        F.col("_u").alias("unit_price"),
        decimal_text("_ud", 2).alias("unit_price_raw"),
        to_double("_pd").alias("pricing_pretax_total"),
        decimal_text("_pd", 2).alias("pricing_pretax_total_raw"),
        to_double("_bd").alias("billing_pretax_total"),
        decimal_text("_bd", 2).alias("billing_pretax_total_raw"),
        to_double("_vd").alias("total_vat_inc"),
        decimal_text("_vd", 2).alias("total_vat_inc_raw"),
    ]


def invoice_items(sums: DataFrame, params: PricingParams = PricingParams()) -> DataFrame:
    """Invoice lines: keys, tags, and each amount as a double and as exact text.

    ``total_vat_inc = pricing * forex / margin * vat`` in exact decimals; the unit price is
    Σpricing ÷ Σquantity (0 when Σquantity is 0 or missing)."""
    priced = _priced(sums, params)
    tags = ["tags"] if "tags" in sums.columns else []
    return priced.select(*_spelled(sums), *LINE_COLS, *tags, *_amounts())


def invoice_subtotals(sums: DataFrame, params: PricingParams = PricingParams()) -> DataFrame:
    """Subtotals per (meter category, subcategory) plus one grand row over the priced lines:
    ``level`` is ``subtotal`` or ``total``; amounts are exact sums of the line amounts (so
    subtotals add up to the grand row). A batch sums the subtotals of each invoice where they
    are; GROUPING SETS would shuffle every line twice."""
    priced = _priced(sums, params)
    cat, sub = "meter_category", "meter_sub_category"
    if scope := _keys(sums):
        # by the smallest spelling, not grouped by it: the rows stay in the order of the line sums
        spelled = _smallest_spelling(True)
        subs = priced.groupBy(*scope, cat, sub).agg(*spelled, F.lit(0).alias("_gid"), F.sum("_vd").alias("_v"), F.sum("_qd").alias("_sq"))
        total = subs.groupBy(*scope).agg(*spelled, F.lit(1).alias("_gid"), F.sum("_v").cast(MONEY).alias("_v"), F.sum("_sq").cast(MONEY).alias("_sq"))
        g = subs.unionByName(total, allowMissingColumns=True)
    else:
        g = priced.groupingSets([[cat, sub], []], cat, sub).agg(
            F.grouping(cat).alias("_gid"),
            F.sum("_vd").alias("_v"),
            F.sum("_qd").alias("_sq"),
        )
    level = F.when(F.col("_gid") == 0, F.lit("subtotal")).otherwise(F.lit("total"))
    label = F.when(
        F.col("_gid") == 0, F.concat(F.lit("Subtotal for "), label_or(sub, "Unspecified"))
    ).otherwise(F.lit("Total"))
    return g.select(
        *_spelled(g), cat, sub, level.alias("level"), label.alias("label"),
        to_double("_v").alias("subtotal_vat_inc"),
        decimal_text("_v", 2).alias("subtotal_vat_inc_raw"),
        to_double("_sq").alias("subtotal_quantity"),
    )


def _by_invoice(sums: DataFrame, *measures: Column) -> DataFrame:
    """Measures of each invoice under its smallest spelling."""
    keys = _keys(sums)
    spelled = [F.min(SPELLING_COLS[n]).alias(n) for n in SCOPE_COLS] if keys else []
    return sums.groupBy(*keys).agg(*spelled, *measures).drop(*keys)


def invoice_totals(sums: DataFrame, params: PricingParams = PricingParams()) -> DataFrame:
    """Invoice totals (one row per invoice): quantity, weighted unit price, pre-tax pricing,
    billing and VAT-inclusive total, each as a double and as exact text."""
    rolled = _by_invoice(sums, F.sum("_q").alias("_q"), F.sum("_p").alias("_p"), F.sum("_b").alias("_b"))
    scope = _scope(rolled)
    priced = _priced(rolled, params)
    return priced.select(
        *scope,
        to_double("_qd").alias("total_quantity"),
        F.col("_u").alias("total_unit_price"),
        to_double("_pd").alias("total_pricing"),
        to_double("_bd").alias("total_billing"),
        to_double("_vd").alias("total_vat_inc"),
        decimal_text("_qd").alias("quantity_raw"),
        decimal_text("_ud", 2).alias("unit_price_raw"),
        decimal_text("_pd", 2).alias("pricing_raw"),
        decimal_text("_bd", 2).alias("billing_raw"),
        decimal_text("_vd", 2).alias("total_vat_inc_raw"),
    )


def invoice_period(sums: DataFrame) -> DataFrame:
    """First and last usage day (``YYYY-MM-DD`` text) and the period label of each invoice."""
    bounds = _by_invoice(
        sums, F.min("_start").cast("string").alias("period_start"), F.max("_end").cast("string").alias("period_end"))
    return bounds.select(*_scope(bounds), "period_start", "period_end", period_label("period_start", "period_end").alias("period_label"))


_BLANKED = ("meter_category", "meter_sub_category", "meter_name", "meter_type", "unit")


def invoice_export(sums: DataFrame, params: PricingParams = PricingParams(), order_keys: bool = False) -> DataFrame:
    """The rows of the invoice CSV: one per line (raw amounts), then a ``TOTAL`` row with the
    total quantity and VAT-inclusive amount. ``row_kind`` is 0 for lines, 1 for the total.

    Lines and totals are two grouping sets of one aggregate over the line sums. With
    ``order_keys`` the rows also carry the line keys as they were (``_o_*``), null where a
    line has none, for the print order."""
    keys = _keys(sums)
    own = [*LINE_COLS, "tags"]
    both = sums.groupingSets([[*keys, *own], list(keys)], *keys, *own).agg(
        F.grouping("unit").cast("int").alias("row_kind"),
        F.sum("_q").alias("_q"), F.sum("_p").alias("_p"), F.sum("_b").alias("_b"))
    line = F.col("row_kind") == 0
    priced = _priced(both, params)
    rows = priced.select(
        *keys,
        "row_kind",
        *[F.when(line, F.coalesce(F.col(c), F.lit(""))).otherwise(F.lit("")).alias(c) for c in _BLANKED],
        export_number(decimal_text("_qd"), to_double("_qd")).alias("quantity"),
        F.when(line, export_number(decimal_text("_ud", 2), F.col("_u"))).otherwise(F.lit("")).alias("unit_price"),
        export_number(decimal_text("_vd", 2), to_double("_vd")).alias("total_vat_inc"),
        F.when(line, F.coalesce(F.col("tags"), F.lit(""))).otherwise(F.lit("TOTAL")).alias("tags"),
        F.when(line, first_usable("entitlement_description", "entitlement_id")).otherwise(F.lit("")).alias("entitlement"),
        *[F.col(c).alias(f"_o_{c}") for c in LINE_COLS],
    )
    shown = _shown(rows, sums)
    return shown if order_keys else shown.drop(*[f"_o_{c}" for c in LINE_COLS])


def line_order(scope: list[str] | tuple[str, ...] = (), prefix: str = "") -> list[Column]:
    """Invoice line order: category, subcategory, meter, entitlement, then the other keys,
    missing ones last."""
    cols = ["meter_category", "meter_sub_category", "meter_name", "entitlement_description",
            "meter_type", "unit", "entitlement_id"]
    return [F.col(c).asc_nulls_last() for c in [*scope, *[prefix + c for c in cols]]]


@dataclass
class Invoice:
    """All parts of one invoice (or a batch of invoices) over one shared aggregate.

    Call :meth:`persist` when several parts are collected, so the rows are scanned once."""

    sums: DataFrame
    params: PricingParams

    def persist(self) -> "Invoice":
        self.sums = self.sums.persist()
        return self

    @property
    def items(self) -> DataFrame:
        return invoice_items(self.sums, self.params)

    @property
    def subtotals(self) -> DataFrame:
        return invoice_subtotals(self.sums, self.params)

    @property
    def totals(self) -> DataFrame:
        return invoice_totals(self.sums, self.params)

    @property
    def period(self) -> DataFrame:
        return invoice_period(self.sums)

    @property
    def export_rows(self) -> DataFrame:
        return invoice_export(self.sums, self.params, order_keys=True)


def build_invoice(df: DataFrame, params: PricingParams = PricingParams(), flt: UsageFilter | None = None,
                  batch: bool = False, period_mode: str = "date") -> Invoice:
    """All parts of one invoice (``flt`` = :func:`invoice_scope`) or of every invoice
    (``batch=True``) over one shared line aggregate."""
    return Invoice(line_sums(df, flt, batch=batch, period_mode=period_mode), params)

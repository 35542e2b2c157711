"""Registered report queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query runs over the whole usage table derived from the driver's tables in
``sf_dir``; the parameters below are one fixed dashboard / invoice request.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterbook.functions.dates import display_date, usage_day
from meterbook.operators import choices, dashboard, detail, display, invoice, pricing, ranking, summary
from meterbook.operators.filters import UsageFilter, invoice_scope
from meterbook.params import PricingParams
from meterbook.session import session_conf, shared_dir, shuffles_removed
from meterbook.sources import exports, manifest, page_index, snapshots, usage_csv, warehouse
from meterbook.sources.fixture import billing_view

# The request every query answers: a PHP invoice of USD usage with a 15% margin.
PARAMS = PricingParams(forex=56.25, margin=0.85, vat=1.12)
PAGE, PAGE_SIZE = 3, 100
DETAIL_COLUMNS = ("CustomerName", "InvoiceNumber", "UsageDate", "PricingPreTaxTotal", "VAT")
SEARCH_TERM = "ReD%Get"  # '%' stays a wildcard, as in the dashboard
EQUALS = {"CustomerDomainName": "Machinery.Example.COM", "ChargeType": "NEW"}
COMBINED = UsageFilter(search="gizmo", equals={"CustomerDomainName": "household.example.com", "ChargeType": "renew"})
CONTAINS = {"MeterCategory": "eco", "EntitlementDescription": "PLAN 1"}
COUNT_FILTER = UsageFilter(search="gear", equals={"ChargeType": "New"})
DEEP_ROWS_PER_FILE = 20_000
SPLIT = "spark.sql.files.maxPartitionBytes"
RANGE = "256k"  # of compressed text, some seven times as much as it reads
COMPRESSED_SPLIT = "32m"  # compressed text that one task lands, some five times as much as it reads
TOP_K = 10
RECENT_UPLOADS = 25
INVOICE_LIST_LIMIT = 1000  # what the dashboard asks for
FIRST_OPTIONS = 50
REQUEST = UsageFilter(search="e%r", equals={"CustomerDomainName": "machinery.example.com", "ChargeType": "new", "InvoiceNumber": ""})
INVOICE_CUSTOMER = ("customer#000000011", "MACHINERY.example.com")
# Rates that an invoice and the grid replace by their defaults.
UNUSABLE_RATES = PricingParams(forex="n/a", margin=0, vat=-1)
MISSING_RATES = PricingParams(forex=None, margin=0.0, vat=None)


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing_view(spark, sf_dir)


def q_ingest_profile(spark, sf_dir):
    return summary.ingest_profile(_view(spark, sf_dir))


def q_detail_page(spark, sf_dir):
    return detail.detail_page(_view(spark, sf_dir), PARAMS, page=PAGE, page_size=PAGE_SIZE)


def q_detail_columns(spark, sf_dir):
    return detail.priced_detail(_view(spark, sf_dir), PARAMS, columns=DETAIL_COLUMNS)


def q_detail_count(spark, sf_dir):
    return detail.detail_count(_view(spark, sf_dir), COUNT_FILTER)


def q_priced_detail(spark, sf_dir):
    return detail.priced_detail(_view(spark, sf_dir), PARAMS)


def q_standard_view(spark, sf_dir):
    return detail.standard_view(_view(spark, sf_dir), PARAMS)


def q_search_detail(spark, sf_dir):
    return detail.priced_detail(_view(spark, sf_dir), PARAMS, UsageFilter(search=SEARCH_TERM))


def q_filter_equality(spark, sf_dir):
    return detail.priced_detail(_view(spark, sf_dir), PARAMS, UsageFilter(equals=EQUALS))


def q_filter_combined(spark, sf_dir):
    return detail.priced_detail(_view(spark, sf_dir), PARAMS, COMBINED)


def q_filter_meter_contains(spark, sf_dir):
    return detail.standard_view(_view(spark, sf_dir), PARAMS, UsageFilter(contains=CONTAINS))


def q_billing_summary(spark, sf_dir):
    return summary.billing_summary(_view(spark, sf_dir), PARAMS)


def q_top_customers(spark, sf_dir):
    return ranking.top_customers(_view(spark, sf_dir), TOP_K)


def q_invoice_list(spark, sf_dir):
    return choices.invoice_list(_view(spark, sf_dir), limit=INVOICE_LIST_LIMIT)


def _sums(spark, sf_dir, batch=False, with_tags=True, rows_first=False):
    return invoice.line_sums(_view(spark, sf_dir), batch=batch, with_tags=with_tags, rows_first=rows_first)


def q_invoice_lines(spark, sf_dir):
    return invoice.invoice_items(_sums(spark, sf_dir), PARAMS)


def q_weighted_unit_price(spark, sf_dir):
    items = invoice.invoice_items(invoice.line_sums(_view(spark, sf_dir), with_tags=False), PARAMS)
    return items.select(*invoice.LINE_COLS, "quantity_raw", "pricing_pretax_total_raw", "unit_price", "unit_price_raw")


def q_invoice_tags(spark, sf_dir):
    return _sums(spark, sf_dir).select(*invoice.LINE_COLS, "tags")


def q_invoice_subtotals(spark, sf_dir):
    return invoice.invoice_subtotals(_sums(spark, sf_dir, with_tags=False), PARAMS)


def _scopes(spark, sf_dir, batch=False):
    return invoice.scope_sums(_view(spark, sf_dir), batch=batch)


def q_invoice_totals(spark, sf_dir):
    return invoice.invoice_totals(_scopes(spark, sf_dir), PARAMS)


def q_invoice_period(spark, sf_dir):
    return invoice.invoice_period(_scopes(spark, sf_dir))


def q_invoice_export(spark, sf_dir):
    return invoice.invoice_export(_sums(spark, sf_dir), PARAMS)


def q_filter_options(spark, sf_dir):
    return choices.filter_options(_view(spark, sf_dir), "CustomerName")


def q_customer_domains(spark, sf_dir):
    return choices.customer_domains(_view(spark, sf_dir))


def q_daily_spend(spark, sf_dir):
    return summary.daily_spend(_view(spark, sf_dir))


def strategies_from_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pricing strategy per customer, derived from the customer table: the market
    segment names the plan, the nation sets the markup and the account key the discount."""
    c = spark.read.parquet(f"{sf_dir.rstrip('/')}/customer.parquet")
    return c.select(
        F.col("c_name").alias("customer_name"),
        F.concat(F.initcap(F.lower("c_mktsegment")), F.lit(" plan")).alias("name"),
        ((F.col("c_nationkey") % 5) * 5).cast("double").alias("markup_percent"),
        ((F.col("c_custkey") % 4) * 2.5).cast("double").alias("discount_percent"),
    )


def q_strategy_pricing(spark, sf_dir):
    view = _view(spark, sf_dir).select("_row_id", "CustomerName", "PricingPreTaxTotal")
    return pricing.with_strategy_pricing(view, strategies_from_customers(spark, sf_dir))


def q_invoice_batch(spark, sf_dir):
    return invoice.invoice_items(_sums(spark, sf_dir, batch=True, rows_first=True), PARAMS)


def q_invoice_batch_totals(spark, sf_dir):
    return invoice.invoice_totals(_scopes(spark, sf_dir, batch=True), PARAMS)


def q_invoice_batch_period(spark, sf_dir):
    return invoice.invoice_period(_scopes(spark, sf_dir, batch=True))


def q_invoice_batch_subtotals(spark, sf_dir):
    return invoice.invoice_subtotals(_sums(spark, sf_dir, batch=True, with_tags=False, rows_first=True), PARAMS)


def q_invoice_csv_rows(spark, sf_dir):
    rows = invoice.invoice_export(_sums(spark, sf_dir), PARAMS, order_keys=True)
    return exports.invoice_csv_rows(rows, position="Position").withColumn("Position", F.col("Position").cast("int"))


def q_customer_invoice_lines(spark, sf_dir):
    flt = invoice_scope(*INVOICE_CUSTOMER)
    return invoice.invoice_items(invoice.line_sums(_view(spark, sf_dir), flt), PARAMS)


def q_customer_invoice_totals(spark, sf_dir):
    return invoice.invoice_totals(invoice.scope_sums(_view(spark, sf_dir), invoice_scope(*INVOICE_CUSTOMER)), PARAMS)


def q_default_rates_totals(spark, sf_dir):
    return invoice.invoice_totals(_scopes(spark, sf_dir), UNUSABLE_RATES)


def q_default_rates_detail(spark, sf_dir):
    return detail.priced_detail(_view(spark, sf_dir), MISSING_RATES, columns=DETAIL_COLUMNS)


def q_filtered_summary(spark, sf_dir):
    return summary.billing_summary(_view(spark, sf_dir), PARAMS, REQUEST)


def q_filtered_top_customers(spark, sf_dir):
    return ranking.top_customers(_view(spark, sf_dir), TOP_K, REQUEST)


def q_filtered_invoice_list(spark, sf_dir):
    return choices.invoice_list(_view(spark, sf_dir), REQUEST)


def q_first_filter_options(spark, sf_dir):
    return choices.filter_options(_view(spark, sf_dir), "CustomerName", FIRST_OPTIONS)


def q_first_customer_domains(spark, sf_dir):
    return choices.customer_domains(_view(spark, sf_dir), 1)


def q_usage_days(spark, sf_dir):
    view = _view(spark, sf_dir)
    return view.select("_row_id", display_date(usage_day(view)).alias("day"))


def q_spend_by_upload(spark, sf_dir):
    """The supplier number stands for the upload, a dozen of them."""
    return summary.spend_by_upload(_view(spark, sf_dir).withColumn("upload_id", F.col("PartnerId").cast("long") % 12))


def _landed(spark, sf_dir):
    """The usage table written as CSV files, landed as an upload and read back."""
    view = _view(spark, sf_dir)
    base = shared_dir(spark, f"landed-{uuid.uuid4().hex}")
    with shuffles_removed(spark):  # the joins' are gone before the files are landed
        exports.write_grid_csv(view.drop("_row_id"), f"{base}/csv", compressed=True)
    with session_conf(spark, SPLIT, COMPRESSED_SPLIT):
        warehouse.land_upload(spark, f"{base}/csv", f"{base}/warehouse", f"{base}/manifest", 7, header=view.drop("_row_id").columns, compressed=True)
    return base, [c for c in view.columns if c != "_row_id"]


def q_landed_detail(spark, sf_dir):
    base, columns = _landed(spark, sf_dir)
    return warehouse.read_uploads(spark, f"{base}/warehouse", 7, f"{base}/manifest").select(*columns)


def q_landed_profile(spark, sf_dir):
    base, _ = _landed(spark, sf_dir)
    state = manifest.latest(manifest.read(spark, f"{base}/manifest"))
    return manifest.completed(state).select("row_count", "reject_count", "pricing_pretax_total", "billing_pretax_total", "usage_start", "usage_end")


def q_landed_invoice_lines(spark, sf_dir):
    base, _ = _landed(spark, sf_dir)
    return invoice.invoice_items(invoice.line_sums(warehouse.read_uploads(spark, f"{base}/warehouse", 7)), PARAMS)


def q_landed_newlines(spark, sf_dir):
    """The usage table with quotes, commas and line ends inside its tags, in files of many ranges each."""
    view = _view(spark, sf_dir).drop("_row_id")
    tags = F.concat("MeterName", F.lit('\n"'), "Unit", F.lit('",\n\n,'), "ChargeEndDate")
    base = shared_dir(spark, f"landed-{uuid.uuid4().hex}")
    with shuffles_removed(spark):
        exports.write_grid_csv(view.withColumn("Tags", tags), f"{base}/csv", compressed=True, splits=True)
    with shuffles_removed(spark), session_conf(spark, SPLIT, RANGE):
        warehouse.land_upload(spark, f"{base}/csv", f"{base}/warehouse", f"{base}/manifest", 7, compressed=True)
    return warehouse.read_uploads(spark, f"{base}/warehouse", 7).select(*view.columns)


def q_landed_mixed_headers(spark, sf_dir):
    """Two folders of files in one upload: the second has its columns in reverse order, in capitals,
    and a column of its own. Headers are found, not given."""
    view = _view(spark, sf_dir).drop("_row_id")
    hourly = F.col("Unit") == "1 Hour"
    base = shared_dir(spark, f"landed-{uuid.uuid4().hex}")
    exports.write_grid_csv(view.where(hourly), f"{base}/hours", compressed=True)
    exports.write_grid_csv(view.where(~hourly).select(*[F.col(c).alias(c.upper()) for c in reversed(view.columns)], F.lower("Unit").alias("Note")), f"{base}/units", compressed=True)
    with session_conf(spark, SPLIT, COMPRESSED_SPLIT):
        warehouse.land_upload(spark, [f"{base}/hours", f"{base}/units"], f"{base}/warehouse", f"{base}/manifest", 7, compressed=True)
    return warehouse.read_uploads(spark, f"{base}/warehouse", 7).select(*view.columns, "Note")


def _two_uploads(spark, sf_dir):
    """The usage table as uploads 1 (hours) and 2 (other units), as versions."""
    view = _view(spark, sf_dir).drop("_row_id")
    hourly = F.col("Unit") == "1 Hour"
    base = shared_dir(spark, f"landed-{uuid.uuid4().hex}")
    exports.write_grid_csv(view.where(hourly), f"{base}/hours", compressed=True)
    exports.write_grid_csv(view.where(~hourly).withColumn("Note", F.lower("Unit")), f"{base}/units", compressed=True)
    roots = f"{base}/warehouse", f"{base}/manifest"
    _land_version(spark, f"{base}/hours", roots, 1)
    _land_version(spark, f"{base}/units", roots, 2)
    return base, roots


def _land_version(spark, paths, roots, upload_id):
    with session_conf(spark, SPLIT, COMPRESSED_SPLIT):
        snapshots.land(spark, paths, *roots, upload_id, compressed=True)


def q_landed_uploads(spark, sf_dir):
    """The spend of each upload, read across uploads whose columns differ."""
    _, roots = _two_uploads(spark, sf_dir)
    rows = snapshots.read(spark, *roots)
    return summary.spend_by_upload(rows).join(rows.groupBy("upload_id").agg(F.count("Note").alias("notes")), "upload_id")


def q_landed_replacement(spark, sf_dir):
    """A reader that began before upload 1 was replaced and upload 2 deleted, and one that began after."""
    base, roots = _two_uploads(spark, sf_dir)
    before = snapshots.read(spark, *roots)
    _land_version(spark, f"{base}/units", roots, 1)
    snapshots.delete(spark, roots[1], 2)
    after = snapshots.read(spark, *roots)
    spend = [summary.spend_by_upload(rows).withColumn("reader", F.lit(name)) for name, rows in (("before", before), ("after", after))]
    return spend[0].unionByName(spend[1])


def q_manifest_history(spark, sf_dir):
    """Every published state of two uploads: landed, replaced by one file more, deleted."""
    base, roots = _two_uploads(spark, sf_dir)
    _land_version(spark, [f"{base}/hours", f"{base}/units"], roots, 1)
    snapshots.delete(spark, roots[1], 2)
    past = snapshots.history(manifest.read(spark, roots[1]))
    return past.select("upload_id", "sequence", "status", "row_count", "reject_count", "pricing_pretax_total", "superseded")


def q_deep_page(spark, sf_dir):
    """The page in the middle of the ordered detail, by the page index."""
    root = shared_dir(spark, f"pages-{uuid.uuid4().hex}")
    page_index.build(_view(spark, sf_dir), root, DEEP_ROWS_PER_FILE)
    middle = 1 + page_index.pages(spark, root, PAGE_SIZE).first().pages // 2  # one row
    return page_index.page(spark, root, middle, PAGE_SIZE)


def q_file_checks(spark, sf_dir):
    """Each page stands for an uploaded file: its URL is the name, its text the content."""
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    suffix = F.when(F.col("page_id") % 3 == 0, ".csv").when(F.col("page_id") % 3 == 1, ".CSV").otherwise(".csv.gz")
    files = pages.select("page_id", F.concat(F.coalesce("url", F.lit("")), suffix).alias("path"),
                         F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size"))
    return files.select("page_id", "size", *usage_csv.file_checks(max_mb=0.001))


def _order_states(spark, sf_dir):
    """The orders as state changes, read back from a manifest that two writers append to."""
    orders = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    at = (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("o_orderkey")))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("processing")
    entries = orders.select(F.col("o_custkey").alias("upload_id"), status.alias("status"), F.col("o_orderkey").alias("row_count"),
                            at.alias("created_at"), at.alias("recorded_at"))
    root = shared_dir(spark, f"manifest-{uuid.uuid4().hex}")
    for k in range(2):  # two writers
        manifest.append(root, entries.where(F.col("row_count") % 2 == k))
    return manifest.latest(manifest.read(spark, root))


def q_manifest_state(spark, sf_dir):
    """Each order stands for a state change of the upload with its customer's number."""
    return _order_states(spark, sf_dir).select("upload_id", "status", "row_count")


def q_recent_uploads(spark, sf_dir):
    """The newest uploads of the manifest as the upload list shows them."""
    listed = manifest.listing(manifest.recent(_order_states(spark, sf_dir), RECENT_UPLOADS))
    return listed.select("upload_id", "status", "rows_text", "created_text", "completed_text", "error_text")


def q_newest_upload(spark, sf_dir):
    return manifest.newest_completed(_order_states(spark, sf_dir))


def q_money_format(spark, sf_dir):
    return display.grid_display(detail.standard_view(_view(spark, sf_dir), PARAMS))


def q_invoice_display(spark, sf_dir):
    return display.invoice_display(invoice.invoice_items(_sums(spark, sf_dir), PARAMS))


def q_dashboard_rollup(spark, sf_dir):
    return dashboard.dashboard_rollup(_view(spark, sf_dir)).select(
        "level", "CustomerName", "date", F.col("pricing").cast("double").alias("pricing"),
        F.col("billing").cast("double").alias("billing"), "records")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ingest_profile": q_ingest_profile,
    "detail_page": q_detail_page,
    "detail_columns": q_detail_columns,
    "detail_count": q_detail_count,
    "priced_detail": q_priced_detail,
    "standard_view": q_standard_view,
    "search_detail": q_search_detail,
    "filter_equality": q_filter_equality,
    "filter_combined": q_filter_combined,
    "filter_meter_contains": q_filter_meter_contains,
    "billing_summary": q_billing_summary,
    "top_customers": q_top_customers,
    "invoice_list": q_invoice_list,
    "invoice_lines": q_invoice_lines,
    "weighted_unit_price": q_weighted_unit_price,
    "invoice_tags": q_invoice_tags,
    "invoice_subtotals": q_invoice_subtotals,
    "invoice_totals": q_invoice_totals,
    "invoice_period": q_invoice_period,
    "invoice_export": q_invoice_export,
    "filter_options": q_filter_options,
    "customer_domains": q_customer_domains,
    "daily_spend": q_daily_spend,
    "strategy_pricing": q_strategy_pricing,
    "invoice_batch": q_invoice_batch,
    "invoice_batch_totals": q_invoice_batch_totals,
    "invoice_batch_period": q_invoice_batch_period,
    "invoice_batch_subtotals": q_invoice_batch_subtotals,
    "invoice_csv_rows": q_invoice_csv_rows,
    "customer_invoice_lines": q_customer_invoice_lines,
    "customer_invoice_totals": q_customer_invoice_totals,
    "default_rates_totals": q_default_rates_totals,
    "default_rates_detail": q_default_rates_detail,
    "filtered_summary": q_filtered_summary,
    "filtered_top_customers": q_filtered_top_customers,
    "filtered_invoice_list": q_filtered_invoice_list,
    "first_filter_options": q_first_filter_options,
    "first_customer_domains": q_first_customer_domains,
    "usage_days": q_usage_days,
    "spend_by_upload": q_spend_by_upload,
    "landed_detail": q_landed_detail,
    "landed_profile": q_landed_profile,
    "landed_invoice_lines": q_landed_invoice_lines,
    "landed_newlines": q_landed_newlines,
    "landed_mixed_headers": q_landed_mixed_headers,
    "landed_uploads": q_landed_uploads,
    "landed_replacement": q_landed_replacement,
    "manifest_history": q_manifest_history,
    "deep_page": q_deep_page,
    "file_checks": q_file_checks,
    "manifest_state": q_manifest_state,
    "recent_uploads": q_recent_uploads,
    "newest_upload": q_newest_upload,
    "money_format": q_money_format,
    "invoice_display": q_invoice_display,
    "dashboard_rollup": q_dashboard_rollup,
}

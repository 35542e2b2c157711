"""Plan shapes that the design relies on at scale (guards against regressions)."""

import contextlib
import glob
import io
import re

import pytest
from pyspark.sql import functions as F

from meterbook import PricingParams, UsageFilter, invoice_scope
from meterbook.operators import choices, detail, invoice, ranking, summary
from meterbook.schema import USAGE_COLUMNS
from meterbook.sources import exports, warehouse as wh
from meterbook.sources.fixture import billing_view

P = PricingParams(56.25, 0.85, 1.12)


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def landed(spark, view001, tmp_path_factory):
    base = tmp_path_factory.mktemp("plans")
    cols = [F.col(c) if c in view001.columns else F.lit(None).cast("string").alias(c) for c in USAGE_COLUMNS]
    exports.write_grid_csv(view001.select(*cols).coalesce(1), str(base / "csv"))
    wh.land_upload(spark, sorted(glob.glob(str(base / "csv" / "*.csv"))), str(base / "wh"), str(base / "mf"), 1)
    up = wh.read_uploads(spark, str(base / "wh"), 1)
    return up, up.select("CustomerName", "CustomerDomainName").first()


def test_one_upload_is_a_partition_filter(landed):
    up, _ = landed
    text = plan(summary.billing_summary(up, P))
    assert "PartitionFilters: [isnotnull(upload_id" in text and "(upload_id#" in text


def test_customer_filter_is_pushed_to_parquet(landed):
    up, one = landed
    text = plan(invoice.invoice_items(invoice.line_sums(up, invoice_scope(one.CustomerName, one.CustomerDomainName)), P))
    assert "EqualTo(CustomerName_lc," in text and "EqualTo(CustomerDomainName_lc," in text


def test_search_is_pushed_as_contains(landed):
    up, _ = landed
    text = plan(detail.detail_count(up, UsageFilter(search="gear")))
    assert "StringContains(ProductName_lc,gear)" in text


def test_scans_read_only_needed_columns(landed):
    up, _ = landed
    text = plan(ranking.top_customers(up, 10))
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert schema.count(":") <= 4 and "Tags" not in schema


def test_reports_use_partial_hash_aggregation(landed):
    up, _ = landed
    for df in (summary.billing_summary(up, P), ranking.top_customers(up, 10), summary.daily_spend(up),
               invoice.invoice_totals(invoice.line_sums(up, with_tags=False), P),
               invoice.invoice_period(invoice.line_sums(up, with_tags=False))):
        text = plan(df)
        assert "HashAggregate" in text and "SortAggregate" not in text and "ObjectHashAggregate" not in text


def nodes(df) -> list[str]:
    """Operator names of the physical plan's tree, top first."""
    tree = plan(df).split("\n\n")[0]
    return [m.group(1) for m in (re.search(r"([A-Z]\w+)( parquet)? ?(\w+ )?\(\d+\)$", line.strip()) for line in tree.splitlines()) if m]


def test_rows_are_hash_aggregated_before_any_shuffle(landed):
    """Below the lowest exchange of every invoice plan only a hash aggregate works on rows."""
    up, _ = landed
    for df in (invoice.invoice_items(invoice.line_sums(up), P), invoice.invoice_items(invoice.line_sums(up, batch=True), P),
               invoice.invoice_totals(invoice.scope_sums(up, batch=True), P), invoice.invoice_export(invoice.line_sums(up), P)):
        names = nodes(df)
        lowest = len(names) - 1 - names[::-1].index("Exchange")
        below = names[lowest + 1 :]
        assert set(below) & {"HashAggregate"} and not {"SortAggregate", "ObjectHashAggregate", "Sort"} & set(below), names


def test_totals_and_export_read_the_rows_once(landed):
    up, _ = landed
    for df in (invoice.invoice_totals(invoice.scope_sums(up), P), invoice.invoice_period(invoice.scope_sums(up)),
               invoice.invoice_export(invoice.line_sums(up), P), invoice.invoice_subtotals(invoice.line_sums(up, with_tags=False), P)):
        assert len(re.findall(r"^\(\d+\) Scan parquet", plan(df), re.M)) == 1


def test_contains_filters_reach_the_scan(landed):
    up, _ = landed
    text = plan(detail.detail_count(up, UsageFilter(contains={"MeterName": "Eco"})))
    assert "StringContains(MeterName_lc,eco)" in text


def test_reports_read_stored_days(landed):
    up, _ = landed
    for df in (summary.daily_spend(up), summary.ingest_profile(up), invoice.invoice_period(invoice.scope_sums(up))):
        text = plan(df)
        assert "UsageDate_day" in text and "regexp_replace(UsageDate" not in text


def test_pages_and_rankings_are_top_n(landed):
    up, _ = landed
    for df in (detail.detail_page(up, P, page=3), ranking.top_customers(up, 10), choices.invoice_list(up, limit=100),
               choices.filter_options(up, max_options=50)):
        assert "TakeOrderedAndProject" in plan(df)


def test_capped_lists_limit_before_the_shuffle(landed):
    up, _ = landed
    text = plan(choices.customer_domains(up, 50)).split("\n\n")[0]
    assert text.count("WindowGroupLimit") == 2


def test_no_broadcast_hints(landed, spark):
    import pathlib

    own = [p for p in pathlib.Path("meterbook").rglob("*.py") if "llm" not in p.parts]
    src = "".join(p.read_text() for p in own)
    assert "broadcast(" not in src and "localCheckpoint" not in src


def test_dashboard_refresh_is_one_scan(landed):
    from meterbook.operators.dashboard import dashboard_rollup

    up, _ = landed
    text = plan(dashboard_rollup(up))
    assert len(re.findall(r"^\(\d+\) Scan parquet", text, re.M)) == 1
    assert "Expand" in text and "SortAggregate" not in text


def test_a_unit_filter_cuts_rows_before_the_join_with_orders(spark):
    hours = billing_view(spark, "/root/testdata/sf0.01").where(F.col("Unit") == "1 Hour")
    tree = hours._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in tree.splitlines() if "Join Inner" in line]
    at = next(k for k, line in enumerate(joins) if "l_partkey" in line)
    assert "l_orderkey" in joins[0] and at > 0  # lower in the tree: joined before

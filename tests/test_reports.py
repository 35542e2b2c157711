"""Rules and properties of the report operators."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from meterbook import PricingParams, UsageFilter, invoice_scope
from meterbook.operators import choices, detail, invoice, ranking, summary
from meterbook.params import DEFAULT_VAT
from meterbook.plans import catalog
from meterbook.schema import USAGE_COLUMNS
from meterbook.sources.fixture import billing_view
from tests.conftest import SF01

P = PricingParams(forex=56.25, margin=0.85, vat=1.12)


def usage(spark, rows, cols):
    """A small usage table: the given columns, every other contract column null."""
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    rest = [F.lit(None).cast("string").alias(c) for c in USAGE_COLUMNS if c not in cols]
    return df.select(*cols, *rest)


# ---- parameters (D13) -------------------------------------------------------------

def test_grid_defaults():
    assert PricingParams(1.0, 0, None).for_grid() == PricingParams(1.0, 1.0, DEFAULT_VAT)
    assert PricingParams(2.0, 0.5, 0).for_grid() == PricingParams(2.0, 0.5, DEFAULT_VAT)


def test_invoice_defaults():
    assert PricingParams(-1, -2, -3).for_invoice() == (Decimal(1), Decimal(1), Decimal("1.12"))
    assert PricingParams(None, None, None).for_invoice() == (Decimal(1), Decimal(1), Decimal("1.12"))
    assert PricingParams(56.25, 0.85, 1.2).for_invoice() == (Decimal("56.25"), Decimal("0.85"), Decimal("1.2"))


# ---- detail ---------------------------------------------------------------------

def test_priced_columns_formula(view001):
    row = detail.priced_detail(view001, P).where(F.col("PricingPreTaxTotal").isNotNull()).first()
    price = float(row.PricingPreTaxTotal)
    assert row.PreTaxWithForex == price * 56.25
    assert row.TotalVATEx == (price * 56.25) / 0.85
    assert row.TotalVATInc == ((price * 56.25) / 0.85) * 1.12
    assert (row.Forex, row.Margin, row.VAT) == (56.25, 0.85, 1.12)


def test_computed_name_beats_source_column(spark):
    df = usage(spark, [("a", "10")], ["CustomerName", "PricingPreTaxTotal"]).withColumn("vat", F.lit("source-vat"))
    out = detail.priced_detail(df, P)
    assert [c for c in out.columns if c.lower() == "vat"] == ["VAT"]


def test_column_whitelist(view001):
    out = detail.priced_detail(view001, P, columns=["CustomerName", "TotalVATInc", "vat"])
    assert out.columns[:1] == ["CustomerName"] and "TotalVATInc" in out.columns
    assert detail.priced_detail(view001, P, columns=["VAT"]).columns[0] == "_row_id"  # nothing left → all
    with pytest.raises(ValueError):
        detail.priced_detail(view001, P, columns=["CustomerName; DROP"])
    with pytest.raises(ValueError):
        UsageFilter(equals={"Tags": "x"}).apply(view001)


def test_pages_partition_the_ordered_rows(spark):
    view = billing_view(spark, SF01)
    full = detail.detail_page(view, P, columns=["_row_id", "UsageDate"], all_records=True)
    ids = [r._row_id for r in full.collect()]
    pages = []
    for page in range(1, 5):
        pages += [r._row_id for r in detail.detail_page(view, P, columns=["_row_id"], page=page, page_size=500).collect()]
    assert pages == ids[:2000]
    assert len(set(pages)) == 2000
    # keyset continuation equals the offset page
    last = full.collect()[499]
    after = detail.detail_after(view, last.UsageDate, last._row_id, P, page_size=500)
    assert [r._row_id for r in after.collect()] == ids[500:1000]


def test_nulls_last_in_detail_order(view001):
    rows = detail.detail_page(view001, P, columns=["UsageDate"], all_records=True).collect()
    dates_ = [r.UsageDate for r in rows]
    first_null = dates_.index(None)
    assert all(d is None for d in dates_[first_null:])
    assert dates_[:first_null] == sorted(dates_[:first_null], reverse=True)


def test_filter_order_and_blanks_do_not_matter(view001):
    a = UsageFilter(search="gear", equals={"ChargeType": "new", "CustomerDomainName": "building.example.com"})
    b = UsageFilter(search="gear", equals={"CustomerDomainName": "BUILDING.example.com", "ChargeType": "NEW", "ProductName": ""})
    ca = detail.detail_count(view001, a).first().total
    assert ca == detail.detail_count(view001, b).first().total > 0
    assert detail.detail_count(view001, UsageFilter(search="", equals={"CustomerName": None})).first().total == 6000


# ---- summary and rankings --------------------------------------------------------

def test_summary_applies_pricing_after_sum(view001):
    s = summary.billing_summary(view001, P).first()
    raw = summary.billing_summary(view001, PricingParams(1.0, 1.0, 1.0)).first()
    assert s.total_pricing == raw.total_pricing * 56.25
    assert s.total_vat_inc == (raw.total_pricing * 56.25) / 0.85 * 1.12
    assert s.total_records == 6000


def test_summary_fails_on_bad_price_like_the_reference(spark):
    df = usage(spark, [("a", "10", "1"), ("b", "abc", "2")], ["CustomerName", "PricingPreTaxTotal", "BillingPreTaxTotal"])
    with pytest.raises(Exception):
        summary.billing_summary(df, P).collect()
    # the invoice reads amounts leniently
    lines = invoice.invoice_items(invoice.line_sums(df), P).collect()
    assert sum(Decimal(r.pricing_pretax_total_raw) for r in lines) == Decimal("10")


def test_unknown_customers_stay_separate_groups(spark):
    rows = [(None, "5"), ("", "7"), ("Acme", "3"), ("acme", "1")]
    df = usage(spark, rows, ["CustomerName", "PricingPreTaxTotal"])
    got = sorted((r.label, r.value) for r in ranking.top_customers(df, 10).collect())
    assert got == [("Acme", 3.0), ("Unknown", 5.0), ("Unknown", 7.0), ("acme", 1.0)]


def test_top_customers_bounds(view001):
    with pytest.raises(ValueError):
        ranking.top_customers(view001, 0)
    vals = [r.value for r in ranking.top_customers(view001, 120).collect()]
    assert vals == sorted(vals, reverse=True) and len(vals) == 120  # as many as asked for


def test_daily_spend_adds_up_to_summary(view001):
    daily = summary.daily_spend(view001).agg(F.sum(F.col("value").cast("decimal(38,12)")), F.sum("records")).first()
    total = summary.billing_summary(view001, PricingParams(1.0, 1.0, 1.0)).first()
    assert abs(float(daily[0]) - total.total_pricing) < 1e-3 and daily[1] == 6000


def test_spend_by_upload(spark, view001):
    two = view001.withColumn("upload_id", F.lit(1)).unionByName(view001.withColumn("upload_id", F.lit(2)))
    rows = {r.upload_id: r for r in summary.spend_by_upload(two).collect()}
    assert rows[1].total_pricing == rows[2].total_pricing and rows[1].total_records == 6000


# ---- choice lists ----------------------------------------------------------------

def test_filter_options_cap_and_label_order(spark):
    names = [f"Cust{i:03d}" for i in range(80)] + ["alpha", "Beta", "  ", None, "beta"]
    df = usage(spark, [(n,) for n in names], ["CustomerName"])
    assert choices.filter_options(df).count() == 83  # all unless asked
    got = [r.value for r in choices.filter_options(df, max_options=50).collect()]
    assert len(got) == 50 and got[:3] == ["alpha", "Beta", "beta"]
    assert "  " not in got and None not in got


def test_customer_domains_cap_and_case(spark):
    rows = [("Acme", f"d{i:02d}.example.com") for i in range(60)] + [("ACME", "x.example.com"), ("Zed", ""), ("Zed", "z.io")]
    df = usage(spark, rows, ["CustomerName", "CustomerDomainName"])
    assert choices.customer_domains(df).where("CustomerName = 'Acme'").count() > 50  # all unless asked
    out = choices.customer_domains(df, 50)
    per = {r.CustomerName: r.n for r in out.groupBy("CustomerName").agg(F.count("*").alias("n")).collect()}
    assert per == {"Acme": 50, "ACME": 1, "Zed": 1}
    top = [r.CustomerDomainName for r in out.where("CustomerName = 'Acme'").orderBy("domain_rank").collect()]
    assert top == [f"d{i:02d}.example.com" for i in range(50)]


def test_customer_domains_plan_limits_before_shuffle(view001):
    plan = choices.customer_domains(view001, 50)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_invoice_list_is_distinct_sorted_and_untrimmed(spark):
    rows = [("INV-2",), ("INV-1",), (" INV-1",), ("  ",), (None,), ("INV-1",)]
    df = usage(spark, rows, ["InvoiceNumber"])
    assert [r.InvoiceNumber for r in choices.invoice_list(df, limit=None).collect()] == [" INV-1", "INV-1", "INV-2"]
    assert [r.InvoiceNumber for r in choices.invoice_list(df, limit=1).collect()] == [" INV-1"]


# ---- invoices --------------------------------------------------------------------

def test_subtotals_add_up_to_grand_row(view001):
    sums = invoice.line_sums(view001)
    sub = invoice.invoice_subtotals(sums, P)
    parts = sub.where("level = 'subtotal'").agg(F.sum(F.col("subtotal_vat_inc_raw").cast("decimal(38,12)"))).first()[0]
    grand = Decimal(sub.where("level = 'total'").first().subtotal_vat_inc_raw)
    assert parts == grand
    total = Decimal(invoice.invoice_totals(sums, P).first().total_vat_inc_raw)
    lines = sums.count()
    assert abs(total - grand) <= Decimal("1e-12") * lines


def test_totals_equal_base_row_sums(view001):
    t = invoice.invoice_totals(invoice.line_sums(view001), P).first()
    base = view001.agg(F.sum(F.col("Quantity").try_cast("decimal(38,12)")).alias("q"),
                       F.sum(F.col("PricingPreTaxTotal").try_cast("decimal(38,12)")).alias("p")).first()
    assert Decimal(t.quantity_raw) == base.q and Decimal(t.pricing_raw) == base.p
    assert t.total_unit_price == float(base.p) / float(base.q)


def test_single_invoice_equals_its_batch_slice(view001):
    one = view001.where("InvoiceNumber is not null and trim(InvoiceNumber) <> ''").select(
        "CustomerName", "CustomerDomainName", "InvoiceNumber").first()
    flt = invoice_scope(one.CustomerName.upper(), one.CustomerDomainName, one.InvoiceNumber.lower())
    single = invoice.invoice_items(invoice.line_sums(view001, flt), P)
    batch = invoice.invoice_items(invoice.line_sums(view001, batch=True), P).where(
        (F.lower("customer_name") == one.CustomerName.lower()) & (F.lower("invoice_number") == one.InvoiceNumber.lower())
    ).drop("customer_name", "customer_domain_name", "invoice_number")
    assert sorted(map(tuple, single.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)
    with pytest.raises(ValueError):
        invoice_scope("", "x.example.com")


def test_batch_groups_case_variants_together(spark):
    rows = [("Acme", "a.io", "INV-1", "Cat", "1", "10"), ("ACME", "A.IO", "inv-1", "Cat", "2", "20")]
    df = usage(spark, rows, ["CustomerName", "CustomerDomainName", "InvoiceNumber", "MeterCategory", "Quantity", "PricingPreTaxTotal"])
    out = invoice.invoice_items(invoice.line_sums(df, batch=True), P).collect()
    assert len(out) == 1 and out[0].customer_name == "ACME" and out[0].quantity_raw == "3"
    assert out[0].unit_price == 10.0 and out[0].unit_price_raw == "10.00"


def test_one_invoice_with_spellings_on_different_lines(spark):
    """Lines, subtotals, totals and period of a batch are those of the one invoice."""
    rows = [("Acme", "a.io", "INV-1", "A", "S", "1", "10", "2024-01-03"), ("ACME", "A.io", "inv-1", "B", None, "2", "20", "2024-02-01"),
            ("acme", "a.io", "INV-1", "A", "S", "1", "5", "2024-01-01"), (None, "a.io", None, "A", "S", "1", "5", "2024-01-01")]
    df = usage(spark, rows, ["CustomerName", "CustomerDomainName", "InvoiceNumber", "MeterCategory", "MeterSubCategory", "Quantity",
                             "PricingPreTaxTotal", "UsageDate"])
    name = ("ACME", "A.io", "INV-1")
    lines, scopes = invoice.line_sums(df, batch=True), invoice.scope_sums(df, batch=True)
    items = invoice.invoice_items(lines, P).where("customer_name is not null").collect()
    assert {tuple(r)[:3] for r in items} == {name} and len(items) == 2
    for sums in (lines, scopes):
        totals = invoice.invoice_totals(sums, P).where("customer_name is not null").collect()
        assert [(tuple(t)[:3], t.pricing_raw) for t in totals] == [(name, "35.00")]
        period = invoice.invoice_period(sums).where("customer_name is not null").collect()
        assert [(tuple(p)[:3], p.period_start, p.period_end) for p in period] == [(name, "2024-01-01", "2024-02-01")]
    one = invoice.line_sums(df, invoice_scope("aCME", "A.IO", "Inv-1"))
    drop = ("customer_name", "customer_domain_name", "invoice_number")
    for part in (invoice.invoice_items, invoice.invoice_subtotals, invoice.invoice_totals, invoice.invoice_export):
        mine = part(lines, P).where("customer_name is not null").drop(*drop).collect()
        assert sorted(map(str, mine)) == sorted(map(str, part(one, P).collect()))
    assert invoice.invoice_totals(scopes, P).where("customer_name is null").count() == 1


def test_export_prints_missing_keys_last(spark):
    from meterbook.sources import exports

    rows = [("A", "Z"), ("A", None), (None, "Q")]
    df = usage(spark, [(*r, "1", "1") for r in rows], ["MeterCategory", "MeterSubCategory", "Quantity", "PricingPreTaxTotal"])
    out = exports.invoice_csv_rows(invoice.invoice_export(invoice.line_sums(df), P, order_keys=True), position="n").collect()
    assert [(r["Meter Category"], r["Meter Subcategory"], r["Tags"], r.n) for r in out] == [
        ("A", "Z", "", 1), ("A", "", "", 2), ("", "Q", "", 3), ("", "", "TOTAL", 4)]


def test_tags_are_distinct_trimmed_sorted(spark):
    rows = [("C", " b=2"), ("C", "a=1 "), ("C", "b=2"), ("C", "  "), ("C", None)]
    df = usage(spark, rows, ["MeterCategory", "Tags"])
    assert invoice.line_sums(df).first().tags == "a=1, b=2"
    none = usage(spark, [("C", None), ("C", " ")], ["MeterCategory", "Tags"])
    assert invoice.line_sums(none).first().tags is None


def test_unit_price_zero_quantity(spark):
    rows = [("C", "0", "5"), ("D", "n/a", "5")]
    df = usage(spark, rows, ["MeterCategory", "Quantity", "PricingPreTaxTotal"])
    got = {r.meter_category: (r.unit_price, r.unit_price_raw, r.quantity_raw) for r in invoice.invoice_items(invoice.line_sums(df), P).collect()}
    assert got == {"C": (0.0, "0.00", "0"), "D": (0.0, "0.00", "0")}


def test_export_rows_have_one_total(view001):
    rows = invoice.invoice_export(invoice.line_sums(view001), P)
    kinds = {r.row_kind: r.n for r in rows.groupBy("row_kind").agg(F.count("*").alias("n")).collect()}
    assert kinds[1] == 1 and kinds[0] == invoice.line_sums(view001).count()
    total = rows.where("row_kind = 1").first()
    assert total.tags == "TOTAL" and total.unit_price == ""


def test_period_label_of_fixture(view001):
    p = invoice.invoice_period(invoice.line_sums(view001)).first()
    assert (p.period_start, p.period_end) == ("1995-01-01", "2001-11-04") or p.period_label.startswith("Jan")
    assert " - " in p.period_label


def test_lowered_columns_are_used_and_agree(view001):
    lc = view001.withColumn("CustomerDomainName_lc", F.lower("CustomerDomainName")).withColumn(
        "ProductName_lc", F.lower("ProductName")).withColumn("CustomerName_lc", F.lower("CustomerName"))
    flt = UsageFilter(search="Gear", equals={"CustomerDomainName": "Building.Example.com"})
    assert "CustomerDomainName_lc" in str(flt.predicate(lc))
    assert "CustomerDomainName_lc" not in str(flt.predicate(view001))
    assert flt.apply(lc).count() == flt.apply(view001).count() > 0


def test_on_bad_number_null_counts_unreadable_amounts_as_missing(spark):
    df = usage(spark, [("a", "10", "1"), ("b", "abc", "2")], ["CustomerName", "PricingPreTaxTotal", "BillingPreTaxTotal"])
    s = summary.billing_summary(df, PricingParams(1.0, 1.0, 1.0), on_bad_number="null").first()
    assert (s.total_pricing, s.total_billing, s.total_records) == (10.0, 3.0, 2)
    ranked = {r.label: r.value for r in ranking.top_customers(df, 5, on_bad_number="null").collect()}
    assert ranked == {"a": 10.0, "b": 0.0}
    rows = {r.CustomerName: r.TotalVATInc for r in detail.priced_detail(df, P, on_bad_number="null").collect()}
    assert rows["b"] is None and rows["a"] == ((10.0 * 56.25) / 0.85) * 1.12
    with pytest.raises(Exception):
        detail.priced_detail(df, P).collect()
    with pytest.raises(ValueError):
        summary.billing_summary(df, P, on_bad_number="skip")


def test_keyset_paging_crosses_the_null_dates(spark):
    rows = [(f"r{i:02d}", None if i % 4 == 0 else f"2024-01-{(i % 9) + 1:02d}") for i in range(40)]
    df = usage(spark, rows, ["_row_id", "UsageDate"])
    full = [r._row_id for r in detail.detail_page(df, P, columns=["_row_id"], all_records=True).collect()]
    got, last = [], None
    while True:
        page = detail.detail_after(df, last[0] if last else "9999", last[1] if last else "", P, page_size=7).collect() \
            if last is not None else detail.detail_page(df, P, page=1, page_size=7).collect()
        if not page:
            break
        got += [r._row_id for r in page]
        last = (page[-1].UsageDate, page[-1]._row_id)
    assert got == full


def test_date_mode_orders_by_parsed_date(spark):
    df = usage(spark, [("a", "2024-1-9"), ("b", "2024-01-10"), ("c", "junk"), ("d", None)], ["_row_id", "UsageDate"])
    text = [r._row_id for r in detail.detail_page(df, P, columns=["_row_id"], all_records=True).collect()]
    dated = [r._row_id for r in detail.detail_page(df, P, columns=["_row_id"], all_records=True, date_mode="date").collect()]
    assert text == ["c", "a", "b", "d"]
    assert dated == ["b", "a", "c", "d"]


def test_invoice_bundle_shares_one_aggregate(view001):
    one = view001.select("CustomerName", "CustomerDomainName").orderBy("CustomerName").first()
    inv = invoice.build_invoice(view001, P, invoice_scope(one.CustomerName, one.CustomerDomainName)).persist()
    try:
        items = inv.items.collect()
        assert items and inv.totals.count() == 1 and inv.period.count() == 1
        assert inv.export_rows.count() == len(items) + 1
        assert inv.subtotals.where("level = 'total'").count() == 1
        plan = inv.totals._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" in plan
    finally:
        inv.sums.unpersist()


def test_with_grid_pricing_appends_to_all_columns(view001):
    from meterbook.operators.pricing import with_grid_pricing

    out = with_grid_pricing(view001, P)
    assert out.columns[: len(view001.columns)] == view001.columns
    assert out.columns[len(view001.columns):] == ["Forex", "PreTaxWithForex", "Margin", "TotalVATEx", "VAT", "TotalVATInc"]


def test_all_domains_first_by_name(view001):
    got = [r.CustomerDomainName for r in choices.all_domains(view001).collect()]
    assert got == sorted(got) and len(got) == 10  # five segments in two spellings


def test_line_order_sorts_items(view001):
    items = invoice.invoice_items(invoice.line_sums(view001), P).orderBy(*invoice.line_order()).collect()
    keys = [(r.meter_category, r.meter_sub_category or "￿", r.meter_name) for r in items]
    assert keys == sorted(keys)


def test_dashboard_answers_equal_the_separate_reports(view001):
    from meterbook.operators import dashboard as dash

    d = dash.dashboard(view001, P).persist()
    try:
        assert d.summary.collect() == summary.billing_summary(view001, P).collect()
        assert d.top_customers(10).collect() == ranking.top_customers(view001, 10).collect()
        assert sorted(d.daily_spend.collect()) == sorted(summary.daily_spend(view001).collect())
        flt = UsageFilter(search="gear")
        assert dash.dashboard(view001, P, flt).summary.collect() == summary.billing_summary(view001, P, flt).collect()
    finally:
        d.rollup.unpersist()


def test_period_text_mode_compares_strings(spark):
    rows = [("C", "2024-1-9", "2024-1-9", "2024-1-9"), ("C", "2024-01-10", "2024-01-10", "2024-01-10")]
    df = usage(spark, rows, ["MeterCategory", "UsageDate", "ChargeStartDate", "ChargeEndDate"])
    text = invoice.invoice_period(invoice.line_sums(df, with_tags=False, period_mode="text")).first()
    dated = invoice.invoice_period(invoice.line_sums(df, with_tags=False)).first()
    assert (text.period_start, text.period_end) == ("2024-01-10", "2024-1-9")      # string order
    assert (dated.period_start, dated.period_end) == ("2024-01-09", "2024-01-10")  # date order
    assert dated.period_label == "January 2024"
    with pytest.raises(ValueError):
        invoice.line_sums(df, period_mode="week")


def test_filter_without_drops_columns(view001):
    f = UsageFilter(search="gear", equals={"ChargeType": "new", "CustomerName": "x"}, contains={"MeterName": "gear"})
    g = f.without("CustomerName", "MeterName")
    assert g.search == "gear" and g.equals == {"ChargeType": "new"} and g.contains == {}
    assert detail.detail_count(view001, g).first().total > 0


def _exchanges(df):
    """Shuffles of the physical plan, the broadcasts of dimension tables aside."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Round|Single)", plan))


def test_batch_lines_are_dealt_out_once(spark):
    """After its first aggregate a batch is shuffled by invoice only: lines, tags, spelling and subtotals follow in place."""
    rows = [("Ann", "a.x", "INV-1", "compute", "v2", "t2", "1", "10"), ("ANN", "A.x", "inv-1", "compute", "v1", " t1", "2", "20"),
            ("ann", "a.x", "INV-1", "disk", None, None, "x", "5"), ("Bo", None, None, "compute", "", "t", "0", None), ("Bo", None, None, None, None, "t", "3", "1.5")]
    df = usage(spark, rows, ["CustomerName", "CustomerDomainName", "InvoiceNumber", "MeterCategory", "MeterSubCategory", "Tags", "Quantity", "PricingPreTaxTotal"])
    df = df.repartition(3).localCheckpoint()
    items = invoice.invoice_items(invoice.line_sums(df, batch=True), P)
    subtotals = invoice.invoice_subtotals(invoice.line_sums(df, batch=True, with_tags=False), P)
    assert _exchanges(items) == 2
    assert _exchanges(subtotals) <= 4  # lines and totals read the same two
    assert {(r.customer_name, r.customer_domain_name, r.invoice_number) for r in items.collect()} == {("ANN", "A.x", "INV-1"), ("Bo", None, None)}
    found = {(r.customer_name, r.level, r.meter_category, r.meter_sub_category): r.subtotal_quantity for r in subtotals.collect()}
    assert found == {("ANN", "subtotal", "compute", "v1"): 2.0, ("ANN", "subtotal", "compute", "v2"): 1.0, ("ANN", "subtotal", "disk", None): 0.0, ("ANN", "total", None, None): 3.0,
                     ("Bo", "subtotal", "compute", ""): 0.0, ("Bo", "subtotal", None, None): 3.0, ("Bo", "total", None, None): 3.0}


@pytest.mark.parametrize("period_mode", ["date", "text"])
@pytest.mark.parametrize("stored", [False, True])
def test_batch_by_rows_is_the_batch_by_sums(spark, view001, stored, period_mode):
    """Rows dealt out first give the same sums, one shuffle less."""
    from meterbook.sources import warehouse

    odd = [("Ann", "a.x", "INV-1", "compute", "v2", "\x1e", "t\x1f2", "1", "10", "2024-01-03", None), ("ANN", "A.x", "inv-1", "compute", "v2", "\x1e", " t1", "2", "20", None, "2024-02-01"),
           ("ann", "a.x", "INV-1", "disk", None, None, None, "x", "5", "bad", "2024-01-01"), ("Bo", None, None, None, None, "", "  ", None, "1.5", None, None)]
    names = ["CustomerName", "CustomerDomainName", "InvoiceNumber", "MeterCategory", "MeterSubCategory", "MeterName", "Tags", "Quantity", "PricingPreTaxTotal", "UsageDate", "ChargeStartDate"]
    df = usage(spark, odd, names).unionByName(view001.drop("_row_id"), allowMissingColumns=True)
    if stored:
        df = warehouse.prepare(df, 1)
    for with_tags in (True, False):
        by_sums = invoice.line_sums(df, batch=True, with_tags=with_tags, period_mode=period_mode)
        by_rows = invoice.line_sums(df, batch=True, with_tags=with_tags, period_mode=period_mode, rows_first=True)
        assert by_rows.dtypes == by_sums.dtypes
        assert _exchanges(by_rows) == _exchanges(by_sums) - 1
        assert sorted(map(str, by_rows.collect())) == sorted(map(str, by_sums.collect()))


def test_batch_query_shuffles_each_row_once(spark):
    """one shuffle besides those of the joins."""
    assert _exchanges(catalog.q_invoice_batch(spark, SF01)) == _exchanges(billing_view(spark, SF01)) + 1


def test_batch_subtotals_query_shuffles_each_row_once(spark):
    """subtotals and totals, the two branches of the plan, read one shuffle besides those of the joins."""
    assert _exchanges(catalog.q_invoice_batch_subtotals(spark, SF01)) == 2 * (_exchanges(billing_view(spark, SF01)) + 1)

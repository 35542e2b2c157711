"""CSV landing (golden edge cases vs DuckDB), warehouse, manifest, delete, exports, streaming."""

import glob
import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from meterbook import PricingParams
from meterbook.operators import detail, invoice
from meterbook.schema import USAGE_COLUMNS
from meterbook.sources import exports
from meterbook.sources import manifest as mf
from meterbook.sources import usage_csv, warehouse as wh
from meterbook.streaming.landing import start_landing

P = PricingParams(forex=56.25, margin=0.85, vat=1.12)

EDGE = (
    'CustomerName,Tags,Quantity\n'
    'x,"{""k"": ""v"", ""m"":1}",1\n'
    'z,,"3"\n'
    'short,1\n'
    'long,1,2,3\n'
    'q,"",9\n'
)


def _write(path, text):
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


def _duck_rows(path, cols):
    sql = f"SELECT {', '.join(cols)} FROM read_csv('{path}', header=true, all_varchar=true, ignore_errors=true)"
    return sorted(duckdb.connect().execute(sql).fetchall(), key=str)


def test_edge_csv_matches_duckdb(spark, tmp_path):
    path = _write(tmp_path / "edge.csv", EDGE)
    df = usage_csv.read_usage_csv(spark, str(path)).persist()
    cols = ["CustomerName", "Tags", "Quantity"]
    good = sorted((tuple(r) for r in usage_csv.well_formed(df).select(*cols).collect()), key=str)
    assert good == _duck_rows(path, cols)
    assert dict(good_row[:2] for good_row in good)["x"] == '{"k": "v", "m":1}'
    bad = [r._corrupt_record for r in usage_csv.rejects(df).collect()]
    assert sorted(bad) == ["long,1,2,3", "short,1"]


def test_quoted_newlines_are_accepted(spark, tmp_path):
    path = _write(tmp_path / "nl.csv", 'CustomerName,Tags,Quantity\ny,"line1\nline2",2\nw,t,4\n')
    df = usage_csv.read_usage_csv(spark, str(path))
    rows = sorted(tuple(r) for r in usage_csv.well_formed(df).select("CustomerName", "Tags", "Quantity").collect())
    assert rows == _duck_rows(path, ["CustomerName", "Tags", "Quantity"])
    assert ("y", "line1\nline2", "2") in rows
    landing = wh.land_upload(spark, str(path), str(tmp_path / "wh"), str(tmp_path / "mf"), 1)
    assert (landing.row_count, landing.reject_count) == (2, 0)


def test_columns_matched_by_header_name(spark, tmp_path):
    a = _write(tmp_path / "a.csv", "Quantity,CustomerName,Extra\n5,Acme,e1\n")
    b = _write(tmp_path / "b.csv", "CustomerName,Quantity\nBeta,7\n")
    df = usage_csv.read_usage_csv(spark, [str(a), str(b)])
    rows = sorted((r.CustomerName, r.Quantity, r.Extra) for r in df.collect())
    assert rows == [("Acme", "5", "e1"), ("Beta", "7", None)]
    assert df.columns[: len(USAGE_COLUMNS)] == list(USAGE_COLUMNS)
    lean = usage_csv.read_usage_csv(spark, [str(a)], keep_extra_columns=False)
    assert "Extra" not in lean.columns


def test_file_checks(spark, tmp_path, monkeypatch):
    good = _write(tmp_path / "ok.CSV", "CustomerName\nA\n")
    other = _write(tmp_path / "notes.txt", "hello\n")
    rows = {os.path.basename(r.path): (r.accepted, r.reason) for r in usage_csv.list_usage_files(spark, str(tmp_path)).collect()}
    assert rows["ok.CSV"] == (True, None) and rows["notes.txt"] == (False, "not a .csv file")
    assert usage_csv.list_usage_files(spark, str(good)).first().accepted  # no limit unless asked
    big = usage_csv.list_usage_files(spark, str(good), max_mb=0).first()
    assert not big.accepted and "larger than" in big.reason
    assert other


@pytest.mark.parametrize("n", [1, 16, 17, 40])
def test_one_header_rule_for_any_number_of_files(spark, tmp_path, n):
    """Blank first lines, repeated and empty header names read alike in few and in many files."""
    files = [str(_write(tmp_path / f"f{i:02d}.csv", f"\n\ncustomername,X,X,,QUANTITY\nC{i},1,2,3,{i}\n")) for i in range(n)]
    df = usage_csv.read_usage_csv(spark, files)
    assert sorted((r.CustomerName, r.Quantity) for r in df.collect()) == sorted((f"C{i}", str(i)) for i in range(n))
    assert all(r._corrupt_record is None for r in df.collect())
    extras = [c for c in df.columns if c not in USAGE_COLUMNS and not c.startswith("_corrupt") and c != "_source_file"]
    assert len(extras) == 3


def test_header_case_is_ignored_and_a_given_header_is_checked(spark, tmp_path):
    path = str(_write(tmp_path / "c.csv", "customerNAME,quantity\nAcme,5\n"))
    landing = wh.land_upload(spark, path, str(tmp_path / "wh"), str(tmp_path / "mf"), 1)
    row = wh.read_uploads(spark, str(tmp_path / "wh"), 1).first()
    assert landing.row_count == 1 and (row.CustomerName, row.Quantity, row.CustomerName_lc) == ("Acme", "5", "acme")
    with pytest.raises(Exception):
        usage_csv.read_usage_csv(spark, path, header=["Quantity", "CustomerName"]).collect()


def test_empty_and_failed_relanding_replace(spark, tmp_path):
    root, man = str(tmp_path / "wh"), str(tmp_path / "mf")
    full = str(_write(tmp_path / "a.csv", "CustomerName,Quantity\nA,1\nB,2\n"))
    empty = str(_write(tmp_path / "b.csv", "CustomerName,Quantity\n"))
    wh.land_upload(spark, full, root, man, 1)
    assert wh.land_upload(spark, empty, root, man, 1).row_count == 0
    assert wh.read_uploads(spark, root, 1).count() == 0
    wh.land_upload(spark, full, root, man, 1)
    with pytest.raises(ValueError):
        wh.land_upload(spark, str(_write(tmp_path / "a.txt", "x")), root, man, 1)
    assert wh.read_uploads(spark, root, 1).count() == 0
    assert mf.latest(mf.read(spark, man)).first().status == "failed"


def test_reads_over_uploads_keep_columns_and_pages(spark, tmp_path):
    root, man = str(tmp_path / "wh"), str(tmp_path / "mf")
    for k in (1, 2):
        rows = "".join(f"C{k}{i},2024-01-0{1 + i % 3},1,1,e{k}\n" for i in range(7))
        path = str(_write(tmp_path / f"{k}.csv", f"CustomerName,UsageDate,PricingPreTaxTotal,Quantity,Extra{k}\n" + rows))
        wh.land_upload(spark, path, root, man, k)
    both = wh.read_uploads(spark, root, manifest_root=man)
    assert {"Extra1", "Extra2"} <= set(both.columns)
    assert both.agg(F.count("Extra1"), F.count("Extra2")).first()[:] == (7, 7)
    for mode in ("text", "date"):
        seen, last = [], None
        while True:
            page = (detail.detail_page(both, P, page_size=4, date_mode=mode) if last is None else
                    detail.detail_after(both, last.UsageDate, last._row_id, P, page_size=4, last_upload_id=last.upload_id, date_mode=mode))
            rows = page.collect()
            if not rows:
                break
            seen += [r.CustomerName for r in rows]
            last = rows[-1]
        assert len(seen) == len(set(seen)) == 14
    assert both.where(F.col("UsageDate_day").isNull()).count() == 0


@pytest.fixture(scope="module")
def usage_files(spark, view001, tmp_path_factory):
    """The sf0.001 usage table as CSV exports: one file, and the same rows in four files."""
    base = tmp_path_factory.mktemp("csv")
    cols = [F.col(c) if c in view001.columns else F.lit(None).cast("string").alias(c) for c in USAGE_COLUMNS]
    rows = view001.select(*cols, "_row_id")
    exports.write_grid_csv(rows.drop("_row_id").coalesce(1), str(base / "one"))
    exports.write_grid_csv(rows.repartition(4, "_row_id").drop("_row_id"), str(base / "four"))
    return sorted(glob.glob(str(base / "one" / "*.csv"))), sorted(glob.glob(str(base / "four" / "*.csv")))


def test_land_replace_and_delete(spark, usage_files, tmp_path, view001):
    one, four = usage_files
    root, man = str(tmp_path / "wh"), str(tmp_path / "mf")
    landing = wh.land_upload(spark, one, root, man, 1, "usage.csv", 3)
    assert (landing.row_count, landing.reject_count) == (6000, 0)
    wh.land_upload(spark, four, root, man, 2, "usage-split.csv", 3)
    wh.land_upload(spark, one, root, man, 1, "usage.csv", 3)  # re-land replaces
    state = {r.upload_id: r for r in mf.latest(mf.read(spark, man)).collect()}
    assert state[1].status == state[2].status == "completed"
    assert state[1].row_count == 6000 and state[1].usage_start is not None
    assert wh.read_uploads(spark, root).groupBy("upload_id").count().orderBy("upload_id").collect()[0]["count"] == 6000

    # one-file run equals split-file run, and both equal the source table
    def lines(df):
        return sorted(map(tuple, invoice.invoice_items(invoice.line_sums(df), P).collect()), key=str)

    assert lines(wh.read_uploads(spark, root, 1)) == lines(wh.read_uploads(spark, root, 2)) == lines(view001)

    # newest completed upload, recent list
    assert mf.newest_completed(mf.latest(mf.read(spark, man))).first().upload_id in (1, 2)
    assert mf.recent(mf.latest(mf.read(spark, man)), 1).count() == 1
    shown = {r.upload_id: r for r in mf.listing(mf.latest(mf.read(spark, man))).collect()}
    assert shown[1].rows_text == "6,000" and shown[1].completed_text != "-" and shown[1].error_text == ""
    assert len(shown[1].created_text) == 16 and "," in shown[1].pricing_text
    picks = mf.upload_choices(mf.latest(mf.read(spark, man))).collect()
    assert {p.upload_id for p in picks} == {1, 2} and picks[0].label.endswith("usage-split.csv")

    wh.delete_upload(spark, root, man, 1)
    state = {r.upload_id: r.status for r in mf.latest(mf.read(spark, man)).collect()}
    assert state == {1: "deleted", 2: "completed"}
    assert [r.upload_id for r in wh.read_uploads(spark, root).select("upload_id").distinct().collect()] == [2]
    assert wh.read_uploads(spark, root, manifest_root=man).select("upload_id").distinct().count() == 1
    assert wh.read_uploads(spark, root, 1).count() == 0  # deleted: empty, not an error


def test_failed_landing_is_recorded(spark, tmp_path):
    bad = _write(tmp_path / "usage.txt", "CustomerName\nA\n")
    man = str(tmp_path / "mf")
    with pytest.raises(ValueError, match="not a .csv"):
        wh.land_upload(spark, str(bad), str(tmp_path / "wh"), man, 9, "usage.txt")
    row = mf.latest(mf.read(spark, man)).first()
    assert row.status == "failed" and "not a .csv" in row.error_message
    assert mf.completed(mf.latest(mf.read(spark, man))).count() == 0


def test_rejects_are_kept_and_counted(spark, tmp_path):
    path = _write(tmp_path / "edge.csv", EDGE)
    root, man = str(tmp_path / "wh"), str(tmp_path / "mf")
    landing = wh.land_upload(spark, str(path), root, man, 5)
    assert (landing.row_count, landing.reject_count) == (3, 2)
    assert wh.read_rejects(spark, root, 5).count() == 2
    assert wh.read_uploads(spark, root, 5).count() == 3


def test_invoice_csv_export(spark, view001, tmp_path):
    rows = invoice.invoice_export(invoice.line_sums(view001), P, order_keys=True)
    out = str(tmp_path / "inv")
    exports.write_invoice_csv(rows, out, single_file=True)
    files = glob.glob(out + "/*.csv")
    assert len(files) == 1
    raw = open(files[0], newline="").read()
    lines = raw.split("\r\n")
    assert lines[0] == ",".join(exports.INVOICE_CSV_HEADERS)
    body = [x for x in lines[1:] if x]
    assert body[-1].split(",")[8] == "TOTAL" and len(body) == rows.count()
    assert '"' in raw  # tags joined with ", " are quoted
    back = spark.read.options(header=True, escape='"', multiLine=True).csv(out)
    shown = [r[0] for r in back.select("Meter Category").collect()][:-1]
    assert shown == sorted((c for c in shown if c is not None)) + [c for c in shown if c is None]  # nulls last
    total = back.where(F.col("Tags") == "TOTAL").first()
    t = invoice.invoice_totals(invoice.line_sums(view001), P).first()
    assert total["Total VAT Inc"] == t.total_vat_inc_raw and total["Quantity"] == t.quantity_raw


def test_grid_export_round_trip(spark, view001, tmp_path):
    out = str(tmp_path / "grid")
    exports.write_grid_csv(view001, out)
    back = spark.read.options(header=True, escape='"').schema(view001.schema).csv(out)
    norm = [F.nullif(F.col(c), F.lit("")).alias(c) for c in view001.columns]
    assert back.select(*norm).exceptAll(view001.select(*norm)).count() == 0
    assert back.count() == view001.count()


def test_json_export(spark, view001, tmp_path):
    items = invoice.invoice_items(invoice.line_sums(view001), P)
    exports.write_invoice_json(items, str(tmp_path / "json"))
    back = spark.read.json(str(tmp_path / "json"))
    assert back.count() == items.count()
    assert exports.items_json(items).first().json.startswith("{")


def test_streaming_landing_is_exactly_once(spark, usage_files, tmp_path):
    one, four = usage_files
    src = tmp_path / "in"
    src.mkdir()
    shutil.copy(one[0], src / "jan.csv")
    root, man, ck = str(tmp_path / "wh"), str(tmp_path / "mf"), str(tmp_path / "ck")
    start_landing(spark, str(src), root, man, ck).awaitTermination()
    assert spark.read.parquet(root).count() == 6000
    start_landing(spark, str(src), root, man, ck).awaitTermination()  # nothing new
    assert spark.read.parquet(root).count() == 6000
    shutil.copy(four[0], src / "feb.csv")
    start_landing(spark, str(src), root, man, ck).awaitTermination()
    state = mf.latest(mf.read(spark, man)).collect()
    assert len(state) == 2 and {r.status for r in state} == {"completed"}
    assert spark.read.parquet(root).count() == 6000 + sum(r.row_count for r in state if r.original_filename == "feb.csv")


def test_parsed_amounts_keep_strict_and_lenient_rules(spark, tmp_path):
    from meterbook.operators import ranking, summary

    text = ("CustomerName,PricingPreTaxTotal,BillingPreTaxTotal,Quantity,MeterCategory\n"
            "a,10.5,1,2,C\nb,abc,2,n/a,C\nc,,3,1,C\n")
    path = _write(tmp_path / "amounts.csv", text)
    root, man = str(tmp_path / "wh"), str(tmp_path / "mf")
    wh.land_upload(spark, str(path), root, man, 3)
    stored = wh.read_uploads(spark, root, 3)
    assert "PricingPreTaxTotal_dec" in stored.columns
    assert "PricingPreTaxTotal_dec" not in detail.priced_detail(stored, P).columns
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        summary.billing_summary(stored, P).collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ranking.top_customers(stored, 3).collect()
    prof = summary.ingest_profile(stored).first()
    assert prof.pricing_pretax_total == 10.5 and prof.row_count == 3
    line = invoice.invoice_items(invoice.line_sums(stored), P).first()
    assert (line.quantity_raw, line.pricing_pretax_total_raw) == ("3", "10.50")
    # same answers as reading the text directly
    raw = stored.drop(*[c for c in stored.columns if c.endswith("_dec")])
    assert invoice.invoice_items(invoice.line_sums(raw), P).first() == line
    good = stored.where("CustomerName <> 'b'")
    assert summary.billing_summary(good, P).first() == summary.billing_summary(
        good.drop(*[c for c in good.columns if c.endswith("_dec")]), P).first()


def test_shared_dir_reads_the_session_setting(spark):
    from meterbook.session import shared_dir

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = shared_dir(spark, "x")
    assert path.endswith("/x") and (base is None or path.startswith(base.rstrip("/")))


def test_clustered_landing_keeps_rows_and_clusters_customers(spark, usage_files, tmp_path, view001):
    one, _ = usage_files
    root, man = str(tmp_path / "wh"), str(tmp_path / "mf")
    wh.land_upload(spark, one, root, man, 4, cluster_files=3)
    stored = wh.read_uploads(spark, root, 4)
    assert stored.count() == 6000 and len(glob.glob(root + "/upload_id=4/*.parquet")) == 3
    with_file = stored.select("CustomerName", F.col("_metadata.file_path").alias("f"))
    files_per_customer = with_file.groupBy("CustomerName").agg(F.countDistinct("f").alias("n"))
    assert files_per_customer.agg(F.max("n")).first()[0] <= 2
    def lines(df):
        return sorted(map(tuple, invoice.invoice_items(invoice.line_sums(df), P).collect()), key=str)
    assert lines(stored) == lines(view001)


def test_streaming_matches_headers_by_name_and_records_failures(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _write(src / "odd.csv", "quantity,Foo,customername\n1,2,Acme\n")
    _write(src / "plain.CSV", "CustomerName,Quantity\nBeta,3\n")
    _write(src / "large.csv", "CustomerName,Quantity\n" + "C,1\n" * 100_000)
    root, man = str(tmp_path / "wh"), str(tmp_path / "mf")
    start_landing(spark, str(src), root, man, str(tmp_path / "ck"), max_mb=0.1).awaitTermination()
    state = {r.original_filename: r for r in mf.latest(mf.read(spark, man)).collect()}
    assert {n: r.status for n, r in state.items()} == {"odd.csv": "completed", "plain.CSV": "completed", "large.csv": "failed"}
    assert "larger than" in state["large.csv"].error_message
    rows = wh.read_uploads(spark, root, manifest_root=man)
    assert sorted((r.CustomerName, r.Quantity) for r in rows.collect()) == [("Acme", "1"), ("Beta", "3")]


def test_two_streams_share_a_manifest(spark, tmp_path):
    root, man = str(tmp_path / "wh"), str(tmp_path / "mf")
    for k in (1, 2):
        src = tmp_path / f"in{k}"
        src.mkdir()
        _write(src / "x.csv", f"CustomerName,Quantity\nC{k},1\n")
        start_landing(spark, str(src), root, man, str(tmp_path / f"ck{k}")).awaitTermination()
    state = mf.latest(mf.read(spark, man))
    assert [r.status for r in state.collect()] == ["completed", "completed"]
    assert wh.read_uploads(spark, root, manifest_root=man).count() == 2
    start_landing(spark, str(tmp_path / "in1"), root, man, str(tmp_path / "ck3")).awaitTermination()  # again, from a new checkpoint
    assert mf.latest(mf.read(spark, man)).count() == 2 and wh.read_uploads(spark, root).count() == 2
    mf.compacted(spark, man, str(tmp_path / "mf2"))
    assert mf.read(spark, str(tmp_path / "mf2")).count() == 2


def test_batch_and_stream_landings_use_one_clock(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        root, man, src = str(tmp_path / "wh"), str(tmp_path / "mf"), tmp_path / "in"
        src.mkdir()
        wh.land_upload(spark, str(_write(tmp_path / "a.csv", "CustomerName\nA\n")), root, man, 1)
        _write(src / "b.csv", "CustomerName\nB\n")
        start_landing(spark, str(src), root, man, str(tmp_path / "ck")).awaitTermination()
        newest = mf.newest_completed(mf.latest(mf.read(spark, man))).first().upload_id
        assert newest != 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_usage_view_serves_sql_and_hides_helpers(spark, tmp_path):
    path = _write(tmp_path / "u.csv", "CustomerName,PricingPreTaxTotal\nAcme,10\nBeta,5\n")
    root, man = str(tmp_path / "wh"), str(tmp_path / "mf")
    wh.land_upload(spark, str(path), root, man, 11)
    df = wh.usage_view(spark, root, 11, name="usage_11")
    assert "CustomerName_lc" in df.columns and "CustomerName_lc" not in wh.visible_columns(df)
    total = spark.sql("SELECT SUM(PricingPreTaxTotal_dec) AS t FROM usage_11 WHERE CustomerName_lc = 'acme'").first().t
    assert float(total) == 10.0


def test_streaming_landing_in_small_batches(spark, usage_files, tmp_path):
    _, four = usage_files
    src = tmp_path / "in"
    src.mkdir()
    for i, f in enumerate(four):
        shutil.copy(f, src / f"m{i}.csv")
    root, man, ck = str(tmp_path / "wh"), str(tmp_path / "mf"), str(tmp_path / "ck")
    start_landing(spark, str(src), root, man, ck, max_files_per_trigger=1).awaitTermination()
    state = mf.latest(mf.read(spark, man)).collect()
    assert len(state) == len(four) and sum(r.row_count for r in state) == 6000
    batches = [f for f in os.listdir(tmp_path / "ck" / "commits") if f.isdigit()]
    assert len(batches) == len(four)  # one micro-batch per file


def test_catalog_table_tracks_landings_and_deletes(spark, tmp_path):
    path = _write(tmp_path / "u.csv", "CustomerName,PricingPreTaxTotal\nAcme,10\nBeta,5\n")
    root, man = str(tmp_path / "wh"), str(tmp_path / "mf")
    name = "usage_catalog_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    wh.land_upload(spark, str(path), root, man, 1)
    wh.register_table(spark, root, name)
    wh.land_upload(spark, str(path), root, man, 2, table=name)
    parts = sorted(r.partition for r in spark.sql(f"SHOW PARTITIONS {name}").collect())
    assert parts == ["upload_id=1", "upload_id=2"]
    assert wh.read_uploads(spark, root, 2, table=name).count() == 2
    wh.delete_upload(spark, root, man, 1, table=name)
    assert [r.partition for r in spark.sql(f"SHOW PARTITIONS {name}").collect()] == ["upload_id=2"]
    assert wh.read_uploads(spark, root, table=name).count() == 2
    spark.sql(f"DROP TABLE IF EXISTS {name}")

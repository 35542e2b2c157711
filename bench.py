"""Benchmark: land one usage CSV upload, then answer the dashboard and invoice requests.

Setup (not timed): the usage table is derived from the driver's tables in $BENCH_SF_DIR
and written as one CSV export, the input the product receives (about 150 MB at sf0.1).
All files go to a new folder under the session's shared ``spark.checkpoint.dir``.

Timed steps, on local[$BENCH_CPUS]:
  ingest            CSV → warehouse partition (+ profile and manifest entries); best of
                    $BENCH_RUNS landings after one untimed warm-up landing
  <query>           each report over the landed upload, run to completion with the
                    no-op sink (nothing is collected); best of $BENCH_RUNS runs
Prints one JSON line: {"metric", "value" (sum of steps, seconds), "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from meterbook import PricingParams, UsageFilter, invoice_scope  # noqa: E402
from meterbook.operators import choices, dashboard, detail, invoice, ranking, summary  # noqa: E402
from meterbook.schema import USAGE_COLUMNS  # noqa: E402
from meterbook.session import shared_dir  # noqa: E402
from meterbook.sources import exports, warehouse as wh  # noqa: E402
from meterbook.sources.fixture import billing_view  # noqa: E402
from meterbook.sources.usage_csv import list_usage_files  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
P = PricingParams(forex=56.25, margin=0.85, vat=1.12)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("meterbook-bench")
        .config("spark.sql.shuffle.partitions", str(max(8, int(CPUS) * 2)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        # throughput collector: the single local JVM runs batch work, pauses do not matter
        .config("spark.driver.extraJavaOptions", "-XX:+UseParallelGC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn, runs=RUNS) -> float:
    best = float("inf")
    for _ in range(runs):
        t0 = time.perf_counter()
        fn()
        best = min(best, time.perf_counter() - t0)
    return round(best, 3)


def main() -> None:
    spark = session()
    base = shared_dir(spark, f"meterbook-bench-{uuid.uuid4().hex[:12]}")
    csv_dir, root, man = f"{base}/upload_csv", f"{base}/warehouse", f"{base}/manifest"

    view = billing_view(spark, SF_DIR)
    cols = [F.col(c) if c in view.columns else F.lit(None).cast("string").alias(c) for c in USAGE_COLUMNS]
    exports.write_grid_csv(view.select(*cols).coalesce(1), csv_dir)
    files = list_usage_files(spark, csv_dir).where("accepted").collect()
    csv_files, csv_mb = sorted(f.path for f in files), sum(f.size for f in files) / 2**20

    times: dict[str, float] = {}
    # the export has no quoted newlines, so Spark may split the file
    wh.land_upload(spark, csv_files, root, man, 0, "warm-up.csv", 1, multi_line=False)  # JVM / JIT warm-up, not timed
    landings = []
    # re-landing upload 1 replaces its partition, so every run does the same work
    times["ingest"] = timed(lambda: landings.append(wh.land_upload(spark, csv_files, root, man, 1, "usage.csv", 1, multi_line=False)))
    landing = landings[-1]

    up = wh.read_uploads(spark, root, 1)
    one = up.where("trim(coalesce(InvoiceNumber, '')) <> ''").select(
        "CustomerName", "CustomerDomainName", "InvoiceNumber").first()
    scope = invoice_scope(one.CustomerName, one.CustomerDomainName)
    search = UsageFilter(search="gear", equals={"ChargeType": "new"})

    steps = {
        "detail_page": lambda: detail.detail_page(up, P, page=3, page_size=100),
        "detail_all_records": lambda: detail.detail_page(up, P, all_records=True),
        "detail_count": lambda: detail.detail_count(up, search),
        "search_detail": lambda: detail.priced_detail(up, P, UsageFilter(search="ReD%Get")),
        "filter_customer": lambda: detail.priced_detail(up, P, scope),
        "billing_summary": lambda: summary.billing_summary(up, P),
        "top_customers": lambda: ranking.top_customers(up, 10),
        "invoice_list": lambda: choices.invoice_list(up, limit=1000),
        "filter_options": lambda: choices.filter_options(up),
        "customer_domains": lambda: choices.customer_domains(up),
        "daily_spend": lambda: summary.daily_spend(up),
        "dashboard_refresh": lambda: dashboard.dashboard_rollup(up),
        "invoice_customer": lambda: invoice.invoice_items(invoice.line_sums(up, scope), P),
        "invoice_lines": lambda: invoice.invoice_items(invoice.line_sums(up), P),
        "invoice_subtotals": lambda: invoice.invoice_subtotals(invoice.line_sums(up, with_tags=False), P),
        "invoice_totals": lambda: invoice.invoice_totals(invoice.scope_sums(up), P),
        "invoice_batch": lambda: invoice.invoice_items(invoice.line_sums(up, batch=True), P),
    }
    for name, build in steps.items():
        times[name] = timed(lambda: run(build()))

    sf = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({
        "metric": "ingest_plus_reports_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf.group(1)) if sf else SF_DIR,
        "rows": landing.row_count,
        "csv_mb": round(csv_mb, 1),
        "cpus": int(CPUS),
        "runs_per_query": RUNS,
    }))


if __name__ == "__main__":
    main()

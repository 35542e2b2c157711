"""Deep pages of the consumption detail: a sorted copy of the rows that knows its row counts.

The copy is range-partitioned in detail order into files of a set number of rows (many files: into
fewer ranges that are cut into files once sorted), and a small
index holds, for each file, how many rows come before it. A page at any depth reads the index and
the one or two files that hold it, where an offset over the plain table sorts all rows before it.

An index belongs to the rows it was built from (one upload, or any selection of them) and is built
anew, under a new folder, when those change."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterbook.functions.text import packed, unpacked
from meterbook.operators.detail import detail_order
from meterbook.operators.positions import PART, PLACE, part_starts, placed
from meterbook.schema import ROW_ID, UPLOAD_ID
from meterbook.session import remove_folder, shuffles_removed

ROWS_PER_FILE = 1_000_000
# Ranges of one shuffle up to which a task writes each range as it comes, without holding its rows
# (spark.shuffle.sort.bypassMergeThreshold), and the rows of a range from which there are more.
RANGES, RANGE_ROWS = 200, 2_000_000


def build(df: DataFrame, root: str, rows_per_file: int = ROWS_PER_FILE, date_mode: str = "text") -> None:
    """Write the sorted copy of ``df`` and its index under the new folder ``root``. One shuffle.

    The rows are first written as they come: counted, sampled and sorted from there, they are
    worked out once, and the shuffles that they took are gone before the one that sorts them."""
    spark = df.sparkSession
    staged = f"{root}/staged"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(staged)
        _write_sorted(spark.read.schema(df.schema).parquet(staged), root, rows_per_file, date_mode)
    remove_folder(spark, staged)
    starts = part_starts(spark.read.parquet(f"{root}/rows"))
    schema = f"{PART} int, start long, size long"
    spark.createDataFrame(starts, schema).coalesce(1).write.parquet(f"{root}/index")  # written last: a folder without it is not an index


def _write_sorted(df: DataFrame, root: str, rows_per_file: int, date_mode: str) -> None:
    total = df.count()
    files = math.ceil(total / rows_per_file)
    ranges = min(files, max(RANGES, math.ceil(total / RANGE_ROWS)))
    if ranges * files >= 1 << 31:  # a part's number is an int
        ranges = files
    texts = [c for c, kind in df.dtypes if kind == "string" and c not in ("UsageDate", UPLOAD_ID, ROW_ID)]  # not those of the order
    narrow = df.select(*[c for c in df.columns if c not in texts], packed(texts).alias("_texts")) if texts else df
    rows = placed(narrow, detail_order(narrow, date_mode=date_mode), max(1, ranges))
    if texts:
        rows = unpacked(rows, "_texts", texts).select(*df.columns, PART, PLACE)
    if ranges < files:
        cut = F.floor(F.col(PLACE) / rows_per_file).cast("int")
        rows = rows.withColumns({PART: F.col(PART) * files + cut, PLACE: F.col(PLACE) % rows_per_file})
    if files:
        rows.write.option("compression", "zstd").partitionBy(PART).parquet(f"{root}/rows")
    else:  # a partitioned write of no rows leaves no file, and so no schema
        rows.drop(PART).write.parquet(f"{root}/rows/{PART}=0")


def index(spark: SparkSession, root: str) -> DataFrame:
    """One row per file: its part, the rows before it and the rows in it."""
    return spark.read.schema(f"{PART} int, start long, size long").parquet(f"{root}/index")


def page(spark: SparkSession, root: str, page: int, page_size: int) -> DataFrame:
    """Rows ``(page - 1) * page_size + 1`` to ``page * page_size`` in detail order, with their
    1-based ``position``; empty past the end."""
    if page < 1 or page_size < 1:
        raise ValueError("page and page size start at 1")
    first, end = (page - 1) * page_size, page * page_size
    near = index(spark, root).where((F.col("start") < end) & (F.col("start") + F.col("size") > first)).collect()  # the files of one page
    folders = [f"{root}/rows/{PART}={r[PART]}" for r in near]
    rows = spark.read.option("basePath", f"{root}/rows").parquet(*(folders or [f"{root}/rows"]))
    start = F.lit(None).cast("long")
    for r in near:
        start = F.when(F.col(PART) == r[PART], F.lit(r.start)).otherwise(start)
    # the place is compared as it is stored, so that Parquet statistics skip row groups
    wanted = F.lit(False)
    for r in near:
        wanted = wanted | ((F.col(PART) == r[PART]) & (F.col(PLACE) >= first - r.start) & (F.col(PLACE) < end - r.start))
    rows = rows.where(wanted).withColumn("position", start + F.col(PLACE) + 1).drop(PART, PLACE)
    return rows.orderBy("position")


def pages(spark: SparkSession, root: str, page_size: int) -> DataFrame:
    """How many rows and pages there are: one row ``total``, ``pages``."""
    total = F.coalesce(F.sum("size"), F.lit(0))
    return index(spark, root).agg(total.alias("total"), F.ceil(total / page_size).cast("long").alias("pages"))

"""Row numbers of a whole table in a given order, without one task that sees all rows.

The rows are range-partitioned by the order and sorted within partitions, so each has a place
within its partition. They are written once: the places and the partition sizes must come from
one and the same run. A row's number is its place plus the sizes of the partitions before, which
is all that the driver sees (one count a partition).

Rows that are equal in every order column stay in one partition and are numbered in any order
among themselves: give a unique last column where that matters or where one key may hold much
of the table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.session import shared_dir

PART, PLACE = "_part", "_place"
_ROW_BITS = 33  # of an id that Spark counts up within a partition


def placed(df: DataFrame, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """``df`` sorted in ranges of ``order``, with the partition of each row and its 0-based place there."""
    ranged = df.repartitionByRange(*order) if partitions is None else df.repartitionByRange(partitions, *order)
    at = F.monotonically_increasing_id()
    return ranged.sortWithinPartitions(*order).withColumn(PLACE, at).select(
        *df.columns, F.shiftright(PLACE, _ROW_BITS).cast("int").alias(PART), F.col(PLACE).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias(PLACE))


def part_starts(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(part, rows before it, rows in it) of each part, from the rows of :func:`placed` as written."""
    sizes = sorted(map(tuple, rows.groupBy(PART).count().collect()))  # one row a partition
    before = accumulate((n for _, n in sizes), initial=0)
    return [(part, start, n) for (part, n), start in zip(sizes, before)]


def numbered(df: DataFrame, order: Sequence[Column], name: str, within: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """``df`` with the 1-based number ``name`` of each row in ``order``; with ``within``, the first
    columns of the order, the number within rows that are equal in those (nulls are equal)."""
    spark = df.sparkSession
    path = shared_dir(spark, f"numbered-{uuid.uuid4().hex}")
    rows = placed(df, order, partitions)
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    starts = spark.createDataFrame(part_starts(rows), f"{PART} int, _start long, _size long").drop("_size")
    rows = rows.join(starts, PART).withColumn(name, F.col("_start") + F.col(PLACE) + 1).drop(PART, PLACE, "_start")
    if within:
        first = rows.groupBy(*[F.col(c).alias(f"_of_{c}") for c in within]).agg(F.min(name).alias("_first"))
        same = F.lit(True)
        for c in within:
            same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        rows = rows.join(first, same).withColumn(name, F.col(name) - F.col("_first") + 1)
    return rows.select(*df.columns, F.col(name).cast("long").alias(name))

"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterbook.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark from whatever store holds it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the cluster's shared checkpoint folder."""
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends at
    those files, which outlive any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of ``df`` that have none of these ``names`` in whatever case."""
    lowered = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in lowered]


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with new names for its columns that have one of these ``names`` in whatever case,
    and every column's name by its old one."""
    kept, taken = set(without(df, names)), {c.lower() for c in [*df.columns, *names]}
    new = {}
    for c in df.columns:
        name = c
        while c not in kept and name.lower() in taken:
            name += "_"
        new[c] = name
        taken.add(name.lower())
    return df.toDF(*new.values()), new


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def partitions_for(docs: DataFrame, text: str, bytes_each: int, total: int | None = None) -> int:
    """How many partitions keep each at about ``bytes_each`` bytes of text (``total`` in all, if
    that is known), never fewer than the session's shuffle partitions."""
    total = text_bytes(docs, text) if total is None else total
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(total / bytes_each))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(it: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows: what a task holds as Python objects stays small."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()

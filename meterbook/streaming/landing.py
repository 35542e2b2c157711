"""Incremental landing: new CSV files in a folder become warehouse uploads.

The stream lists files (the binary-file source, without their content), and its checkpoint
records which were taken, so a second run over the same folder adds nothing. Each file is
one upload whose id is a hash of its path and is landed like any other upload: columns by
header name, size and suffix checks, a manifest entry for each state. A file that cannot be
landed is recorded as ``failed`` and the others go on. A micro-batch that is run again after
a failure overwrites the same partitions and adds manifest entries that say the same, so the
result is that of one clean run.

A micro-batch is bounded in files; ``availableNow`` processes what is there and stops.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterbook.sources.usage_csv import CSV_GLOB
from meterbook.sources.warehouse import land_upload

# Files (uploads) of one micro-batch, and those that are landed at the same time.
MAX_FILES, CONCURRENT = 256, 8
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def upload_id_of(path_col) -> F.Column:
    """A stable, non-negative 63-bit upload id from a file path."""
    return F.xxhash64(path_col).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def file_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = MAX_FILES,
                clean_source: str = "off", archive_dir: str | None = None) -> DataFrame:
    """New CSV files of a folder: ``path``, ``size`` and ``upload_id``. ``clean_source`` may be
    ``delete`` or ``archive`` (to ``archive_dir``) for files whose batch has ended."""
    opts = {"pathGlobFilter": CSV_GLOB, "maxFilesPerTrigger": str(max_files_per_trigger), "cleanSource": clean_source}
    if archive_dir:
        opts["sourceArchiveDir"] = archive_dir
    found = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).options(**opts).load(source_dir)
    return found.select("path", F.col("length").alias("size"), upload_id_of(F.col("path")).alias("upload_id"))


def land_batch(batch: DataFrame, warehouse_root: str, manifest_root: str, **options) -> None:
    """Land each file of a micro-batch, several at a time; failures are in the manifest."""
    spark = batch.sparkSession

    def land(row) -> None:
        try:
            land_upload(spark, row.path, warehouse_root, manifest_root, row.upload_id, row.path.rsplit("/", 1)[-1], **options)
        except Exception as exc:  # land_upload has recorded it as failed; what it could not record must stop the batch
            if not _recorded(spark, manifest_root, row.upload_id):
                raise exc

    with ThreadPoolExecutor(max_workers=CONCURRENT) as pool:
        list(pool.map(land, batch.collect()))  # at most max_files_per_trigger small rows


def _recorded(spark: SparkSession, manifest_root: str, upload_id: int) -> bool:
    from meterbook.sources import manifest as mf

    mine = mf.read(spark, manifest_root).where(F.col("upload_id") == upload_id)
    return mf.latest(mine).where(F.col("status") == "failed").count() == 1


def start_landing(spark: SparkSession, source_dir: str, warehouse_root: str, manifest_root: str,
                  checkpoint_location: str, header: Sequence[str] | None = None,
                  multi_line: bool = True, max_mb: float | None = None, available_now: bool = True,
                  max_files_per_trigger: int = MAX_FILES, clean_source: str = "off",
                  archive_dir: str | None = None) -> StreamingQuery:
    """Start the landing stream; with ``available_now`` it stops when the folder is drained."""
    stream = file_stream(spark, source_dir, max_files_per_trigger, clean_source, archive_dir)
    options = dict(header=header, multi_line=multi_line, max_mb=max_mb)
    writer = (
        stream.writeStream.foreachBatch(lambda df, _: land_batch(df, warehouse_root, manifest_root, **options))
        .option("checkpointLocation", checkpoint_location)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()

"""Uploads as versions, published by one manifest entry each.

A landing writes a folder of its own, ``upload_id=K/version=V``, that no reader knows of; the
``completed`` entry it then appends to the manifest names the version and is all that makes
its rows visible. Readers take the versions from the manifest, never from a folder listing:

* during a landing, or after one that died before its entry, readers see the version before;
* a delete is one entry too, and so is a failed landing, which ends the upload as it does in
  :func:`warehouse.land_upload`;
* files are removed by :func:`vacuum` alone, once no snapshot of the time to keep needs them.

Each of these entries carries the number of the upload's state that it follows, plus one. The
higher number wins whatever the writers' clocks say. Of two writers that followed the same
state the later entry wins, whole; a writer looks again after its entry, and one that finds
another in force raises :class:`UploadChanged` (one that looked before the later entry cannot know).

An entry also holds the version's columns. A read over uploads takes its schema from there:
no footer is opened to merge schemas, and columns that differ in case only are one. A column
of two types is an error, as in Spark's own merge.

The driver reads one small row per published upload, and Spark lists those folders.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook.schema import CORRUPT_RECORD, ROW_ID, UPLOAD_ID, USAGE_COLUMNS
from meterbook.sources import manifest as mf
from meterbook.sources.usage_csv import Landing
from meterbook.sources.warehouse import observed, partition_path, upload_rows, write_rows

#: States that decide what readers see; the others leave it as it was.
DECIDING = ("completed", "failed", "deleted")
#: The columns of a read that finds no upload.
NO_UPLOAD = T.StructType([*(T.StructField(c, T.StringType()) for c in USAGE_COLUMNS), T.StructField(ROW_ID, T.LongType())])


class UploadChanged(RuntimeError):
    """Another writer changed the upload since the state that this one followed."""


def version_path(root: str, upload_id: int, version: str) -> str:
    return f"{partition_path(root, upload_id)}/version={version}"


def history(manifest: DataFrame) -> DataFrame:
    """The deciding entries of every upload; ``superseded`` is set on those that are not in
    force any more."""
    decided = manifest.where(F.col("status").isin(*DECIDING) & F.col("sequence").isNotNull())
    heads = decided.groupBy(UPLOAD_ID).agg(F.max(_rank()).alias("_head"))
    return decided.join(heads, UPLOAD_ID).withColumn("superseded", _rank() != F.col("_head")).drop("_head")


def _rank() -> F.Column:
    return F.struct("sequence", "recorded_at", F.coalesce("version", F.lit("")).alias("version"))


def heads(manifest: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """The deciding entry in force of every upload, now or at the (UTC) time ``as_of``."""
    decided = manifest.where(F.col("status").isin(*DECIDING) & F.col("sequence").isNotNull())
    if as_of is not None:
        decided = decided.where(F.col("recorded_at") <= F.lit(as_of))
    fields = [f.name for f in mf.MANIFEST_SCHEMA.fields]
    newest = decided.groupBy(UPLOAD_ID).agg(F.max_by(F.struct(*fields), _rank()).alias("e"))
    return newest.select("e.*")


def snapshot(spark: SparkSession, manifest_root: str, as_of: dt.datetime | None = None) -> DataFrame:
    """The published versions, one row per upload that has one."""
    return heads(mf.read(spark, manifest_root), as_of).where(F.col("status") == "completed")


def _head(spark: SparkSession, manifest_root: str, upload_id: int):
    mine = mf.read(spark, manifest_root).where(F.col(UPLOAD_ID) == int(upload_id))
    return heads(mine).first()  # one row or none


def current(spark: SparkSession, manifest_root: str, upload_id: int) -> int:
    """The number of the upload's state (0 before its first landing)."""
    head = _head(spark, manifest_root, upload_id)
    return 0 if head is None else head.sequence


def _publish(spark: SparkSession, manifest_root: str, upload_id: int, status: str, follows: int, **fields) -> None:
    """Append the deciding entry that follows state ``follows``; tell whether it is in force."""
    if current(spark, manifest_root, upload_id) != follows:
        raise UploadChanged(f"upload {upload_id} has changed since its state {follows}")
    recorded = mf.utcnow()
    entry = mf.entry(spark, upload_id, status, sequence=follows + 1, recorded_at=recorded, **fields)
    mf.append(manifest_root, entry)
    head = _head(spark, manifest_root, upload_id)
    if (head.sequence, head.recorded_at, head.version) != (follows + 1, recorded, fields.get("version")):
        raise UploadChanged(f"another writer replaced upload {upload_id} after its state {follows}")


def land(
    spark: SparkSession,
    paths: str | Sequence[str],
    warehouse_root: str,
    manifest_root: str,
    upload_id: int,
    original_filename: str | None = None,
    user_id: int | None = None,
    header: Sequence[str] | None = None,
    multi_line: bool = True,
    max_mb: float | None = None,
    cluster_files: int | None = None,
    follows: int | None = None,
    compressed: bool = False,
) -> Landing:
    """Land CSV file(s) (``compressed``: ``.csv.gz`` too) as a new version of ``upload_id`` and publish it.

    ``follows`` is the state (:func:`current`) that the new rows are meant to replace; by
    default the one at the start of the landing. If it is no longer the upload's state,
    nothing is published and :class:`UploadChanged` is raised. Other errors are recorded as
    ``failed``, which ends the version before, and are raised again."""
    created = mf.utcnow()
    stored = paths if isinstance(paths, str) else ", ".join(paths)
    version = uuid.uuid4().hex
    base = dict(original_filename=original_filename, stored_path=stored, user_id=user_id, created_at=created)
    mf.append(manifest_root, mf.entry(spark, upload_id, "processing", version=version, **base))
    if follows is None:
        follows = current(spark, manifest_root, upload_id)
    try:
        rows = upload_rows(spark, paths, upload_id, header, multi_line, max_mb, cluster_files, compressed).drop(UPLOAD_ID)
        watched, observation = observed(rows, f"landing-{version}")
        write_rows(watched, version_path(warehouse_root, upload_id, version), "error")
    except Exception as exc:
        _publish(spark, manifest_root, upload_id, "failed", follows, error_message=str(exc), completed_at=mf.utcnow(), **base)
        raise
    profile = observation.get
    _publish(spark, manifest_root, upload_id, "completed", follows, version=version, columns=rows.schema.json(),
             completed_at=mf.utcnow(), **profile, **base)
    return Landing(int(upload_id), warehouse_root, int(profile["row_count"]), int(profile["reject_count"]))


def delete(spark: SparkSession, manifest_root: str, upload_id: int) -> None:
    """End the upload for all later snapshots; its files stay until :func:`vacuum`."""
    _publish(spark, manifest_root, upload_id, "deleted", current(spark, manifest_root, upload_id))


def merged_schema(schemas: Sequence[T.StructType]) -> T.StructType:
    """All columns of ``schemas`` by their first spelling and place."""
    fields: dict[str, T.StructField] = {}
    for field in (f for schema in schemas for f in schema.fields):
        key = field.name.lower()
        known = fields.get(key)
        if known is None:
            fields[key] = T.StructField(field.name, field.dataType, True)
        elif known.dataType != field.dataType:
            raise ValueError(f"column {field.name} is {known.dataType.simpleString()} in one upload and {field.dataType.simpleString()} in another")
    return T.StructType(list(fields.values()))


def read(spark: SparkSession, warehouse_root: str, manifest_root: str, upload_id: int | None = None,
         as_of: dt.datetime | None = None, include_rejects: bool = False) -> DataFrame:
    """The rows of the published versions: of one upload, or of all. The versions are settled
    when this is called; what is landed or deleted later does not change the result. Where
    nothing is published the result has the contract's columns and no rows."""
    published = snapshot(spark, manifest_root, as_of)
    if upload_id is not None:
        published = published.where(F.col(UPLOAD_ID) == int(upload_id))
    # one small row per upload; uploads of one layout share one schema text
    versions = published.select(UPLOAD_ID, "version", "columns").orderBy(UPLOAD_ID).collect()
    paths = [version_path(warehouse_root, v.upload_id, v.version) for v in versions]
    schema = merged_schema([T.StructType.fromJson(json.loads(c)) for c in dict.fromkeys(v.columns for v in versions)] or [NO_UPLOAD])
    placed = T.StructType([*schema.fields, T.StructField(UPLOAD_ID, T.LongType()), T.StructField("version", T.StringType())])
    if paths:
        df = spark.read.schema(placed).option("basePath", warehouse_root).parquet(*paths).drop("version")
    else:
        df = spark.createDataFrame([], placed).drop("version")
    if not include_rejects and CORRUPT_RECORD in df.columns:
        df = df.where(F.col(CORRUPT_RECORD).isNull())
    return df


def vacuum(spark: SparkSession, warehouse_root: str, manifest_root: str, keep: dt.timedelta) -> list[str]:
    """Remove the version folders that no snapshot since ``keep`` ago needs, and give their paths.

    Kept are the versions in force at that time or named by an entry since, and folders that
    changed since (a landing under way). ``keep`` must be longer than any landing or read."""
    cutoff = mf.utcnow() - keep
    entries = mf.read(spark, manifest_root)
    in_force = heads(entries, cutoff).where(F.col("status") == "completed").select(UPLOAD_ID, "version")
    since = entries.where(F.col("version").isNotNull() & (F.col("recorded_at") > F.lit(cutoff))).select(UPLOAD_ID, "version")
    needed = {(r.upload_id, r.version) for r in in_force.union(since).distinct().collect()}  # small rows, some per upload
    jvm = spark.sparkContext._jvm
    folders = jvm.org.apache.hadoop.fs.Path(f"{warehouse_root.rstrip('/')}/{UPLOAD_ID}=*/version=*")
    fs = folders.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    oldest = cutoff.replace(tzinfo=dt.timezone.utc).timestamp() * 1000
    removed = []
    for status in fs.globStatus(folders) or []:
        path = status.getPath()
        key = int(path.getParent().getName().split("=", 1)[1]), path.getName().split("=", 1)[1]
        if key not in needed and status.getModificationTime() <= oldest:
            fs.delete(path, True)
            removed.append(path.toString())
    return removed

"""Versioned uploads: what readers see during, after and between landings, and in a crash."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook.sources import manifest as mf
from meterbook.sources import snapshots as sn

NOW = dt.timedelta(0)


class Killed(BaseException):
    """The writer's process ends here: no handler of the library runs."""


@pytest.fixture
def base(tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    file.wh, file.mf = str(tmp_path / "wh"), str(tmp_path / "mf")
    file.a = file("a.csv", "CustomerName,Quantity\nA,1\nB,2\n")
    file.b = file("b.csv", "CustomerName,Quantity\nC,3\n")
    return file


def names(df):
    return sorted(r.CustomerName for r in df.select("CustomerName").collect())


def folders(base, upload_id=1):
    return {d for d in os.listdir(f"{base.wh}/upload_id={upload_id}") if d.startswith("version=")}


def test_a_reader_during_a_landing_sees_the_rows_before(spark, base, monkeypatch):
    assert sn.land(spark, base.a, base.wh, base.mf, 1).row_count == 2
    early, during = sn.read(spark, base.wh, base.mf, 1), []
    write = sn.write_rows

    def watched(*args):
        during.append(names(sn.read(spark, base.wh, base.mf, 1)))
        write(*args)
        during.append(names(sn.read(spark, base.wh, base.mf, 1)))

    monkeypatch.setattr(sn, "write_rows", watched)
    sn.land(spark, base.b, base.wh, base.mf, 1)
    assert during == [["A", "B"], ["A", "B"]]
    assert names(sn.read(spark, base.wh, base.mf, 1)) == ["C"]
    assert names(early) == ["A", "B"]  # a reader keeps the versions it began with
    sn.delete(spark, base.mf, 1)
    assert names(sn.read(spark, base.wh, base.mf, 1)) == [] and names(early) == ["A", "B"]


@pytest.mark.parametrize("step", ["before the write", "in the write", "before the entry"])
def test_a_writer_that_dies_leaves_the_rows_before(spark, base, monkeypatch, step):
    sn.land(spark, base.a, base.wh, base.mf, 1)

    def killed(*args, **kwargs):
        if step == "in the write":
            mf_rows = spark.createDataFrame([("half",)], "CustomerName string")
            mf_rows.write.parquet(args[1])
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(sn, {"before the write": "upload_rows", "in the write": "write_rows", "before the entry": "_publish"}[step], killed)
        with pytest.raises(Killed):
            sn.land(spark, base.b, base.wh, base.mf, 1)
    assert names(sn.read(spark, base.wh, base.mf, 1)) == ["A", "B"]
    assert sn.land(spark, base.b, base.wh, base.mf, 1).row_count == 1  # run again
    assert names(sn.read(spark, base.wh, base.mf, 1)) == ["C"]
    sn.vacuum(spark, base.wh, base.mf, NOW)
    assert len(folders(base)) == 1 and names(sn.read(spark, base.wh, base.mf, 1)) == ["C"]


def test_a_failed_landing_ends_the_upload(spark, base):
    sn.land(spark, base.a, base.wh, base.mf, 1)
    with pytest.raises(ValueError, match="not a .csv"):
        sn.land(spark, base("x.txt", "x"), base.wh, base.mf, 1)
    assert names(sn.read(spark, base.wh, base.mf)) == []
    state = mf.latest(mf.read(spark, base.mf)).first()
    assert (state.status, state.sequence) == ("failed", 2)


def test_a_stale_writer_publishes_nothing(spark, base):
    sn.land(spark, base.a, base.wh, base.mf, 1)
    seen = sn.current(spark, base.mf, 1)
    sn.land(spark, base.b, base.wh, base.mf, 1)
    with pytest.raises(sn.UploadChanged):
        sn.land(spark, base.a, base.wh, base.mf, 1, follows=seen)
    assert names(sn.read(spark, base.wh, base.mf)) == ["C"] and sn.current(spark, base.mf, 1) == 2


def test_of_two_writers_after_one_state_the_later_entry_wins(spark, base, monkeypatch):
    sn.land(spark, base.a, base.wh, base.mf, 1)
    append, nested = mf.append, []

    def raced(root, rows):
        append(root, rows)
        if rows.first().status == "completed" and not nested:  # the other writer checked before this entry was there
            nested.append(True)
            with monkeypatch.context() as m:
                m.setattr(sn, "current", lambda *args: 1)
                sn.land(spark, base.b, base.wh, base.mf, 1)

    monkeypatch.setattr(mf, "append", raced)
    with pytest.raises(sn.UploadChanged, match="another writer"):
        sn.land(spark, base.a, base.wh, base.mf, 1)
    assert names(sn.read(spark, base.wh, base.mf)) == ["C"]
    past = sn.history(mf.read(spark, base.mf)).orderBy("recorded_at").collect()
    assert [(r.sequence, r.superseded) for r in past] == [(1, True), (2, True), (2, False)]


def test_the_sequence_decides_not_the_clock(spark, base):
    rows = [(1, "completed", 2, "v2", dt.datetime(2024, 1, 1)), (1, "completed", 1, "v1", dt.datetime(2024, 6, 1)),
            (2, "completed", 1, "w1", dt.datetime(2024, 1, 1)), (2, "processing", None, "w2", dt.datetime(2024, 6, 1))]
    mf.append(base.mf, spark.createDataFrame(rows, "upload_id long, status string, sequence long, version string, recorded_at timestamp_ntz"))
    assert sorted((r.upload_id, r.version) for r in sn.snapshot(spark, base.mf).collect()) == [(1, "v2"), (2, "w1")]
    assert sn.snapshot(spark, base.mf, dt.datetime(2023, 1, 1)).count() == 0


def test_reads_of_an_earlier_time_and_vacuum(spark, base):
    sn.land(spark, base.a, base.wh, base.mf, 1)
    then = mf.utcnow()
    sn.land(spark, base.b, base.wh, base.mf, 1)
    assert names(sn.read(spark, base.wh, base.mf, as_of=then)) == ["A", "B"]
    assert sn.vacuum(spark, base.wh, base.mf, dt.timedelta(hours=1)) == [] and len(folders(base)) == 2
    assert names(sn.read(spark, base.wh, base.mf, as_of=then)) == ["A", "B"]
    assert len(sn.vacuum(spark, base.wh, base.mf, NOW)) == 1 and len(folders(base)) == 1
    assert names(sn.read(spark, base.wh, base.mf)) == ["C"]
    sn.delete(spark, base.mf, 1)
    sn.vacuum(spark, base.wh, base.mf, NOW)
    assert folders(base) == set() and names(sn.read(spark, base.wh, base.mf)) == []


def test_columns_come_from_the_entries(spark, base):
    sn.land(spark, base("c.csv", "CustomerName,Quantity,Extra\nA,1,x\n"), base.wh, base.mf, 1)
    sn.land(spark, base("d.csv", "quantity,customername,EXTRA,Other\n2,B,y,z\n"), base.wh, base.mf, 2)

    def jobs(group, call):
        spark.sparkContext.setJobGroup(group, group)
        out = call()
        spark.sparkContext.setJobGroup("", "")
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    rows, few = jobs("two", lambda: sn.read(spark, base.wh, base.mf))
    assert sorted((r.upload_id, r.CustomerName, r.Quantity, r.Extra, r.Other) for r in rows.collect()) == [(1, "A", "1", "x", None), (2, "B", "2", "y", "z")]
    assert [c for c in rows.columns if c.lower() == "extra"] == ["Extra"] and "version" not in rows.columns
    for k in (3, 4, 5):
        sn.land(spark, base.a, base.wh, base.mf, k)
    rows, more = jobs("five", lambda: sn.read(spark, base.wh, base.mf))
    assert more == few  # no job for footers
    assert rows.groupBy("upload_id").count().count() == 5
    one = rows.where(F.col("upload_id") == 2)
    assert [os.path.dirname(f).rsplit("upload_id=", 1)[1][0] for f in (r.f for r in one.select(F.col("_metadata.file_path").alias("f")).collect())] == ["2"]


def test_types_that_do_not_agree():
    def schema(kind):
        return T.StructType([T.StructField("x", kind)])

    with pytest.raises(ValueError, match="column x is date"):
        sn.merged_schema([schema(T.DateType()), schema(T.LongType())])
    assert sn.merged_schema([]) == T.StructType([])

"""Streams give the batch answer on the same input; guarded append refuses drift."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.sources import storage
from barloom.streaming import jobs

SCHEMA = "event_id long, ts timestamp, symbol long, alert_type string, price double"


def rows():
    t0 = dt.datetime(2024, 1, 1)
    return [(i, t0 + dt.timedelta(hours=i), i % 3, "view" if i % 2 else "buy", float(i % 17)) for i in range(200)]


@pytest.fixture()
def source(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows(), SCHEMA).coalesce(1).write.parquet(path)
    return spark.readStream.schema(SCHEMA).parquet(path), spark.read.schema(SCHEMA).parquet(path)


def test_bars_match_batch_for_closed_windows(source, tmp_path):
    stream, batch = source
    got = {tuple(r) for r in jobs.drain(jobs.tumbling_bars(stream), str(tmp_path / "c")).collect()}
    want = {tuple(r) for r in jobs.tumbling_bars(batch).collect()}
    assert got and got < want and {r[1] for r in want - got} == {dt.date(2024, 1, 8), dt.date(2024, 1, 9)}


def test_each_alert_once(source, tmp_path):
    stream, batch = source
    day = lambda df: df.withColumn("date", F.to_date("ts"))
    got = sorted(tuple(r) for r in jobs.drain(jobs.alerts_once(day(stream)), str(tmp_path / "c")).collect())
    assert got == sorted(tuple(r) for r in jobs.alerts_once(day(batch)).collect())


def test_guarded_append(spark, tmp_path):
    cols = "isin string, date date, close double, adj_factor double"
    write = jobs.guarded_append(str(tmp_path / "t"))
    day = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0, 1.0), ("B", dt.date(2024, 1, 1), 2.0, 1.0)], cols)
    write(day, 0)
    write(day, 1)
    write(spark.createDataFrame([("C", dt.date(2024, 1, 1), 5.0, 1.0)], cols), 2)
    assert sorted(r.isin for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["A", "B", "C"]
    moved = day.withColumn("close", F.col("close") * 2)
    with pytest.raises(jobs.DriftError):
        write(moved, 3)
    jobs.guarded_append(str(tmp_path / "t"), day.select("isin"))(moved, 4)
    assert storage.read_or_empty(spark, str(tmp_path / "t"), day.schema).agg(F.sum("close")).first()[0] == 11.0

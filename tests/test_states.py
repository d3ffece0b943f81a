"""Watches and jobs on streams: the same as on tables, expiry, timers."""

from __future__ import annotations

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarry.streaming import states


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", states.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Stream:
    """A folder of files as a stream, run to its end each time."""

    def __init__(self, spark, path, schema, fn, **trigger):
        self.spark, self.path, self.schema, self.fn, self.trigger = spark, path, schema, fn, trigger or {"availableNow": True}
        (path / "in").mkdir()

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self):
        source = self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in")
        q = self.fn(source).writeStream.format("parquet").option("checkpointLocation", f"{self.path}/cp").option("path", f"{self.path}/out").outputMode("append").trigger(**self.trigger).start()
        ended = q.awaitTermination(100)
        q.stop()
        assert ended
        return sorted(tuple(r) for r in self.spark.read.parquet(f"{self.path}/out").collect())


def test_watch_equals_table(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("key"), F.col("event_type").alias("mark"), F.col("ts").cast("timestamp").alias("ts"))
    days = sorted(r.ts for r in e.select("ts").collect())
    half = days[len(days) // 2]
    s = Stream(spark, tmp_path, e.schema, states.watch)
    s.add(e.where(F.col("ts") < F.lit(half)).collect())
    s.run()
    s.add(e.where(F.col("ts") >= F.lit(half)).collect())
    got = s.run()
    assert got == sorted(tuple(r) for r in states.changes(e).collect())
    assert len(got) > 100


def test_expired_watch_is_a_baseline(spark, tmp_path):
    at = lambda i: datetime(2024, 1, 1, 0, 0, i)  # noqa: E731, DTZ001
    s = Stream(spark, tmp_path, "key string, mark string, ts timestamp", lambda m: states.watch(m, ttl_ms=6000), once=True)
    s.add([("a", "x", at(0)), ("a", "y", at(1)), ("b", None, at(1))])
    assert s.run() == [("a", "x", "y", 1)]
    time.sleep(8)
    s.add([("a", "z", at(2))])
    assert s.run() == [("a", "x", "y", 1)]  # y is forgotten, z the new baseline
    s.add([("a", "w", at(3))])
    got = s.run()
    assert got in ([("a", "x", "y", 1), ("a", "z", "w", 1)], [("a", "x", "y", 1)])  # the second if this machine takes longer than the expiry


def test_stuck_job_fails_by_timer(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 0, m)  # noqa: E731, DTZ001
    rows = [("a", "queued", at(0)), ("a", "running", at(1)), ("b", "queued", at(0)), ("b", "running", at(2)), ("b", "done", at(4)), ("b", "failed", at(5)), ("c", "queued", at(20))]
    s = Stream(spark, tmp_path, "job string, status string, ts timestamp", lambda r: states.jobs(r, 600_000))
    s.add(rows[:5])
    assert s.run() == [("b", "done", "reported")]
    s.add(rows[5:])
    s.run()
    s.add([("d", "queued", at(25))])
    got = s.run()
    assert got == [("a", "failed", "no report in time"), ("b", "done", "reported")]
    table = spark.createDataFrame([*rows[:5], rows[6], ("d", "queued", at(25))], s.schema)
    assert sorted(tuple(r) for r in states.outcomes(table, 600_000, "2024-01-01 00:25:00").collect()) == got

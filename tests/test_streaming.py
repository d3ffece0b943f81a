from __future__ import annotations

from pyspark.sql import functions as F

from quarry.streaming import windows

SF = "/root/testdata/sf0.001"


def stream(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))


def test_tumbling_is_the_same_on_a_stream(spark, tmp_path):
    batch, live = stream(spark, tmp_path)
    q = windows.tumbling(windows.event_time(live)).writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert rows(spark.table("tumbling")) == rows(windows.tumbling(windows.event_time(batch)))


def test_watch_changes(spark, tmp_path):
    path = str(tmp_path / "f")
    for k, marks in enumerate([["a1", "b1"], ["a2", "b1"], ["a2", "b2"]]):
        spark.createDataFrame([(m[0], m, k) for m in marks], "key string, mark string, ts long").coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    live = spark.readStream.schema("key string, mark string, ts long").option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    q = windows.watch_changes(live).writeStream.format("memory").queryName("changes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.key, r.before[0]) for r in spark.table("changes").collect()} == {("a", "a"), ("b", "b")}


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "x")], "k long, v string").write.parquet(path)
    windows.append_new(path, ["k"])(spark.createDataFrame([(1, "y"), (2, "z")], "k long, v string"), 0)
    windows.append_new(path, ["k"])(spark.createDataFrame([(2, "z")], "k long, v string"), 1)
    assert sorted(r.k for r in spark.read.parquet(path).select(F.col("k")).collect()) == [1, 2]


def test_watch_changes_in_order_of_time(spark, tmp_path):
    """Marks of one batch go by time, not by their text."""
    rows = [("a", "z9", 1), ("a", "b2", 2), ("a", "m5", 3), ("a", None, 4), ("a", "m5", 5)]
    spark.createDataFrame(rows, "key string, mark string, ts long").coalesce(1).write.parquet(str(tmp_path / "w"))
    live = spark.readStream.schema("key string, mark string, ts long").parquet(str(tmp_path / "w"))
    q = windows.watch_changes(live).writeStream.format("memory").queryName("ordered").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.before, r.after) for r in spark.table("ordered").collect()] == [("z9", "b2"), ("b2", "m5")]


def test_late_rows_are_dropped(spark, tmp_path):
    """A row behind the watermark doesn't change a window that is closed."""
    for k, at in enumerate(["2024-01-01 00:10:00", "2024-01-01 06:00:00", "2024-01-01 06:10:00", "2024-01-01 00:20:00", "2024-01-01 12:00:00", "2024-01-01 12:10:00"]):
        spark.sql(f"SELECT timestamp_ntz'{at}' AS ts, 'x' AS event_type, 1.0D AS value").coalesce(1).write.parquet(str(tmp_path / f"l/{k}"))
    live = spark.readStream.schema("ts timestamp_ntz, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "l/*"))
    q = windows.tumbling(windows.event_time(live, "1 hour")).writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {str(r.start): r.n for r in spark.table("late").collect()} == {"2024-01-01 00:00:00": 1, "2024-01-01 06:00:00": 2}

"""Event-time windows and watches; each plan works on a stream as on a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(events: DataFrame, late: str | None = None) -> DataFrame:
    """events with ts as a timestamp, and a watermark for streams."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if late else out


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def watch_changes(filings: DataFrame) -> DataFrame:
    """A stream of (key, mark, ts): a row (key, before, after) whenever a key's mark changes, in the order of ts within a batch; the first is a baseline, and a null mark is none."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out, seen = [], []
        for batch in batches:
            seen.append(batch)
        if seen:
            for mark in pd.concat(seen).sort_values(["ts", "mark"], kind="stable")["mark"].dropna():
                if last is not None and mark != last:
                    out.append((key[0], last, mark))
                last = mark
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["key", "before", "after"])

    return filings.groupBy("key").applyInPandasWithState(run, "key string, before string, after string", "last string", "append", GroupStateTimeout.NoTimeout)


def append_new(path: str, keys: list[str]):  # noqa: ANN201
    """A foreachBatch function that appends rows whose keys the Parquet table at path doesn't have yet."""
    from quarry.sources.tables import insert_absent

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(batch.schema).parquet(path)
        insert_absent(known, batch, keys).write.mode("append").parquet(path)

    return run

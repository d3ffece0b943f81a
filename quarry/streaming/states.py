"""Keyed state with time: watches that forget, and jobs that time out.

Both need the RocksDB state store (spark.sql.streaming.stateStore.providerClass) and run on Spark's state API, so state is checkpointed
with the query and moves with its partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "key string, before string, after string, n long"
OUTCOMES = "job string, status string, reason string"
#: Where a job may go from where it is; other reports are ignored.
NEXT = {None: ("queued", "running", "done", "failed"), "queued": ("running", "done", "failed"), "running": ("done", "failed")}


def in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame | None:
    """A key's rows of one batch, sorted."""
    got = [r for r in rows if len(r)]
    return pd.concat(got).sort_values(by, kind="stable") if got else None


class Watch(StatefulProcessor):
    """The last mark of a key, which expires unless it is seen again in time, and how often it has changed since the baseline."""

    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "mark string", self.ttl)
        self.changes = handle.getValueState("changes", "n long", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, out = in_order(rows, ["ts", "mark"]), []
        last = self.last.get()[0] if self.last.exists() else None
        n = self.changes.get()[0] if last is not None and self.changes.exists() else 0
        for mark in [] if seen is None else seen["mark"].dropna():
            if last is not None and mark != last:
                n += 1
                out.append((key[0], last, mark, n))
            last = mark
        if last is not None:
            self.last.update((last,))
            self.changes.update((n,))
        yield pd.DataFrame(out, columns=["key", "before", "after", "n"])

    def close(self) -> None:
        pass


def watch(marks: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of (key, mark, ts): (key, before, after, n) at each change in the order of ts, n the changes since the baseline.

    A key's first mark is its baseline; so is the first one after `ttl_ms` without any, by the clock. Null marks are none. With expiry
    Spark runs batches without data too, so such a query doesn't end by trigger(availableNow=True); trigger(once=True) is one batch.
    """
    return marks.groupBy("key").transformWithStateInPandas(Watch(ttl_ms), CHANGES, "Append", "None" if ttl_ms is None else "ProcessingTime")


def changes(marks: DataFrame) -> DataFrame:
    """What watch() without expiry gives of a table."""
    by = Window.partitionBy("key").orderBy("ts", "mark")
    moved = marks.where("mark is not null").withColumn("before", F.lag("mark").over(by)).where("before <> mark")
    return moved.select("key", "before", F.col("mark").alias("after"), F.row_number().over(Window.partitionBy("key").orderBy("ts", "mark")).cast("long").alias("n"))


class Jobs(StatefulProcessor):
    """A job's status, and a timer while it runs: if none of its reports ends it in time, it has failed."""

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, out = in_order(rows, ["ts", "status"]), []
        status = self.status.get()[0] if self.status.exists() else None
        for at, to in [] if seen is None else zip(seen["ts"], seen["status"], strict=True):
            if to not in NEXT.get(status, ()):
                continue
            status = to
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if status in ("done", "failed"):
                out.append((key[0], status, "reported"))
            else:
                self.handle.registerTimer(int(at.timestamp() * 1000) + self.limit)
        if status is not None:
            self.status.update((status,))
        yield pd.DataFrame(out, columns=["job", "status", "reason"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.status.update(("failed",))
        yield pd.DataFrame([(key[0], "failed", "no report in time")], columns=["job", "status", "reason"])

    def close(self) -> None:
        pass


def jobs(reports: DataFrame, limit_ms: int, late: str = "0 seconds") -> DataFrame:
    """A stream of (job, status, ts): (job, status, reason) once for each job that ends, by a report or because none came within `limit_ms` of event time after the last one."""
    marked = reports.withWatermark("ts", late)
    return marked.groupBy("job").transformWithStateInPandas(Jobs(limit_ms), OUTCOMES, "Append", "EventTime")


def outcomes(reports: DataFrame, limit_ms: int, until: str) -> DataFrame:
    """What jobs() gives of a table of reports whose last moment is `until`, for jobs whose reports come in the order of NEXT and within the limit of each other."""
    last = reports.groupBy("job").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.max("ts").alias("ts"))
    overdue = F.unix_millis("ts") + limit_ms < F.unix_millis(F.lit(until).cast("timestamp"))
    ended = F.col("status").isin("done", "failed")
    return last.where(ended | overdue).select("job", F.when(ended, F.col("status")).otherwise("failed").alias("status"), F.when(ended, "reported").otherwise("no report in time").alias("reason"))

"""As-of joins: for each asked moment the last row that was known then, by one sort instead of a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(asks: DataFrame, known: DataFrame, keys: list[str], time: str, values: list[str], period: Column | None = None) -> DataFrame:
    """asks with `values` of the last row of known with equal keys whose time is not after theirs; nulls where there is none.

    Both tables go into one, sorted by key and time, where a row of known comes before an ask of the same moment; the last one seen is a
    window's value. So that a key with very many rows is no single task, a key's rows are sorted by period (a column of `time`, the year
    where none is named), and what was last known before a period is carried into it: of each key and period one row. known has one row for
    a key and time; of several any may be given. Null keys match nothing, and null times are never known and know nothing.
    """
    period = F.year(time) if period is None else period
    own = [c for c in asks.columns if c not in (*keys, time)]
    rows = known.where(F.col(time).isNotNull()).select(*keys, time, F.lit(0).alias("_side"), F.struct(*values).alias("_value"), F.lit(None).cast(asks.select(F.struct(*(own or [F.lit(0).alias("_")]))).schema[0].dataType).alias("_ask"))
    both = rows.unionByName(asks.select(*keys, time, F.lit(1).alias("_side"), F.lit(None).cast(rows.schema["_value"].dataType).alias("_value"), F.struct(*(own or [F.lit(0).alias("_")])).alias("_ask")))
    both = both.withColumn("_period", period)
    ends = both.groupBy(*keys, "_period").agg(F.max_by("_value", F.when(F.col("_side") == 0, F.col(time))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    same = F.lit(True)
    for k in [*keys, "_period"]:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = both.alias("l").join(carried.where("_carry is not null").alias("r"), same, "left").select("l.*", "r._carry")
    order = Window.partitionBy(*keys, "_period").orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = joined.withColumn("_last", F.coalesce(F.last("_value", ignorenulls=True).over(order), "_carry")).where("_side = 1")
    ok = F.col(time).isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return seen.select(*keys, time, *[F.col(f"_ask.{c}").alias(c) for c in own], *[F.when(ok, F.col(f"_last.{v}")).alias(v) for v in values])

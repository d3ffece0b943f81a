"""Usage, limits, price series and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def month_usage(usage: DataFrame, as_of: str) -> DataFrame:
    """(org_id, asks, tokens) from the start of the month of a day up to it."""
    day = F.lit(as_of).cast("timestamp_ntz")
    own = usage.where((F.col("ts") >= F.date_trunc("month", day)) & (F.col("ts") <= day))
    return own.groupBy("org_id").agg(F.count("*").alias("asks"), F.round(F.coalesce(F.sum("tokens"), F.lit(0.0)), 2).alias("tokens"))


def summary(used: DataFrame, plans: DataFrame, default: str = "free") -> DataFrame:
    """used with plan, remaining and blocked; plans (org_id, plan, quota), unknown ones have the default's quota."""
    base = plans.where(F.col("plan") == default).agg(F.max("quota").alias("base"))
    quota = F.coalesce("quota", "base")
    out = used.join(plans, "org_id", "left").crossJoin(base)  # one row
    return out.select("org_id", "asks", "tokens", F.coalesce("plan", F.lit(default)).alias("plan"), F.greatest(F.lit(0), quota - F.col("asks")).cast("long").alias("remaining"), (F.col("asks") >= quota).alias("blocked"))


def rate_limited(calls: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """calls (key, ts, id) with allowed: among the first `limit` of a key's fixed window."""
    slot = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds)
    by = Window.partitionBy("key", "slot").orderBy("ts", "id")
    return calls.withColumn("slot", slot).withColumn("allowed", F.row_number().over(by) <= limit).drop("slot")


def rolling_budget(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """calls (key, ts, tokens) with the key's tokens in the `seconds` up to each."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    by = Window.partitionBy("key").orderBy("at").rangeBetween(-seconds, 0)
    return calls.withColumn("at", at).withColumn("rolling", F.round(F.sum("tokens").over(by), 2)).drop("at")


def downsample(series: DataFrame, stride: int) -> DataFrame:
    """Every stride-th point of a ticker's series, and the last."""
    by, every = Window.partitionBy("ticker").orderBy("d"), Window.partitionBy("ticker")
    r = series.withColumn("rn", F.row_number().over(by)).withColumn("n", F.count("*").over(every))
    return r.where((F.col("n") <= 2) | ((F.col("rn") - 1) % stride == 0) | (F.col("rn") == F.col("n"))).drop("rn", "n")


def period_change(series: DataFrame) -> DataFrame:
    ends = series.groupBy("ticker").agg(F.min_by("close", "d").alias("first"), F.max_by("close", "d").alias("last"))
    return ends.select("ticker", "first", "last", F.when(F.col("first") != 0, F.round((F.col("last") - F.col("first")) / F.col("first") * 100, 2)).alias("change_pct"))


def top_items(rows: DataFrame, key: str, item: str, order: str, n: int) -> DataFrame:
    """The n most frequent items of each key; ties go to the one seen first."""
    counted = rows.groupBy(key, item).agg(F.count("*").alias("uses"), F.min(order).alias("first_seen"))
    by = Window.partitionBy(key).orderBy(F.desc("uses"), "first_seen")
    return counted.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= n)


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def changed(latest: DataFrame, watch: DataFrame) -> DataFrame:
    """Watched keys whose latest mark differs from the remembered one; a first mark is a baseline and no change."""
    return latest.join(watch, "key").where("last is not null and latest <> last")


def by_kind(usage: DataFrame, ask: str) -> DataFrame:
    """(org_id, asks, uploads, tokens, kinds): conditional counts, the tokens of asks, and the kinds seen, sorted."""
    is_ask = F.col("kind") == ask
    return usage.groupBy("org_id").agg(
        F.count_if(is_ask).alias("asks"), F.count_if(~is_ask).alias("uploads"), F.round(F.coalesce(F.sum(F.when(is_ask, F.col("tokens"))), F.lit(0.0)), 2).alias("tokens"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")
    )


def cost(calls: DataFrame, prices: DataFrame, default: float) -> DataFrame:
    """(kind, cost, cached) of calls (kind, tokens, cached): cached ones cost nothing, unknown kinds the default price a million tokens."""
    priced = calls.join(prices, "kind", "left")
    paid = F.when(F.col("cached"), 0.0).otherwise(F.col("tokens") / 1000000 * F.coalesce("price", F.lit(default)))
    return priced.groupBy("kind").agg(F.round(F.sum(paid), 6).alias("cost"), F.count_if("cached").alias("cached"))

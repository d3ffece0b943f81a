"""Market series: arrays of vendors as dated points, quotes with their fall-backs, earnings, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """A number, or null for junk and NaN."""
    return F.nullif(text.try_cast("double"), F.lit(float("nan")))


def points(series: DataFrame) -> DataFrame:
    """(ticker, d, close) of parallel arrays (ticker, at: epoch seconds, close); points without a close go."""
    each = series.select("ticker", F.explode(F.arrays_zip(F.col("at").alias("at"), F.col("close").alias("close"))).alias("p"))
    return each.select("ticker", F.to_date(F.timestamp_seconds("p.at")).alias("d"), F.col("p.close").alias("close")).where("close is not null and d is not null")


def quotes(meta: DataFrame, closes: DataFrame) -> DataFrame:
    """(ticker, price, previous, change, change_pct, pe): from a vendor's row (ticker, price, previous, eps), else from the last two closes (ticker, d, close).

    P/E only for positive earnings.
    """
    back = Window.partitionBy("ticker").orderBy(F.desc("d"))
    last = closes.withColumn("k", F.row_number().over(back)).where("k <= 2").groupBy("ticker").agg(F.max(F.when(F.col("k") == 1, F.col("close"))).alias("c1"), F.max(F.when(F.col("k") == 2, F.col("close"))).alias("c2"))
    q = meta.join(last, "ticker", "full_outer").select("ticker", F.coalesce("price", "c1").alias("price"), F.coalesce("previous", F.when(F.col("price").isNull(), F.col("c2")).otherwise(F.coalesce("c2", "c1"))).alias("previous"), "eps")
    change = F.col("price") - F.col("previous")
    return q.select("ticker", "price", "previous", F.round(change, 4).alias("change"), F.when(F.col("previous") != 0, F.round(change / F.col("previous") * 100, 2)).alias("change_pct"), F.when(F.col("eps") > 0, F.round(F.col("price") / F.col("eps"), 2)).alias("pe"))


def next_earnings(dates: DataFrame, as_of: str) -> DataFrame:
    """(ticker, next): the first date after a day that has no reported figure."""
    return dates.groupBy("ticker").agg(F.min(F.when((F.col("d") > F.lit(as_of).cast("date")) & F.col("eps_reported").isNull(), F.col("d"))).alias("next"))


def digest(watched: DataFrame, quoted: DataFrame, flags: DataFrame, changes: DataFrame) -> DataFrame:
    """(ticker, price, change_pct, n_flags, n_high, n_changes, notable) of watched tickers: flags (ticker, severity) and changes (ticker, topic, change)."""
    f = flags.groupBy("ticker").agg(F.count("*").alias("n_flags"), F.count_if(F.col("severity") == "high").alias("n_high"))
    c = changes.groupBy("ticker").agg(F.count("*").alias("n_changes"))
    out = watched.select("ticker").distinct().join(quoted.select("ticker", "price", "change_pct"), "ticker", "left").join(f, "ticker", "left").join(c, "ticker", "left").na.fill(0, ["n_flags", "n_high", "n_changes"])
    return out.withColumn("notable", F.col("n_high") + F.col("n_changes"))

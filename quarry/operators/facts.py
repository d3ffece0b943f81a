"""Filed facts: annual, restated and chained resolution, and what is computed from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def annual(facts: DataFrame, form: str = "10-K", days: tuple[int, int] = (300, 400)) -> DataFrame:
    """Facts of a form that cover about a year; those of an instant stay."""
    return facts.where((F.col("form") == form) & (F.col("period_start").isNull() | F.datediff("period_end", "period_start").between(*days)))


def restated(facts: DataFrame) -> DataFrame:
    """Of each ticker, concept, unit and period the value that was filed last."""
    last = Window.partitionBy("ticker", "concept", "unit", "period_end").orderBy(*[F.desc_nulls_last(c) for c in ("filed", "seq1", "seq2", "val")])
    return facts.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")


def resolved(facts: DataFrame) -> DataFrame:
    return restated(annual(facts))


def chained(facts: DataFrame, chain: list[str]) -> DataFrame:
    """Of resolved facts, for each ticker and period the concept that comes first in the chain."""
    place = F.array_position(F.array(*map(F.lit, chain)), F.col("concept"))
    first = Window.partitionBy("ticker", "period_end").orderBy("place")
    return facts.where(F.col("concept").isin(chain)).withColumn("place", place).withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn", "place")


def newest(points: DataFrame, n: int = 1, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """The n newest periods of each key."""
    by = Window.partitionBy(*keys).orderBy(F.desc("period_end"))
    return points.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= n)


def as_of(facts: DataFrame, day: str) -> DataFrame:
    """Point in time: as if nothing had been filed after a day."""
    return resolved(facts.where(F.col("filed") <= F.lit(day).cast("date")))


def by_year(points: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """(ticker, year, a column for each metric): one row per ticker and year, concepts as columns."""
    out = points.groupBy("ticker", F.year("period_end").alias("year")).pivot("concept", list(metrics.values())).agg(F.first("val"))
    return reduce(lambda d, m: d.withColumnRenamed(m[1], m[0]), metrics.items(), out)


def percent(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.round(a / b * 100, 2))


def cagr(points: DataFrame) -> DataFrame:
    """(ticker, cagr): of the first and last point that isn't zero, over one period less than there are such points."""
    real = points.where("val <> 0").groupBy("ticker").agg(F.min_by("val", "period_end").alias("first"), F.max_by("val", "period_end").alias("last"), F.count("*").alias("n"))
    return real.where("n > 1 and first > 0 and last > 0").select("ticker", F.round(F.pow(F.col("last") / F.col("first"), 1.0 / (F.col("n") - 1)) - 1, 6).alias("cagr"))


def screen_rows(years: DataFrame) -> DataFrame:
    """Each ticker's newest year of (ticker, year, revenue, cost, gross) with what is computed from it: margin, cost_share, growth, fcf, fcf_margin, cagr (percent), years. One pass over each ticker's years."""
    by = Window.partitionBy("ticker").orderBy("year")
    change = lambda new, old: F.when(old != 0, F.round((new - old) / F.abs(old) * 100, 2))
    y = years.withColumn("old", F.lag("revenue").over(by)).withColumn("first", F.first("revenue").over(by)).withColumn("span", F.col("year") - F.first("year").over(by)).withColumn("years", F.count("*").over(Window.partitionBy("ticker")))
    y = y.withColumn("rn", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("year")))).where("rn = 1").withColumn("free", F.col("revenue") - F.coalesce("cost", F.lit(0.0)))
    whole = (F.col("first") > 0) & (F.col("revenue") > 0) & (F.col("span") > 0)
    return y.select(
        "ticker", F.col("year").cast("long").alias("year"), "revenue", "cost", "gross", percent(F.col("gross"), F.col("revenue")).alias("margin"), percent(F.col("cost"), F.col("revenue")).alias("cost_share"), change(F.col("revenue"), F.col("old")).alias("growth"),
        F.round("free", 2).alias("fcf"), percent(F.col("free"), F.col("revenue")).alias("fcf_margin"), F.when(whole, F.round((F.pow(F.col("revenue") / F.col("first"), 1 / F.col("span")) - 1) * 100, 2)).alias("cagr"), "years",
    )


OPS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def screen(rows: DataFrame, filters: list[tuple[str, str, float]], default: str) -> DataFrame:
    """Rows that pass all filters, unknown fields and signs left out; sorted down by the first filter's field, nulls last."""
    known = [(f, o, v) for f, o, v in filters if f in rows.columns and o in OPS]
    passed = rows.where(reduce(lambda a, b: a & b, [OPS[o](F.col(f), F.lit(v)) for f, o, v in known], F.lit(True)))
    return passed.orderBy(F.desc_nulls_last(known[0][0] if known else default), "ticker")


def dcf(scenarios: DataFrame) -> DataFrame:
    """(id, year, fcf, pv): projection of id, base_fcf, growth_rate, discount_rate, years."""
    years = scenarios.select("*", F.explode(F.sequence(F.lit(1), F.col("years"))).alias("year"))
    fcf = F.col("base_fcf") * F.pow(1 + F.col("growth_rate"), F.col("year"))
    return years.select("id", "year", F.round(fcf, 4).alias("fcf"), F.round(fcf / F.pow(1 + F.col("discount_rate"), F.col("year")), 4).alias("pv"))


def dcf_value(scenarios: DataFrame) -> DataFrame:
    """scenarios and equity, per_share: with a Gordon terminal value, its growth clamped half a point under the discount rate."""
    g, r, n = F.col("growth_rate"), F.col("discount_rate"), F.col("years")
    end = F.when(r <= F.col("terminal_growth"), r - 0.005).otherwise(F.col("terminal_growth"))
    pv = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, y: s + F.col("base_fcf") * F.pow((1 + g) / (1 + r), y))
    last = F.col("base_fcf") * F.pow(1 + g, n) * (1 + end) / (r - end) / F.pow(1 + r, n)
    equity = pv + last + F.col("net_cash")
    return scenarios.select("*", F.round(equity, 2).alias("equity"), F.when(F.col("shares") > 0, F.round(equity / F.col("shares"), 4)).alias("per_share"))


def sensitivity(scenarios: DataFrame) -> DataFrame:
    """The value over a grid of 5 growth and 5 discount rates around each scenario's."""
    grid = scenarios.select("*", F.explode(F.array(*[F.lit(x) for x in (-0.04, -0.02, 0.0, 0.02, 0.04)])).alias("dg")).select("*", F.explode(F.array(*[F.lit(x) for x in (-0.02, -0.01, 0.0, 0.01, 0.02)])).alias("dr"))
    return dcf_value(grid.withColumn("growth_rate", F.col("growth_rate") + F.col("dg")).withColumn("discount_rate", F.col("discount_rate") + F.col("dr")))


def income_flow(rows: DataFrame) -> DataFrame:
    """(ticker, year, source, target, value): links from revenue to what it splits into; missing gross profit is revenue less cost, and only positive links stay."""
    gross = F.coalesce(F.col("gross"), F.col("revenue") - F.col("cost"))
    link = lambda a, b, v: F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.round(v, 2).alias("value"))
    links = F.array(link("revenue", "cost", F.coalesce(F.col("cost"), F.col("revenue") - F.col("gross"))), link("revenue", "gross", gross), link("gross", "other", gross - F.coalesce(F.col("cost"), F.lit(0.0))))
    return rows.select("ticker", "year", F.inline(links)).where("value > 0")

"""Valuation from filed figures: assumptions, derived metrics, and value against price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bounds of a growth rate that is taken from the past, the rate without a past, and defaults of a valuation.
GROWTH, DEFAULT_GROWTH = (-0.05, 0.30), 0.08
DEFAULTS = {"terminal_growth": 0.025, "discount_rate": 0.09, "years": 5}


def free_cash(rows: DataFrame, newest: int = 6) -> DataFrame:
    """(ticker, year, fcf): operating cash flow less capital spending (none: 0) of the newest years of (ticker, year, ocf, capex)."""
    by = Window.partitionBy("ticker").orderBy(F.desc("year"))
    own = rows.where("ocf is not null").withColumn("k", F.row_number().over(by)).where(F.col("k") <= newest)
    return own.select("ticker", "year", (F.col("ocf") - F.coalesce("capex", F.lit(0.0))).alias("fcf"))


def growth(points: DataFrame) -> DataFrame:
    """(ticker, growth): yearly growth between the first and last point that isn't zero, over one period less than there are; null if either isn't positive."""
    real = points.where("fcf <> 0").groupBy("ticker").agg(F.min_by("fcf", "year").alias("a"), F.max_by("fcf", "year").alias("b"), F.count("*").alias("n"))
    return real.select("ticker", F.when((F.col("n") > 1) & (F.col("a") > 0) & (F.col("b") > 0), F.pow(F.col("b") / F.col("a"), 1.0 / (F.col("n") - 1)) - 1).alias("growth"))


def assumptions(rows: DataFrame, balance: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(id, base_fcf, growth_rate, terminal_growth, discount_rate, years, net_cash, shares) of each ticker with an operating cash flow.

    balance: (ticker, cash, debt, shares), nulls where nothing is filed. overrides: (ticker, any of these columns), which win where not null.
    """
    points = free_cash(rows)
    base = points.groupBy("ticker").agg(F.max_by("fcf", "year").alias("base_fcf")).join(growth(points), "ticker", "left").join(balance, "ticker", "left")
    rate = F.round(F.greatest(F.lit(GROWTH[0]), F.least(F.lit(GROWTH[1]), F.coalesce("growth", F.lit(DEFAULT_GROWTH)))), 4)
    net = F.coalesce("cash", F.lit(0.0)) - F.coalesce("debt", F.lit(0.0))
    out = base.select("ticker", "base_fcf", rate.alias("growth_rate"), net.alias("net_cash"), "shares", *[F.lit(v).alias(k) for k, v in DEFAULTS.items()])
    if overrides is not None:
        given = [c for c in overrides.columns if c in out.columns and c != "ticker"]
        out = out.alias("o").join(overrides.alias("g"), "ticker", "left").select("ticker", *[F.coalesce(F.col(f"g.{c}"), F.col(f"o.{c}")).alias(c) if c in given else F.col(f"o.{c}") for c in out.columns if c != "ticker"])
    return out.withColumnRenamed("ticker", "id")


def upside(valued: DataFrame, quotes: DataFrame) -> DataFrame:
    """valued (id, per_share) with price and upside_pct; both null without a quote (ticker, price)."""
    pct = F.when((F.col("price") != 0) & (F.col("per_share") != 0), F.round((F.col("per_share") - F.col("price")) / F.col("price") * 100, 1))
    return valued.join(quotes.select(F.col("ticker").alias("id"), "price"), "id", "left").withColumn("upside_pct", pct)


def percent_change(old: Column, new: Column) -> Column:
    return F.when(old != 0, (new - old) / F.abs(old) * 100)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def cagr_percent(begin: Column, end: Column, years: Column) -> Column:
    return F.when((begin > 0) & (end > 0) & (years > 0), (F.pow(end / begin, 1 / years) - 1) * 100)


def derived(points: DataFrame, a: str, b: str, kind: str = "ratio", same_period: bool = True, zero_b: bool = False) -> DataFrame:
    """(ticker, period_end, value, unit) of two metrics (ticker, concept, period_end, val): a / b in percent, or a - b.

    Of one period each; with same_period=False each metric gives its own newest one. With zero_b a missing b counts as 0.
    """
    side = lambda c, v: points.where(F.col("concept") == c).select("ticker", "period_end", F.col("val").alias(v))
    x, y, on = side(a, "a"), side(b, "b"), ["ticker", "period_end"]
    if not same_period:
        last = lambda df, v: df.groupBy("ticker").agg(F.max("period_end").alias("period_end"), F.max_by(v, "period_end").alias(v))
        x, y, on = last(x, "a"), last(y, "b").drop("period_end"), ["ticker"]
    both = x.join(y, on, "left" if zero_b else "inner").withColumn("b", F.coalesce("b", F.lit(0.0)) if zero_b else F.col("b"))
    value, unit = (F.round(ratio(F.col("a"), F.col("b")) * 100, 2), "percent") if kind == "ratio" else (F.col("a") - F.col("b"), "USD")
    return both.select("ticker", "period_end", value.alias("value"), F.lit(unit).alias("unit")).where("value is not null")


def money(value: Column, unit: Column) -> Column:
    """A filed value as text, by its unit."""
    whole = lambda v: F.format_number(v, 0)
    return F.when(unit == "percent", F.format_string("%.2f%%", value)).when(unit == "USD/shares", F.concat(F.lit("$"), F.format_number(value, 2), F.lit(" per share"))).when(unit == "shares", F.concat(whole(value), F.lit(" shares"))).otherwise(F.concat(F.lit("$"), whole(value)))


def peers(companies: DataFrame, quoted: DataFrame, latest: DataFrame) -> DataFrame:
    """(ticker, name, price, change, change_pct, market_cap, pe, revenue, margin) of companies (ticker, name, shares): quotes and newest fundamentals where there are any."""
    out = companies.join(quoted.select("ticker", "price", "change", "change_pct", "pe"), "ticker", "left").join(latest.select("ticker", "revenue", "gross"), "ticker", "left")
    return out.select("ticker", "name", "price", "change", "change_pct", F.round(F.col("price") * F.col("shares"), 2).alias("market_cap"), "pe", "revenue", F.when(F.col("revenue") != 0, F.round(F.col("gross") / F.col("revenue") * 100, 2)).alias("margin"))


def income_links(rows: DataFrame) -> DataFrame:
    """(ticker, year, source, target, value): what revenue splits into, down to net income, from (ticker, year, revenue, cogs, gross, rnd, sga, operating, net).

    Missing gross profit is revenue less cost. A link is there only if its figures are filed; other costs and taxes only if positive.
    """
    gross = F.coalesce("gross", F.col("revenue") - F.col("cogs"))
    r = rows.where("revenue <> 0").withColumn("gp", gross)
    r = r.withColumn("other", F.col("gp") - F.col("operating") - F.coalesce("rnd", F.lit(0.0)) - F.coalesce("sga", F.lit(0.0))).withColumn("below", F.col("operating") - F.col("net"))
    cost, run, end = F.col("cogs").isNotNull() & F.col("gp").isNotNull(), F.col("gp").isNotNull() & F.col("operating").isNotNull(), F.col("operating").isNotNull() & F.col("net").isNotNull()
    some = lambda c: run & (F.coalesce(F.col(c), F.lit(0.0)) != 0)
    links = [
        ("Revenue", "Cost of revenue", "cogs", cost), ("Revenue", "Gross profit", "gp", cost), ("Gross profit", "R&D", "rnd", some("rnd")), ("Gross profit", "SG&A", "sga", some("sga")),
        ("Gross profit", "Other opex", "other", run & (F.col("other") > 0)), ("Gross profit", "Operating income", "operating", run), ("Operating income", "Tax & other", "below", end & (F.col("below") > 0)), ("Operating income", "Net income", "net", end),
    ]
    made = F.array(*[F.when(cond, F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.round(F.col(v)).alias("value"))) for a, b, v, cond in links])
    return r.select("ticker", "year", F.inline(F.array_compact(made)))

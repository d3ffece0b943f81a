"""Counts of distinct values and quantiles by sketches that merge: one row a day and kind is stored, and any range is answered from these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of a distinct count as a power of two, and what its error is in 95 % of cases: 2 * 1.04 / sqrt(2^12); items of a quantile sketch, and its error of rank.
BUCKETS, ERROR = 12, 0.0325
ITEMS, RANK_ERROR = 200, 0.0165


def daily(events: DataFrame, kind: str, ident: str, value: str, time: str = "ts") -> DataFrame:
    """(day, kind, n, ids, sizes): per day and kind the rows, a sketch of the distinct ids and one of the values; combines map-side. Nulls are counted in n alone."""
    made = [F.count("*").alias("n"), F.hll_sketch_agg(ident, BUCKETS).alias("ids"), F.kll_sketch_agg_double(F.col(value).cast("double"), ITEMS).alias("sizes")]
    return events.groupBy(F.to_date(time).alias("day"), F.col(kind).alias("kind")).agg(*made)


def merged(stored: DataFrame, ranges: DataFrame, shares: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """(rid, kind, n, ids, q_50, ...) of ranges (rid, first, last), both days included, from the stored rows. ranges is a small table of questions."""
    hit = stored.join(F.broadcast(ranges), (F.col("day") >= F.col("first")) & (F.col("day") <= F.col("last")))
    one = hit.groupBy("rid", "kind").agg(F.sum("n").alias("n"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_double("sizes").alias("sizes"))
    quantiles = [F.kll_sketch_get_quantile_double("sizes", F.lit(s)).alias(f"q_{round(100 * s)}") for s in shares]
    return one.select("rid", "kind", "n", F.hll_sketch_estimate("ids").alias("ids"), *quantiles)

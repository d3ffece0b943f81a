"""Rows of the catalogue reach every branch of the rules that they are about."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import gate
from quarry.plans import catalog

SF = "/root/testdata/sf0.001"


def test_verdict_branches(spark):
    r = catalog.QUERIES["faithfulness_verdict"](spark, SF)
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0))
    n = r.agg(hit(F.col("n_ungrounded") > 0), hit(F.col("n_unsupported") > 0), hit(F.col("n_wrong") > 0), hit(F.col("n_material") > 0), hit(F.col("passed")), hit(~F.col("passed")), F.countDistinct("reason")).first()
    assert all(n[:6])
    assert n[6] >= 5


def test_match_and_change(spark):
    assert {r.matched for r in catalog.QUERIES["answer_match"](spark, SF).collect()} == {True, False}
    assert {r.change for r in catalog.QUERIES["topic_diff_by_period"](spark, SF).collect()} >= {"new", "removed"}
    assert {r.pattern for r in catalog.QUERIES["injection_hits"](spark, SF).collect()} == {"ignore", "disregard", "role", "system", "reveal", "forget", "rules"}
    assert {r.kind for r in catalog.QUERIES["figure_findings"](spark, SF).collect()} == {"figure", "ratio"}
    assert catalog.QUERIES["figure_charts"](spark, SF).count() > 0


def test_grounded_before(spark):
    """A figure counts once some earlier passage's digits hold it, a sentence once enough of its words were said before; other keys don't count."""
    passages = spark.createDataFrame([("a", 0, "We sold 1,250 lamps of brass"), ("a", 3, "at $77 each"), ("b", 0, "$99"), ("a", 5, None)], "key string, at int, text string")
    answers = spark.createDataFrame([("a", 1, "It was 250 lamps and $77 and $99. Lamps of brass we sold. Quite other words stand here"), ("a", 4, "It was $77. Quite [1] other words stand here"), ("b", 0, "$99"), ("c", 0, None)], "key string, at int, text string")
    got = {(r.key, r["at"]): (r.figures, r.ungrounded, r.unsupported) for r in gate.grounded_before(answers, passages).collect()}
    assert got == {("a", 1): (3, 2, 1), ("a", 4): (1, 0, 0), ("b", 0): (1, 1, 0), ("c", 0): (0, 0, 0)}

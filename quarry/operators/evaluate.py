"""Evaluation of retrieval and answers over a table of questions with gold evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import squeeze


def tail(url):  # noqa: ANN001, ANN201
    """The last part of a URL, by which a source is told."""
    return F.element_at(F.split(url, "/"), -1)


def context_hits(questions: DataFrame, hits: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, context_hit): 1 if a retrieved text (hits: qid, id; texts: id, text) holds the question's gold passage, blanks and case aside."""
    flat = lambda c: F.lower(squeeze(F.col(c)))
    found = hits.join(texts, "id").join(questions.select("qid", "gold"), "qid").where(flat("text").contains(flat("gold"))).select("qid").distinct().withColumn("context_hit", F.lit(1))
    return questions.select("qid").join(found, "qid", "left").na.fill(0, ["context_hit"])


def rows(questions: DataFrame, hits: DataFrame, texts: DataFrame, answered: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(qid, context_hit, answer_match, faithful, has_citation, refused): answered (qid, answer, matched); verdicts (id = qid, passed)."""
    a = answered.select("qid", F.col("matched").cast("int").alias("answer_match"), F.col("answer").rlike(r"\[\d+\]").cast("int").alias("has_citation"))
    v = verdicts.select(F.col("id").alias("qid"), F.col("passed").cast("int").alias("faithful"))
    out = context_hits(questions, hits, texts).join(a, "qid", "left").join(v, "qid", "left").na.fill(0, ["answer_match", "has_citation", "faithful"])
    return out.withColumn("refused", 1 - F.col("faithful"))


def summary(measured: DataFrame) -> DataFrame:
    """One row: n, and the mean of each flag rounded to four places; zeros without rows."""
    flags = ("context_hit", "answer_match", "faithful", "has_citation", "refused")
    return measured.agg(F.count("*").alias("n"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c) for c in flags])

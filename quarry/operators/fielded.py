"""Search over several fields with weights (BM25F), stems and stop words.

A term's weight in a document is the sum over fields of the field's weight times how often the term stands there, against the field's
length; this sum saturates once, over all fields. Terms are stems of the words that are no stop words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators.search import best
from quarry.sources.tables import cut

#: Words that say nothing about a document.
STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with"]
#: What ends of English words become, in this order: plurals, then what verbs add.
ENDINGS = [("^(.{2,})ies$", "y"), ("^(.+ss)es$", ""), ("^(.{2,}[^su])s$", ""), ("^(.*[aeiouy].*[^e])ing$", ""), ("^(.*[aeiouy].*[^e])ed$", "")]


def stem(word: Column) -> Column:
    for ending, becomes in ENDINGS:
        word = F.regexp_replace(word, ending, "$1" + becomes)
    return word


def terms(text: Column, stop: list[str] = STOP) -> Column:
    """Words of a text that are no stop words."""
    return F.filter(tokens(F.coalesce(text, F.lit(""))), lambda w: ~w.isin(*stop))


def postings(docs: DataFrame, fields: dict[str, float], id_col: str = "doc_id", stop: list[str] = STOP) -> DataFrame:
    """(id, field, term, tf, dl): how often a stem stands in a field (its number in `fields`), and how many the field has."""
    each = F.array(*[F.struct(F.lit(i).alias("field"), terms(F.col(c), stop).alias("ws")) for i, c in enumerate(fields)])
    rows = docs.select(F.col(id_col).alias("id"), F.inline(each)).select("id", "field", F.size("ws").alias("dl"), F.explode("ws").alias("word"))
    return rows.groupBy("id", "field", "dl", stem(F.col("word")).alias("term")).agg(F.count("*").alias("tf"))


def sizes(docs: DataFrame, fields: dict[str, float], stop: list[str] = STOP) -> DataFrame:
    """One row: n, and the mean size of each field as mean_0 and so on."""
    return docs.agg(F.count("*").alias("n"), *[F.avg(F.size(terms(F.col(c), stop))).alias(f"mean_{i}") for i, c in enumerate(fields)])


def bm25f(docs: DataFrame, questions: DataFrame, fields: dict[str, float], k: int, id_col: str = "doc_id", k1: float = 1.2, b: float = 0.75, stop: list[str] = STOP) -> DataFrame:
    """(qid, id, score, rank) of questions (qid, qtext): fields are columns of docs with their weights. A null field has no terms; only documents that share a stem are ranked."""
    post = postings(docs, fields, id_col, stop)
    asked = questions.select("qid", F.explode(terms(F.col("qtext"), stop)).alias("word")).select("qid", stem(F.col("word")).alias("term")).distinct()
    own = post.join(asked.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(sizes(docs, fields, stop)))  # one row of sizes
    pick = lambda make: F.coalesce(*[F.when(F.col("field") == i, make(i, c)) for i, c in enumerate(fields)])
    weight, mean = pick(lambda i, c: F.lit(float(fields[c]))), pick(lambda i, c: F.col(f"mean_{i}"))
    part = weight * F.col("tf") / (1 - b + b * F.col("dl") / mean)
    held = own.groupBy("id", "term", "n").agg(F.sum(part).alias("w"))
    df = cut(held.groupBy("term").agg(F.count("*").alias("df"), F.first("n").alias("n")))
    weights = asked.join(df, "term").select("qid", "term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("w"))
    return best(held.select("id", "term", (F.col("w") * (k1 + 1) / (F.col("w") + k1)).alias("v")), weights, k, docs.count(), questions.count())

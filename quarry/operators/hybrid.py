"""Hybrid retrieval of a batch of questions over two indexes, and answers with facts and markers.

The questions' words meet the lexical index, widened by what else they look for; their vectors meet the vector index. Both lists are fused
by reciprocal ranks into one table of candidates, written once; these are ranked again by the question's own words and cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import ann, search
from quarry.operators.segments import Index
from quarry.sources.tables import cut


def candidates(spark: SparkSession, vectors: str, index: Index, questions: DataFrame, depth: int = 30, probes: int | None = None) -> DataFrame:
    """(qid, id, rrf, dense_rank, lexical_rank, rank) of questions (qid, qtext, qvec), checkpointed; a question without a vector has lexical hits alone. vectors is the folder of a vector index."""
    lexical = search.ranked(index.read(questions), questions, depth)
    dense = ann.search(spark, vectors, questions.select("qid", "qvec"), depth, probes)
    return cut(search.rrf(dense, lexical))


def reranked(index: Index, found: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, id, score) of candidates by the words of questions (qid, qtext), from the index's postings: no text is read again."""
    built = index.read(questions)
    if "packed" in built:
        return search.rerank_in(built["packed"], found, questions)
    return search.rerank_by(built["postings"].join(search.small(found.select("id").distinct()), "id", "left_semi"), found, questions)


def retrieve(spark: SparkSession, vectors: str, index: Index, questions: DataFrame, top: int = 6, depth: int = 30, probes: int | None = None) -> DataFrame:
    """(qid, id, score, rank) of questions (qid, question, qtext, qvec): qtext is what is looked for, question what candidates are ranked by."""
    found = candidates(spark, vectors, index, questions, depth, probes)
    return search.adaptive_k(reranked(index, found, questions.select("qid", F.col("question").alias("qtext"))), top)


def answers(hits: DataFrame, texts: DataFrame, questions: DataFrame, lines: DataFrame) -> DataFrame:
    """(qid, answer) of questions (qid, question): the fact's line first where lines (qid, line) has one, marked [F], then the best sentence of each of the three best hits, marked by its rank. Without either: no row."""
    said = search.extractive(hits, texts, questions.select("qid", F.col("question").alias("qtext")))
    both = questions.select("qid").join(lines.select("qid", F.concat("line", F.lit(" [F]")).alias("fact")), "qid", "left").join(said, "qid", "left")
    return both.select("qid", F.concat_ws(" ", "fact", "answer").alias("answer")).where("answer <> ''")

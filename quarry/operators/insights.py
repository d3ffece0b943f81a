"""Proactive checks: red flags, compliance, and what changed between two years of risk sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import squeeze
from quarry.operators import gate, search

# What a red flag reads like, how severe it is (medium if not named), and what is asked to find them.
FLAGS = {
    "going_concern": "(?i)going concern",
    "restatement": "(?i)restate(?:d|ment)?",
    "material_weakness": "(?i)material weakness",
    "litigation": "(?i)litigation|lawsuit|legal proceeding",
    "impairment": "(?i)impairment",
    "risk_factors": "(?i)risk factors",
}
SEVERITY = {"going_concern": "high", "material_weakness": "high", "restatement": "high", "litigation": "medium"}


def flagged(hits: DataFrame, chunks: DataFrame, patterns: dict[str, str] = FLAGS, window: int = 90) -> DataFrame:
    """(qid, flag, marker, id, snippet): of retrieved chunks (qid, id, rank; chunks: id, text), each flag once for each marker."""
    found = gate.flags(chunks.join(hits.select("id").distinct(), "id", "left_semi").select("id", "text"), patterns, window)
    marked = hits.select("qid", "id", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")).alias("marker"))
    return marked.join(found, "id").groupBy("qid", "flag", "marker").agg(F.min(F.struct("id", "snippet")).alias("f")).select("qid", "flag", "marker", "f.id", "f.snippet")


def probed(built: dict[str, DataFrame], chunks: DataFrame, probe: str, most: int = 10) -> DataFrame:
    """(qid, id, rank): of each company (qid: ticker of chunks: id, ticker) its `most` chunks that answer a probe question best. All companies at once: the question is asked of the whole index, ranks are by company."""
    spark = chunks.sparkSession
    found = search.scores(built, spark.createDataFrame([(0, probe)], "qid int, qtext string")).drop("qid")
    return search.top_k(found.join(chunks.select("id", F.col("ticker").alias("qid")), "id"), most).select("qid", "id", "rank")


def red_flags(hits: DataFrame, chunks: DataFrame, sources: DataFrame, patterns: dict[str, str] = FLAGS, severity: dict[str, str] = SEVERITY) -> DataFrame:
    """flagged() with severity, and title and source_url of the cited chunk (sources: id, title, source_url), empty where it has none."""
    level = F.coalesce(*[F.when(F.col("flag") == k, v) for k, v in severity.items()], F.lit("medium"))
    told = flagged(hits, chunks, patterns).join(sources, "id", "left")
    return told.select("qid", "flag", "marker", level.alias("severity"), "snippet", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("source_url", F.lit("")).alias("source_url"))


def scan_report(questions: DataFrame, hits: DataFrame, flags: DataFrame) -> DataFrame:
    """(qid, scanned, n_flags, clean): chunks looked at and flags found, for every question."""
    seen, found = hits.groupBy("qid").agg(F.count("*").alias("scanned")), flags.groupBy("qid").agg(F.count("*").alias("n_flags"))
    out = questions.select("qid").join(seen, "qid", "left").join(found, "qid", "left").na.fill(0, ["scanned", "n_flags"])
    return out.withColumn("clean", F.col("n_flags") == 0)


def uncited(findings: DataFrame, hits: DataFrame) -> DataFrame:
    """Findings (qid, label, marker) whose marker no retrieved chunk of the question has."""
    valid = hits.select("qid", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")).alias("marker")).distinct()
    return findings.join(valid, ["qid", "marker"], "left_anti")


def compliance(questions: DataFrame, hits: DataFrame, flags: DataFrame, findings: DataFrame) -> DataFrame:
    """(qid, verdict, n_flags, n_uncited, reason): insufficient_evidence without a hit, else ok."""
    loose = uncited(findings, hits).groupBy("qid").agg(F.count("*").alias("n_uncited"))
    r = scan_report(questions, hits, flags).join(loose, "qid", "left").na.fill(0, ["n_uncited"])
    none = F.col("scanned") == 0
    # fixed values: what the report says
    reason = F.when(none, "No supporting evidence was retrieved for this query.").when(F.col("n_uncited") > 0, F.concat("n_uncited", F.lit(" finding(s) lacked a valid citation and were flagged."))).otherwise("")
    return r.select("qid", F.when(none, "insufficient_evidence").otherwise("ok").alias("verdict"), "n_flags", "n_uncited", reason.alias("reason"))


def risk_sections(chunks: DataFrame, hint: str = "risk factor") -> DataFrame:
    """chunks whose section speaks of risk and whose filing_date has a year, with year."""
    year = F.left(F.col("filing_date").cast("string"), F.lit(4))
    return chunks.where(F.lower(F.coalesce("section", F.lit(""))).contains(hint)).withColumn("year", year).where("year <> ''")


def newest_years(rows: DataFrame, n: int = 2) -> DataFrame:
    """rows of each ticker's n newest years, with place (1: newest)."""
    by = Window.partitionBy("ticker").orderBy(F.desc("year"))
    years = rows.select("ticker", "year").distinct().withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)
    return rows.join(years, ["ticker", "year"])


def risk_text(rows: DataFrame, chunks: int = 12, size: int = 900) -> DataFrame:
    """(ticker, year, text): the first chunks of a year's risk section, cut to `size` characters and joined. Only so many of a year are gathered."""
    by = Window.partitionBy("ticker", "year").orderBy("chunk_id")
    first = rows.withColumn("k", F.row_number().over(by)).where(F.col("k") <= chunks)
    items = F.sort_array(F.collect_list(F.struct("k", F.left(F.col("text"), F.lit(size)).alias("t"))))
    return first.groupBy("ticker", "year").agg(F.array_join(F.transform(items, lambda x: x["t"]), "\n\n").alias("text"))


def risk_changes(topics: DataFrame) -> DataFrame:
    """(ticker, topic, change): from mentions (ticker, year, topic) of the two newest years: new, removed, or escalated with more mentions than before."""
    both = newest_years(topics, 2).groupBy("ticker", "topic").agg(F.count(F.when(F.col("place") == 1, 1)).alias("now"), F.count(F.when(F.col("place") == 2, 1)).alias("then"))
    pairs = topics.select("ticker", "year").distinct().groupBy("ticker").agg(F.count("*").alias("years")).where("years > 1")
    change = F.when(F.col("then") == 0, "new").when(F.col("now") == 0, "removed").when(F.col("now") > F.col("then"), "escalated")
    return both.join(pairs, "ticker", "left_semi").select("ticker", "topic", change.alias("change")).where("change is not null")


def labels(rows: DataFrame) -> DataFrame:
    """rows with label: ticker, kind of document, page and section of a citation."""
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit("p."), F.col("page").cast("string")))
    section = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit("· "), "section"))
    return rows.withColumn("label", F.concat_ws(" ", "ticker", "doc_type", page, section))


def evidence_text(ranked: DataFrame, size: int = 900) -> DataFrame:
    """(qid, context): retrieved chunks (qid, place, marker, label, text) in the order of place, each cut to `size` characters, as one text."""
    line = F.concat("marker", F.lit(" ("), "label", F.lit(") "), F.left(squeeze(F.col("text")), F.lit(size)))
    return ranked.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))


def untrusted(text):  # noqa: ANN001, ANN201
    """A text wrapped so that a reader takes it for data."""
    return F.concat(F.lit("<untrusted_content>\n"), text, F.lit("\n</untrusted_content>"))

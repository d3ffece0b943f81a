"""What a question asks for, and answers from filed facts; dictionaries are small tables given by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens


def fiscal_year(question: Column) -> Column:
    """A year 20dd, else one written FYdd or FYdddd; null without."""
    long = F.regexp_extract(question, r"\b(20\d\d)\b", 1)
    short = F.regexp_extract(question, r"(?i)\bFY\s?'?(\d\d(?:\d\d)?)\b", 1)
    return F.when(long != "", long).when(short != "", F.when(F.length(short) == 4, short).otherwise(F.concat(F.lit("20"), short))).cast("int")


def full_year(digits: Column) -> Column:
    return F.when(F.length(digits) == 2, F.concat(F.lit("20"), digits)).otherwise(digits)


def numeric(question: Column, hints: list[str]) -> Column:
    """Whether a question turns on a figure: one of the words of `hints`, a share or money."""
    return question.rlike(r"(?i)\b(?:" + "|".join(hints) + r")\b") | question.rlike("[%$]")


def grams(questions: DataFrame, longest: DataFrame) -> DataFrame:
    """(qid, at, gram): each run of words of a question, in lower case, from one word to as many as `longest` (one row, n) says."""
    words = questions.crossJoin(F.broadcast(longest)).select("qid", "n", F.regexp_extract_all(F.lower("question"), F.lit(r"[\p{L}\p{N}&.#'-]+"), F.lit(0)).alias("ws"))
    starts = words.where(F.size("ws") > 0).select("qid", "n", "ws", F.explode(F.sequence(F.lit(1), F.size("ws"))).alias("at"))
    sizes = F.sequence(F.lit(1), F.least(F.col("n"), F.size("ws") - F.col("at") + 1))
    return starts.where("n > 0").select("qid", "at", F.explode(sizes).alias("size"), "ws").select("qid", "at", F.btrim(F.array_join(F.slice("ws", F.col("at"), F.col("size")), " "), F.lit(" .'-")).alias("gram"))


def longest_phrase(questions: DataFrame, phrases: DataFrame, phrase: str, value: str) -> DataFrame:
    """(qid, value): of the phrases that a question holds as whole words the longest, the first of equal ones.

    Runs of a question's words are joined to the phrases by equality, so neither side is compared with all of the other.
    """
    words = F.regexp_extract_all(F.lower(F.col(phrase)), F.lit(r"[\p{L}\p{N}&.#'-]+"), F.lit(0))
    p = phrases.select(F.btrim(F.array_join(words, " "), F.lit(" .'-")).alias("gram"), F.size(words).alias("size"), F.length(phrase).alias("n"), F.col(value).alias(value))
    hit = grams(questions, p.agg(F.coalesce(F.max("size"), F.lit(0)).alias("n"))).join(p, "gram")
    return hit.groupBy("qid").agg(F.min_by(value, F.struct(-F.col("n"), "at", "gram", value)).alias(value))


def tickers(questions: DataFrame, companies: DataFrame, symbol: str = r"\b[A-Z]{1,5}\b", never: tuple[str, ...] = ("A", "I")) -> DataFrame:
    """(qid, ticker): the first known symbol of the form `symbol` that a question holds (some words are none), else the longest company name."""
    words = questions.select("qid", F.posexplode(F.regexp_extract_all("question", F.lit(symbol), F.lit(0))).alias("pos", "ticker")).where(~F.col("ticker").isin(*never))
    known = words.join(companies.select("ticker").distinct(), "ticker").groupBy("qid").agg(F.min_by("ticker", "pos").alias("symbol"))
    named = longest_phrase(questions, companies.select("ticker", F.lower("name").alias("name")), "name", "ticker")
    return questions.select("qid").join(known, "qid", "left").join(named, "qid", "left").select("qid", F.coalesce("symbol", "ticker").alias("ticker")).where("ticker is not null")


def numeric_answers(questions: DataFrame, companies: DataFrame, aliases: DataFrame, points: DataFrame, symbol: str = r"\b[A-Z]{1,5}\b") -> DataFrame:
    """(qid, ticker, metric, period_end, val): for the year a question names, else the newest; questions without a company, a metric or a fact have no row."""
    asked = questions.select("qid", fiscal_year(F.col("question")).alias("fy")).join(tickers(questions, companies, symbol), "qid").join(longest_phrase(questions, aliases, "alias", "metric"), "qid")
    hit = asked.join(points.withColumnRenamed("concept", "metric"), ["ticker", "metric"]).where("fy is null or fy = year(period_end)")
    return hit.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("period_end")))).where("rn = 1").select("qid", "ticker", "metric", "period_end", "val")


def answers_first_derived(questions: DataFrame, companies: DataFrame, ratios: DataFrame, shares: DataFrame, aliases: DataFrame, points: DataFrame, symbol: str = r"\b[A-Z]{1,5}\b") -> DataFrame:
    """(qid, ticker, metric, period_end, value, unit): a derived metric that a question names (ratios: alias, metric; shares: ticker, concept, period_end, value, unit) before a filed figure (aliases, points)."""
    pick = lambda names, rows: numeric_answers(questions, companies, names, rows.withColumn("val", F.struct("value", "unit")), symbol)
    first, then = pick(ratios, shares), pick(aliases, points)
    every = first.withColumn("place", F.lit(1)).unionByName(then.withColumn("place", F.lit(2)))
    return every.groupBy("qid").agg(F.min_by(F.struct("ticker", "metric", "period_end", "val.value", "val.unit"), "place").alias("a")).select("qid", "a.*")


def expanded(questions: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(qid, terms): what a search for the question also looks for, without what it says already, each once, in order.

    First the synonyms (a stated table: pos, key, synonym) of keys that the question holds, in the table's order; then, of years written
    FYdd or FYdddd, `fiscal 20dd` and `20dd`; then, of quarters, `third quarter` and `fiscal 20dd`.
    """
    low = questions.select("qid", "question", F.lower("question").alias("low"))
    table = synonyms.groupBy().agg(F.sort_array(F.collect_list(F.struct("pos", "key", "synonym"))).alias("table"))  # one row of the stated table
    said = low.crossJoin(F.broadcast(table)).withColumn("more", F.transform(F.filter("table", lambda s: F.col("low").contains(s["key"])), lambda s: s["synonym"]))
    years = F.regexp_extract_all("question", F.lit(r"(?i)\bFY\s?(\d{2,4})\b"), F.lit(1))
    quarter = r"(?i)\bQ([1-4])\s?(?:FY)?\s?(\d{2,4})\b"
    quarters = F.arrays_zip(F.regexp_extract_all("question", F.lit(quarter), F.lit(1)).alias("q"), F.regexp_extract_all("question", F.lit(quarter), F.lit(2)).alias("y"))
    names = F.array(*map(F.lit, ("first", "second", "third", "fourth")))
    of_years = F.flatten(F.transform(years, lambda y: F.array(F.concat(F.lit("fiscal "), full_year(y)), full_year(y))))
    of_quarters = F.flatten(F.transform(quarters, lambda x: F.array(F.concat(F.element_at(names, x["q"].cast("int")), F.lit(" quarter")), F.concat(F.lit("fiscal "), full_year(x["y"])))))
    terms = F.filter(F.array_distinct(F.concat("more", of_years, of_quarters)), lambda t: ~F.col("low").contains(F.lower(t)))
    return said.select("qid", F.array_join(terms, "; ").alias("terms"))


def widened(questions: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(qid, qtext): the question followed by what expanded() adds."""
    more = expanded(questions, synonyms)
    return questions.join(more, "qid").select("qid", F.concat_ws(" ", "question", F.nullif(F.replace("terms", F.lit(";")), F.lit(""))).alias("qtext"))


def answer_match(rows: DataFrame, stop: list[str], share: float = 0.5) -> DataFrame:
    """rows (id, answer, gold) with matched: a number of two digits or more in common if the gold has one, else `share` of its longer words that aren't stop words."""
    numbers = lambda t: F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"(\d[\d,]*)(?:\.\d+)?"), F.lit(1)), lambda x: F.ltrim(F.regexp_replace(x, ",", ""), F.lit("0"))), lambda x: F.length(x) >= 2)
    words = lambda t: F.array_except(F.array_distinct(F.filter(tokens(t), lambda w: F.length(w) > 2)), F.array(*map(F.lit, stop)))
    gold, answer = F.col("gold"), F.col("answer")
    common = F.size(F.array_intersect(words(gold), words(answer)))
    matched = F.when(F.size(numbers(gold)) > 0, F.arrays_overlap(numbers(gold), numbers(answer))).otherwise((F.size(words(gold)) > 0) & (common >= share * F.size(words(gold))))
    return rows.select("id", F.coalesce(matched, F.lit(False)).alias("matched"))

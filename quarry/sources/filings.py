"""Filings, statements, news and uploads as texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of uploaded files that hold text, and the most bytes of one.
UPLOADS, MOST_BYTES = ("html", "htm", "txt", "md", "csv"), 15 * 1024 * 1024


def recent(filings: DataFrame, most: int, keys: tuple[str, ...] = ("ticker", "form")) -> DataFrame:
    """The newest `most` filings of each ticker and form."""
    by = Window.partitionBy(*keys).orderBy(F.desc("filing_date"), "accn")
    return filings.withColumn("k", F.row_number().over(by)).where(F.col("k") <= most).drop("k")


def registrants(tickers: DataFrame, known: DataFrame) -> DataFrame:
    """(ticker, cik) of tickers that a table (ticker, cik) knows, in capitals, the number filled to ten digits."""
    own = known.select(F.upper("ticker").alias("ticker"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik")).dropDuplicates(["ticker"])
    return tickers.select(F.upper("ticker").alias("ticker")).distinct().join(own, "ticker")


def exhibits(files: DataFrame, pattern: str = r"(?i)ex(?:hibit)?[-_]?21") -> DataFrame:
    """(accn, name): of the files (accn, pos, name) of each filing the first whose name says it is the list of subsidiaries."""
    return files.where(F.col("name").rlike(pattern)).groupBy("accn").agg(F.min_by("name", "pos").alias("name"))


def url(cik: Column, accn: Column, base: str) -> Column:
    """Where a filing lies under `base`: its registrant without leading zeros, its number without dashes."""
    return F.concat_ws("/", F.lit(base), F.coalesce(F.nullif(F.ltrim(cik.cast("string"), F.lit("0")), F.lit("")), F.lit("0")), F.replace(accn, F.lit("-")))


def statement_lines(points: DataFrame, newest: int = 4) -> DataFrame:
    """(ticker, item, line) of (ticker, item, period_end, val): an item's newest periods as one line of text."""
    by = Window.partitionBy("ticker", "item").orderBy(F.desc("period_end"))
    own = points.where("val is not null").withColumn("k", F.row_number().over(by)).where(F.col("k") <= newest)
    cell = F.concat(F.col("period_end").cast("string"), F.lit(" "), F.format_number("val", 0))
    cells = F.transform(F.sort_array(F.collect_list(F.struct("k", cell.alias("c")))), lambda x: x["c"])
    return own.groupBy("ticker", "item").agg(F.concat(F.col("item"), F.lit(": "), F.array_join(cells, "; ")).alias("line"))


def articles(news: DataFrame) -> DataFrame:
    """(id, ticker, filing_date, content) of news (id, ticker, title, summary, published as YYYYMMDD and whatever follows); a date that can't be read is null."""
    day = F.try_to_timestamp(F.left("published", F.lit(8)), F.lit("yyyyMMdd")).cast("date")
    return news.select("id", "ticker", day.alias("filing_date"), F.concat_ws("\n\n", F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("summary"), F.lit(""))).alias("content"))


def uploads(spark: SparkSession, folder: str, most: int = MOST_BYTES) -> DataFrame:
    """(id, name, content, content_type, error) of the files in a folder; those of other kinds or over `most` bytes have an error and no content."""
    f = spark.read.format("binaryFile").load(folder)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    error = F.when(F.col("length") > most, "too large").when(~kind.isin(*UPLOADS), "unsupported")
    return f.select(F.sha2("path", 256).alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.when(error.isNull(), F.decode("content", "UTF-8")).alias("content"), F.when(kind.isin("html", "htm"), "html").otherwise("text").alias("content_type"), error.alias("error"))


def ingested_facts(flat: DataFrame, companies: DataFrame) -> DataFrame:
    """(ticker, n): facts of companyfacts() by ticker; companies (cik, ticker), and 0 for those without any."""
    n = flat.groupBy("cik").agg(F.count("*").alias("n"))
    return companies.join(n, "cik", "left").select("ticker", F.coalesce("n", F.lit(0)).alias("n"))

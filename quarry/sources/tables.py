"""Readers and the adapter views that re-host financial records on the star-schema tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Tables whose rows take long to work on.
SPREAD = ("documents", "conversations", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows; one of fewer partitions than cores (a single small file) is dealt out, and larger ones never are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in SPREAD and df.rdd.getNumPartitions() < cores else df


#: The folder of a local session that names none.
_OWN: dict[str, str] = {}


def shared(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a local session that names none gets a new one of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="quarry") if spark.sparkContext.applicationId not in _OWN else "")


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder: what is used several times is worked out once, and survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder under the shared one, removed at the end."""
    folder = f"{shared(spark)}/{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filed facts: a line item is a value of a concept (its return flag) of a ticker (its supplier), filed when ordered."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    year = F.year("l_shipdate")
    start = F.when(F.col("l_linestatus") == "F", F.make_date(year, F.lit(1), F.lit(1))).otherwise(F.make_date(year, F.lit(10), F.lit(1)))
    return line.join(orders.select("o_orderkey", "o_orderdate"), line["l_orderkey"] == F.col("o_orderkey")).select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), F.col("l_returnflag").alias("concept"), F.lit("USD").alias("unit"), F.make_date(year, F.lit(12), F.lit(31)).alias("period_end"),
        start.alias("period_start"), F.lit("10-K").alias("form"), F.col("l_extendedprice").alias("val"), F.col("o_orderdate").cast("date").alias("filed"), F.col("l_orderkey").alias("seq1"), F.col("l_linenumber").alias("seq2"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = F.when(F.col("doc_id") % 5 == 0, "ws_a").otherwise("public")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.upper("source").alias("ticker"), F.col("lang").alias("doc_type"), workspace.alias("workspace_id"), "text")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("org_id"), "user_id", "ts", F.col("event_type").alias("kind"), F.col("value").cast("double").alias("tokens"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One close a day and user: that of the last purchase."""
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    last = Window.partitionBy("user_id", F.to_date("ts")).orderBy(F.desc("ts"), F.desc("event_id"))
    return bought.withColumn("rn", F.row_number().over(last)).where("rn = 1").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("d"), F.col("value").cast("double").alias("close"))


def companyfacts(raw: DataFrame) -> DataFrame:
    """Flattened (cik, taxonomy, concept, unit, end, start, val, accn, form, filed) of JSON company facts in a column `json`; rows without val, end or accn go."""
    entry = "array<struct<end:date,start:date,val:double,accn:string,fy:int,fp:string,form:string,filed:date>>"
    parsed = raw.select(F.from_json("json", f"struct<cik:bigint,facts:map<string,map<string,struct<units:map<string,{entry}>>>>>").alias("j"))
    one = parsed.select(F.col("j.cik").alias("cik"), F.explode("j.facts").alias("taxonomy", "concepts"))
    two = one.select("cik", "taxonomy", F.explode("concepts").alias("concept", "c")).select("cik", "taxonomy", "concept", F.explode("c.units").alias("unit", "e"))
    return two.select("cik", "taxonomy", "concept", "unit", F.inline("e")).where("val is not null and end is not null and accn is not null")


def insert_absent(target: DataFrame, rows: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Rows to append: those whose keys the target doesn't have, once each; of several of a key the first by `order`, any without."""
    if order is None:
        once = rows.dropDuplicates(keys)
    else:
        once = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
    return once.join(target.select(*keys).distinct(), keys, "left_anti")


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a list of ids."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """What a deletion of a list of ids leaves."""
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def existing(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Those of the ids that rows have."""
    return ids.select(key).distinct().join(rows.select(key), key, "left_semi")


def in_workspaces(rows: DataFrame, workspaces: list[str]) -> DataFrame:
    """Rows of these workspaces; a row without one is public."""
    return rows.where(F.coalesce("workspace_id", F.lit("public")).isin(workspaces))


def questions_file(lines: DataFrame) -> DataFrame:
    """Questions of a JSON-lines text (a column `value`): comments, blank lines, what doesn't parse and rows without a question are left out."""
    q = lines.where("value not rlike '^\\\\s*(#|//|$)'").select(F.from_json("value", "struct<id:string,question:string,answer:string,evidence:string,ticker:string>").alias("q")).select("q.*")
    return q.where("trim(coalesce(question, '')) <> ''")


def wanted_facts(flat: DataFrame, concepts: DataFrame, taxonomies: tuple[str, ...] = ("us-gaap", "ifrs-full")) -> DataFrame:
    """Of companyfacts() the concepts asked for, in these taxonomies."""
    return flat.where(F.col("taxonomy").isin(*taxonomies)).join(concepts.select("concept").distinct(), "concept", "left_semi")

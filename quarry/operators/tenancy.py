"""Tenants: scopes, current state from change rows, exports, seats, and priorities among sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def accessible(rows: DataFrame, workspaces: DataFrame, org: int | str) -> DataFrame:
    """Rows of public workspaces and of an organisation's own."""
    own = workspaces.where(F.col("org_id") == org).select("workspace_id")
    return rows.where("workspace_id = 'public'").unionByName(rows.where("workspace_id <> 'public'").join(own, "workspace_id", "left_semi").select(*rows.columns))


def current(changes: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value of each key from rows that are only ever added; a null value is a deletion."""
    return changes.groupBy(*keys).agg(F.max_by(F.struct(value), F.struct(*order)).alias("last")).select(*keys, F.col(f"last.{value}").alias(value)).where(F.col(value).isNotNull())


def export(tables: dict[str, DataFrame], org: int | str) -> DataFrame:
    """(table, row as JSON) of all that an organisation has."""
    parts = [df.where(F.col("org_id") == org).select(F.lit(name).alias("table"), F.to_json(F.struct(*sorted(df.columns))).alias("row")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def erase(tables: dict[str, DataFrame], org: int | str) -> dict[str, DataFrame]:
    return {name: df.where(~F.col("org_id").eqNullSafe(F.lit(org))) for name, df in tables.items()}


def seats(members: DataFrame, invites: DataFrame, limits: DataFrame) -> DataFrame:
    """(org_id, used, free): members and pending invites against a limit."""
    used = members.select("org_id").unionByName(invites.where("status = 'pending'").select("org_id")).groupBy("org_id").agg(F.count("*").alias("used"))
    return limits.join(used, "org_id", "left").select("org_id", F.coalesce("used", F.lit(0)).alias("used"), F.greatest(F.lit(0), F.col("seats") - F.coalesce("used", F.lit(0))).alias("free"))


def ranked_at_least(members: DataFrame, ranks: DataFrame, least: str) -> DataFrame:
    """Members whose role ranks as high as another or higher; ranks (role, rank) is a small table."""
    floor = ranks.where(F.col("role") == least).select(F.col("rank").alias("least"))
    return members.join(F.broadcast(ranks), "role").crossJoin(F.broadcast(floor)).where("rank >= least").select(*members.columns)


def first_source(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of rows (keys, priority, value) the first that has a value; NaN is none."""
    real = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return real.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("priority"))).where("rn = 1").drop("rn")


def surprises(earnings: DataFrame, newest: int = 6) -> DataFrame:
    """(ticker, d, surprise_pct) of a ticker's newest reported quarters: earned against estimated."""
    done = earnings.where("eps_reported is not null").withColumn("rn", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("d"))))
    return done.where(F.col("rn") <= newest).select("ticker", "d", F.when(F.col("eps_estimate") != 0, F.round((F.col("eps_reported") - F.col("eps_estimate")) / F.abs("eps_estimate") * 100, 1)).alias("surprise_pct"))


def owned(rows: DataFrame, parents: DataFrame, key: str, org: int | str) -> DataFrame:
    """Rows whose parent (by key) is an organisation's: messages by their conversation, chunks by their workspace."""
    return rows.join(parents.where(F.col("org_id") == org).select(key).distinct(), key, "left_semi")


def invitations(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """Of invitations (org_id, email, ts) those for which there is a free seat, in the order of ts; taken is seats()'s result."""
    turn = F.row_number().over(Window.partitionBy("org_id").orderBy("ts", "email"))
    return wanted.withColumn("turn", turn).join(taken.select("org_id", "free"), "org_id").where("turn <= free").select(*wanted.columns)


def newest(rows: DataFrame, key: str, value: int | str, order: str, most: int) -> DataFrame:
    """A tenant's rows, newest first, at most so many."""
    return rows.where(F.col(key) == value).orderBy(F.desc(order)).limit(most)


def said_in(meta: Column) -> tuple[Column, Column]:
    """Verdict and route out of an answer's JSON: {"gate": {"verdict": ...}, "route": ...}; null where it has none."""
    return F.get_json_object(meta, "$.gate.verdict"), F.get_json_object(meta, "$.route")


def conversation_text(turns: DataFrame) -> DataFrame:
    """(conv_id, markdown) of (conv_id, turn, role, text, meta): turns in order under their roles, an answer's verdict and route beside its role."""
    verdict, route = said_in(F.col("meta"))
    head = F.concat(F.lit("## "), "role", F.coalesce(F.concat(F.lit(" ("), F.concat_ws(", ", verdict, route), F.lit(")")), F.lit("")))
    line = F.struct("turn", F.concat(F.when(verdict.isNull() & route.isNull(), F.concat(F.lit("## "), "role")).otherwise(head), F.lit("\n"), "text").alias("line"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda t: t["line"]), "\n").alias("markdown"))


CSV = {"header": "true", "quoteAll": "true", "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": "\\N", "emptyValue": ""}


def write_csv(turns: DataFrame, folder: str) -> None:
    """Turns with verdict and route as CSV files: every value in quotes, quotes doubled, \\N for null."""
    verdict, route = said_in(F.col("meta"))
    turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), verdict.alias("verdict"), route.alias("route")).write.mode("overwrite").options(**CSV).csv(folder)


def read_csv(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("conv_id long, turn int, role string, text string, verdict string, route string").options(**CSV).csv(folder)

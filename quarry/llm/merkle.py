"""A manifest of a dataset as a Merkle tree, with a proof of each row.

A row's leaf is the digest of its columns. Leaves of a group (a language) are numbered by id; every 8 consecutive nodes become one of the
next level until one is left, the group's subroot. Subroots, numbered by group, likewise give the root. The tree is made in superblocks:
the nodes of 8^4 consecutive indices are one bucket, in which four levels collapse at once to the bucket's root; bucket roots are
numbered by bucket and reduced in the same way, until one is left. Then proofs go down: a bucket's own proof follows, for each of its
nodes, the siblings met within the bucket. No bucket has over 8^4 nodes, whatever share of the rows a group has, and only digests move.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from quarry.llm.common import arrow_schema, cut, lean

FANOUT, LEVELS = 8, 4
#: Hex digits of a digest.
WIDTH = 64


def digest(parts: Column) -> Column:
    return F.sha2(parts, 256)


def leaf(*cols: Column) -> Column:
    """Digest of columns: `-` for null, else the byte count of the text, `:`, the text; numbers as decimals."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return digest(F.concat(*[part(c.cast("string")) for c in cols]))


def numbered(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """df (g, ...) with idx, the row's place in its g from 0, and n, the rows of g. Ranges of (g, order) are sorted apart; what lies before each is summed up. Rows equal in all of these are dealt out."""
    salted = cut(df.withColumn("_salt", F.monotonically_increasing_id()))
    by = [F.col("g"), *[F.col(c) if isinstance(c, str) else c for c in order], F.col("_salt")]
    rows = cut(salted.repartitionByRange(*by).sortWithinPartitions(*by).drop("_salt").withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    ranges = rows.groupBy("g", "_range").agg(F.count("*").alias("_rows"), F.min("_at").alias("_low"))
    before = Window.partitionBy("g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumn("n", F.sum("_rows").over(Window.partitionBy("g"))).drop("_rows")
    return rows.join(ranges, ["g", "_range"]).withColumn("idx", F.col("_before") + F.col("_at") - F.col("_low")).drop("_range", "_at", "_low", "_before")


def floors(nodes: list[str], n: int) -> list[list[str]]:
    """The bucket's nodes by level, its root alone in the last: LEVELS levels up, or as many as n nodes in all need to become one."""
    out = [nodes]
    while len(out) <= LEVELS and n > 1:
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(below), FANOUT)])
        n = -(-n // FANOUT)
    return out


def collapse(nodes: DataFrame) -> DataFrame:
    """Of nodes (g, idx, n, node) the roots of buckets, in the same form."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        root = floors(rows["node"].tolist(), int(rows["n"].iloc[0]))[-1][0]
        return pd.DataFrame({"g": rows["g"].iloc[:1].tolist(), "idx": [rows["bucket"].iloc[0]], "n": [-(-int(rows["n"].iloc[0]) // FANOUT**LEVELS)], "node": [root]})

    return buckets(nodes.select("g", "idx", "n", "node")).groupBy("g", "bucket").applyInPandas(lean(run), "g string, idx long, n long, node string")


def buckets(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("bucket", F.expr(f"idx div {FANOUT**LEVELS}"))


def descend(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """nodes (g, idx, n, node, ...) with at, others and subroot: of each level up to the top the node's place among its siblings, and these siblings' digests in one text. above: (g, idx, at, others, subroot) of the buckets; subroot goes down as it is."""
    schema = StructType([*nodes.schema.fields]).add("at", ArrayType(IntegerType())).add("others", ArrayType(StringType())).add("subroot", "string")
    arrow, names = arrow_schema(schema), nodes.columns

    def run(rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows = rows.select(names).sort_by("idx")
        levels = floors(rows["node"].to_pylist(), rows["n"][0].as_py())
        at, others = [], []
        for i in range(len(rows)):
            places, texts = [], []
            for level in levels[:-1]:
                first = i // FANOUT * FANOUT
                places.append(i - first)
                texts.append("".join(level[first:i]) + "".join(level[i + 1 : first + FANOUT]))
                i //= FANOUT
            at.append(places + upper["at"][0].as_py())
            others.append(texts + upper["others"][0].as_py())
        return pa.table([*rows.columns, pa.array(at, arrow.field("at").type), pa.array(others, arrow.field("others").type), pa.array([upper["subroot"][0].as_py()] * len(rows), pa.string())], schema=arrow)

    keyed = above.select("g", F.col("idx").alias("bucket"), "at", "others", "subroot")
    return buckets(nodes).groupBy("g", "bucket").cogroup(keyed.groupBy("g", "bucket")).applyInArrow(lean(run), schema)


def reduced(nodes: DataFrame) -> list[DataFrame]:
    """nodes (g, idx, n, node), then the bucket roots of each round; in the last each g has one."""
    rounds = [nodes]
    while not rounds[-1].where("n > 1").isEmpty():
        rounds.append(cut(collapse(rounds[-1])))
    return rounds


def manifest(docs: DataFrame, cols: list[str] | None = None, id_col: str = "doc_id", group_col: str = "lang", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: id_col, group_col, those of keep, leaf, subroot, root, and at and others, a proof as verify() takes it.

    cols (doc_id, source, lang, n_chars, text where none are named) make the leaf. Null groups come first, then groups and within them
    ids in ascending order, null ids first; of equal ids the leaf decides, and rows equal in all have proofs of their own. A null or an
    empty column and a text of any length count as leaf() says. Other columns are not read, so names can't clash. An empty table gives no rows.
    """
    cols, keep = cols or ["doc_id", "source", "lang", "n_chars", "text"], keep or {}
    extra = F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in keep.items()])
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null first, then by the text's bytes
    leaves = docs.select(key.alias("g"), F.col(id_col).alias("id"), F.col(group_col).alias("group"), extra.alias("extra"), leaf(*[F.col(c) for c in cols]).alias("node"))
    rows = numbered(leaves, ["id", "node"])
    lower = reduced(rows.select("g", "idx", "n", "node"))
    subroots = lower[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), "node")
    upper = reduced(cut(numbered(subroots, ["of"])))
    root = upper[-1].select(F.col("node").alias("root"))
    nothing = [F.array().cast("array<int>").alias("at"), F.array().cast("array<string>").alias("others"), F.lit(None).cast("string").alias("subroot")]
    tops = upper[-1].select("*", *nothing)
    for nodes in reversed(upper[:-1]):
        tops = cut(descend(nodes, tops))
    above = tops.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("idx"), "at", "others", F.col("node").alias("subroot"))
    for nodes in reversed(lower[1:-1]):
        above = cut(descend(nodes, above))
    out = descend(rows, above) if len(lower) > 1 else rows.join(above.drop("idx"), "g")  # each row a group of its own
    out = out.crossJoin(F.broadcast(root))  # one row
    return out.select(F.col("id").alias(id_col), F.col("group").alias(group_col), *[F.col(f"extra.{k}").alias(k) for k in keep], F.col("node").alias("leaf"), "subroot", "root", "at", "others")


def verify(node: Column, at: Column, others: Column) -> Column:
    """The root that a leaf and its proof lead to: at each level the node goes to its place among its siblings, and their digest is the next node."""
    step = lambda x, s: digest(F.concat(F.substring(s["others"], F.lit(1), s["at"] * WIDTH), x, F.substring(s["others"], s["at"] * WIDTH + 1, F.length(s["others"]))))
    return F.aggregate(F.arrays_zip(at.alias("at"), others.alias("others")), node, step)

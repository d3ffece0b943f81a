"""Walks over typed edges: what a node reaches, in how many steps, and by which path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.tables import cut

#: Of a node's walks and of its edges, those that meet in one group: a group gives at most their product.
WALKS, EDGES = 1000, 2000


def known(edges: DataFrame) -> DataFrame:
    return cut(edges.select("src", "relation", "dst").where("src is not null and dst is not null").distinct())


def begun(starts: DataFrame) -> DataFrame:
    node = F.col("node")
    return starts.where("node is not null").select("node").distinct().select(node.alias("start"), "node", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("relation"), F.array("node").alias("path"))


def step(front: DataFrame, edges: DataFrame, hop: int) -> DataFrame:
    """The walks of front, one edge longer. A node's walks and its edges meet in groups of bounded size, as many tasks as what comes out asks for, so a node of very many edges is no task of its own."""
    asked, held = front.groupBy("node").agg(F.count("*").alias("n")), edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("m"))
    met = cut(asked.join(held, "node"))
    tasks = -(-(met.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0) // (WALKS * EDGES)) or 1
    many = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    size = met.select("node", many("n", WALKS).alias("parts"), many("m", EDGES).alias("blocks"))

    def deal(df: DataFrame, key: list[str], at: str, n: str, of: str, m: str) -> DataFrame:
        dealt = df.join(size, "node").withColumn(at, F.pmod(F.xxhash64(*key), F.col(n)).cast("int")).withColumn(of, F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
        return dealt.drop("parts", "blocks").repartition(tasks, "node", "part", "block")

    long = deal(front.select("start", "node", "path"), ["start", "path"], "part", "parts", "block", "blocks")
    on = deal(edges.select(F.col("src").alias("node"), F.col("relation").alias("by"), "dst"), ["by", "dst"], "block", "blocks", "part", "parts")
    both = long.join(on.hint("merge"), ["node", "part", "block"]).where(~F.array_contains("path", F.col("dst")))
    return both.select("start", F.col("dst").alias("node"), F.lit(hop).alias("hop"), F.col("by").alias("relation"), F.array_append("path", F.col("dst")).alias("path"))


def walks(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, hop, relation, path) from starts (node) along edges (src, relation, dst): every path of at most `depth` steps that visits no node twice, its last step's relation, and its nodes from the start on. Parallel edges of one relation count once; a start is its own walk of no step.

    Walks of each number of steps but the last are checkpointed; the last, which can be far more, go straight to whoever reads them.
    """
    edges, front = known(edges), begun(starts)
    out = front = cut(front)
    for hop in range(1, depth + 1):
        front = step(front, edges, hop)
        if hop < depth:
            front = cut(front)
        out = out.union(front)
    return out


def nearest(found: DataFrame) -> DataFrame:
    """(start, node, hop, path): of walks the shortest to each node, of equal ones the path of smaller names."""
    best = found.groupBy("start", "node").agg(F.min(F.struct("hop", "path")).alias("b"))
    return best.select("start", "node", "b.hop", "b.path")


def shortest(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """nearest() of walks() without the other walks: of those of one more step, only the first path to each node not reached before goes on.

    A shortest walk's beginning is a shortest walk too, and of walks of one length the path of smaller names begins with the path of smaller names.
    """
    edges, front = known(edges), begun(starts)
    out = front = cut(front)
    for hop in range(1, depth + 1):
        longer = step(front, edges, hop).groupBy("start", "node", "hop").agg(F.min("path").alias("path"))
        front = cut(longer.join(out.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", "hop", "path"))
        out = out.select("start", "node", "hop", "path").union(front)
    return out.select("start", "node", "hop", "path")

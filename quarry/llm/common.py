"""What the operators of this subpackage share: words, batches, checkpoints and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import math
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: White space between words: space and the five controls U+0009 to U+000D. bytes.split() cuts at exactly these.
SPACE = r"[\x20\x09-\x0D]+"


#: Folders of sessions that name none.
_OWN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: Tables whose rows take long to work on.
SPREAD = ("documents", "conversations", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows. A small file of one row group is one partition however the session splits files; such a table is dealt out, which changes its plan and no result."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in SPREAD and df.rdd.getNumPartitions() < cores else df


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task keeps none of what the last one took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(fn: Callable) -> Callable:
    """fn, followed by release() where a group was of some size."""

    def run(*groups: pd.DataFrame | pa.Table) -> pd.DataFrame | pa.Table:
        out = fn(*groups)
        if sum(g.nbytes if isinstance(g, pa.Table) else 8 * g.size for g in groups) > 1 << 19:
            release()
        return out

    return (lambda a: run(a)) if len(inspect.signature(fn).parameters) == 1 else lambda a, b: run(a, b)


def slices(batch: pa.RecordBatch, rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows and, unless a single row is larger, `size` bytes of text."""
    own = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    ends = np.cumsum(sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype("i8") for c in own), np.zeros(batch.num_rows, "i8")))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, upto - at)
        at = upto


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, rows: int = 500) -> DataFrame:
    """mapInArrow with columns as Python lists, at most `rows` rows and some MB at a time, so that a batch of long texts stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows):
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
        release()

    arrow = arrow_schema(schema)
    return df.mapInArrow(run, schema)


def arrow_schema(schema: str | StructType) -> pa.Schema:
    """Of a schema or its DDL, as tasks give it back."""
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def utf8(col: str) -> F.Column:
    """Text as UTF-8 bytes, null as the empty text."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def shared(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints. Where it names none, as in tests, a new folder of this machine, but only if Spark runs on this machine alone; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark not in _OWN:
        _OWN[spark] = tempfile.mkdtemp(prefix="checkpoints")
    return _OWN[spark]


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the folder that the session names. Spark removes checkpoints no longer referenced if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


def few(df: DataFrame, rows: int, each: int = 20_000) -> DataFrame:
    """df in no more tasks than `rows` rows ask for, nor in fewer than there are cores: a task of a few rows leaves as many files in a shuffle as a full one."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / each)))


def counted(df: DataFrame, each: int = 20_000) -> tuple[DataFrame, int]:
    """cut(df), to be read in as many tasks as its rows ask for, and its rows."""
    out = cut(df)
    rows = few(out, 0).count()
    return few(out, rows, each), rows


def listed(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df, broadcast if its rows are `most` or fewer, so that what it is joined with stays where it lies."""
    return F.broadcast(df) if rows <= most else df


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that the session names for checkpoints; whoever asks for it removes what it wrote there."""
    return f"{shared(spark)}/{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(big: DataFrame, small: DataFrame, on: list[str], n: str, rows: int | None = None, fan: int = 20_000, most: int = 500_000) -> DataFrame:
    """big.join(small, on), where a key may have any share of big's rows; small has one row a key, and its column n says how many rows of big have it.

    Rows of a key with over `fan` are dealt among as many tasks as that asks for, and small's row goes to each of these. The list of such
    keys is broadcast only if it has `most` or fewer, else joined. Without any it is a plain join; if big is known to have `rows` rows, and
    these are no more than `fan`, that needs no count.
    """
    plain = big.join(small.drop(n), on)
    if rows is not None and rows <= fan:
        return plain
    parts = F.ceil(F.col(n) / fan).cast("int")
    often = small.where(F.col(n) > fan).select(*on, parts.alias("_parts"))
    keys = often.count()
    if not keys:
        return plain
    dealt = big.join(F.broadcast(often) if keys <= most else often, on, "left")
    part = F.pmod(F.xxhash64(*big.columns, F.monotonically_increasing_id()), F.coalesce("_parts", F.lit(1))).cast("int")
    each = small.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(n)
    return dealt.withColumn("_part", part).drop("_parts").join(each, [*on, "_part"]).drop("_part")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a long, b long); component is the smallest node reachable.

    Large-star and small-star rounds: each node's smallest neighbour comes from a groupBy that combines map-side, and goes back over a
    join that deals the edges of a node with very many neighbours among tasks. Each round is checkpointed, and has as many tasks as its
    edges ask for. Empty edges: no rows.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    state = lambda e: few(e, 0).agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        rows = before[0]
        edges = few(edges, rows)
        # large-star: neighbours larger than a node go to the smallest node around it
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = few(spread_join(both, low, ["a"], "n", 2 * rows).where("b > a").select(F.col("m").alias("a"), "b").where("a <> b"), rows)
        large = few(large.distinct(), rows)
        # small-star: neighbours not larger than a node, and the node, go to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        small = few(spread_join(large, low, ["b"], "n", rows), rows)  # no more than there were
        edges = cut(small.select(F.col("m").alias("a"), "b").union(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    edges = few(edges, before[0])
    return edges.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component").union(edges.select("a", "a").distinct())


def filter_rows(df: DataFrame, fn: Callable[[dict[str, list]], list[bool]], cols: list[str], rows: int = 500) -> DataFrame:
    """Rows of df for which fn says true; fn sees the named columns as lists. Other columns pass as they are, whatever their names and types."""
    at = [df.columns.index(c) for c in cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows):
                yield part.filter(pa.array(fn({c: part.column(i).to_pylist() for c, i in zip(cols, at, strict=True)}), pa.bool_()))
        release()

    return df.mapInArrow(run, df.schema)


def labelled(labels: DataFrame, column: str, each: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, y): at most `each` ids of each label, those of the smallest hash, so the sample is the same in each run. Null labels don't count; of several labels the largest does."""
    one = labels.where(F.col(column).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("y"))
    part = lambda y: one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
    return part(0).union(part(1))


def one_each(sample: DataFrame, cols: list[str], key: str = "doc_id") -> DataFrame:
    """One row of each id, of repeated ones that whose columns have the smallest hash, so that a sample of ids is no larger than said. Combines map-side."""
    low = F.min(F.struct(F.xxhash64(*cols), *cols)).alias("low")
    return sample.groupBy(key).agg(low).select(key, *[F.col(f"low.{c}").alias(c) for c in cols])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out

"""Exact inner-product search by MaxScore over shards.

Components are the terms of a vector, its value the weight of the posting. Within a shard a term's postings have a largest and a smallest
value, so a query's component has an upper bound of what it can add to any score. Terms stand in order of these bounds; those at the
end whose bounds together stay under the k-th best score so far are non-essential: a document that gets nothing from the others can't
reach it. Essential terms' postings are traversed in full; the others are probed one by one for documents that are still competitive,
that is, whose score so far and the bounds of what is left reach the k-th best. Shards' lists are merged by score and id.

Every query meets every shard in one group, in blocks: a group has a shard's rows and a block's queries, both of a bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import arrow_schema, lean

#: Rows of a shard that are scored together; after each such step the k-th best scores rise.
STEP = 1024
LONGEST = np.iinfo("i8").max


def finite(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of rows that have an id and a vector of numbers alone: no null, no NaN, no infinity."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(vec_col, number)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))


def matrix(lists: pa.ChunkedArray, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) of each component; what a shorter vector lacks is 0."""
    flat = lists.combine_chunks()
    n = pc.list_value_length(flat).to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), dims))
    out[np.arange(dims) < n[:, None]] = np.floor(flat.flatten().to_numpy(zero_copy_only=False).astype("f8") * scale)
    return out


def best(at: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query (at) the k of highest score, ties to the smaller id."""
    order = np.lexsort((ident, -score, at))
    at, score, ident = at[order], score[order], ident[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], score[keep], ident[keep]


def shard_hits(ids: np.ndarray, v: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, probed: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, score, id) of each query's k best rows of the shard with another id than its own. probed gets the number of postings read."""
    wide = np.longdouble if np.abs(v).max(initial=0) * np.abs(q).max(initial=0) * max(1, v.shape[1]) >= 2**53 else np.float64  # sums are whole numbers in either
    v, q = v.astype(wide), q.astype(wide)
    order = np.argsort(-(v * v).sum(axis=1), kind="stable")  # long vectors first: the k-th best rises early
    v, ids = v[order], ids[order]
    bounds = np.maximum(q * v.max(axis=0), q * v.min(axis=0))
    terms = np.argsort(-bounds, axis=1, kind="stable")
    rest = np.zeros((len(q), v.shape[1] + 1), wide)  # rest[:, j]: what terms j and later can add
    rest[:, :-1] = np.cumsum(np.take_along_axis(bounds, terms, 1)[:, ::-1], axis=1)[:, ::-1]
    weights, rows = np.take_along_axis(q, terms, 1), np.arange(len(q))
    top = (np.zeros(0, "i8"), np.zeros(0, wide), np.zeros(0, ids.dtype))
    least = np.full(len(q), -np.inf, wide)
    for start in range(0, len(v), STEP):
        part, own = v[start : start + STEP], ids[start : start + STEP]
        needed = (rest >= least[:, None]).sum(axis=1).clip(max=v.shape[1])  # all terms until there are k hits
        essential = np.zeros_like(q)
        np.put_along_axis(essential, terms, np.where(np.arange(v.shape[1]) < needed[:, None], weights, 0), 1)
        score = part @ essential.T
        score[own[:, None] == qids] = -np.inf
        if not start and len(part) > k:
            least = np.partition(score, len(part) - k, axis=0)[len(part) - k]  # of whole scores
        doc, at = np.nonzero((score + rest[rows, needed] >= least) & ~np.isneginf(score))
        score, j = score[doc, at], needed[at]
        if probed is not None:
            probed.append(int(needed.sum()) * len(part))
        while len(more := np.nonzero(j < v.shape[1])[0]):
            if probed is not None:
                probed.append(len(more))
            a, d = at[more], doc[more]
            score[more] += weights[a, j[more]] * part[d, terms[a, j[more]]]
            j[more] += 1
            alive = score + rest[at, j] >= least[at]
            doc, at, score, j = doc[alive], at[alive], score[alive], j[alive]
        top = best(np.concatenate([top[0], at]), np.concatenate([top[1], score]), np.concatenate([top[2], own[doc]]), k)
        full = np.nonzero(np.arange(len(top[0])) - np.searchsorted(top[0], top[0]) == k - 1)[0]
        least[top[0][full]] = top[1][full]
    return top


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0, shard: int = 8192, block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of vectors with the largest inner product of floor(scale * x), all if there are fewer.

    Both tables have id_col (long) and vec_col (array of numbers). A query's own row, that with its id, isn't one of its hits; ties go to
    the smaller id. Rows without an id, and vectors that are null or hold null, NaN or infinity, take no part; components that a shorter
    vector lacks count as 0; repeated rows are hits as often as they stand, repeated queries ask once. Sums up to 2^63 are exact, larger
    ones are cut to that. Other columns are not read. An empty table of either kind gives no rows.
    """
    vectors, queries = finite(vectors, id_col, vec_col), finite(queries, id_col, vec_col).distinct()
    size = lambda df: df.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    (n, dims), (asked, more) = size(vectors), size(queries)
    shards, blocks, dims = max(1, -(-n // shard)), max(1, -(-asked // block)), max(1, dims, more)
    part = lambda of, *by: F.pmod(F.xxhash64("id", "v", *by), F.lit(of)).cast("int")
    each = lambda upto: F.explode(F.sequence(F.lit(0), F.lit(upto - 1)))
    held = vectors.select("id", "v", part(shards, F.monotonically_increasing_id()).alias("shard")).withColumn("block", each(blocks))
    asks = queries.select("id", "v", part(blocks).alias("block")).withColumn("shard", each(shards))
    schema = "query_id long, vec_id long, score long"
    arrow = arrow_schema(schema)

    def hits(docs: pa.Table, qs: pa.Table) -> pa.Table:
        if not len(docs) or not len(qs):
            return arrow.empty_table()
        ids, qids = docs["id"].to_numpy(), qs["id"].to_numpy()
        at, score, ident = shard_hits(ids, matrix(docs["v"], dims, scale), qids, matrix(qs["v"], dims, scale), k)
        whole = np.array([int(min(max(x, -LONGEST), LONGEST)) for x in score], "i8") if score.dtype == np.longdouble else score.astype("i8")
        return pa.table([qids[at], ident, whole], schema=arrow)

    found = held.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInArrow(lean(hits), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""SimHash near-deduplication with vantage-point trees.

Documents get 64-bit fingerprints; equal ones are one point from then on. Two points at 3 or fewer bits differ by at most one bit in
their upper or in their lower half, so each half has a forest of its own with a search radius of 1. A forest's upper levels are
vantage points that all nodes of a level share: points within about the median Hamming distance of it (measured on all points) go in, the
others out, and those beyond by no more than the radius (the triangle bound) are copied in, so that each close pair meets in at least
one shard. The distance is the median or one less, whichever leaves the two sides, copies included, more even. The depth follows the
number of points. Shards that stay too large, and these alone, are split again by their own medians; those
that still are, as their points are close to each other, are dealt in blocks, and each pair of blocks is a shard. In a shard, points are
ordered by their distance to one more vantage point over all 64 bits, and only those whose distances differ by at most 3 are
compared. A shard gives each point of its classes one link, never all pairs; connected components join the links of all shards.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import components, counted, cut, few, lean, listed, map_rows, spread_join, utf8

BITS, RADIUS = 64, 3
#: Points of a shard aimed at, and above which it is split again.
SHARD, LARGE = 1000, 3000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority of the bits of the XXH64 (seed 42) of each shingle; 0 without words. Signed, as Spark's long."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return majority(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))))


def majority(digests: bytes) -> int:
    """The fingerprint of the joined digests of a text's shingles; 0 without any."""
    flat = np.frombuffer(digests, "u1").reshape(-1, 8)
    ones = np.zeros(BITS, "i8")
    for at in range(0, len(flat), 65_536):
        ones += np.unpackbits(flat[at : at + 65_536], axis=1).sum(axis=0, dtype="i4")
    return int(np.packbits(2 * ones > len(flat)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, point (the fingerprint as a signed long). Null text: 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    return map_rows(rows, lambda x: {"doc_id": x["doc_id"], "point": [fingerprint(t, shingle) for t in x["text"]]}, "doc_id long, point long")


def vantage(level: int, half: int) -> int:
    return xxhash.xxh32_intdigest(f"vantage {level} {half}".encode())


def half_of(half: int) -> Column:
    return F.expr(f"shiftrightunsigned(point, {32 * half}) & 4294967295L")


def distance(level: int, half: int) -> Column:
    return F.bit_count(half_of(half).bitwiseXOR(F.lit(vantage(level, half)).cast("long")))


def medians(points: DataFrame, depth: int) -> list[list[int]]:
    """Of each half and level the distance from its vantage point within which points go in: the median of all points, or one less. Two passes that combine map-side."""
    if not depth:
        return [[], []]
    each = [(half, level) for half in range(2) for level in range(depth)]
    row = points.agg(*[F.percentile_approx(distance(level, half), 0.5, 1000).alias(f"m{half}_{level}") for half, level in each]).first()
    m = {at: 16 if row[f"m{at[0]}_{at[1]}"] is None else int(row[f"m{at[0]}_{at[1]}"]) for at in each}
    upto = points.agg(F.count("*").alias("n"), *[F.count_if(distance(level, half) <= m[half, level] + k).alias(f"c{half}_{level}_{k + 1}") for half, level in each for k in (-1, 0, 1)]).first()
    return [[m[half, level] - evener(upto["n"], *(upto[f"c{half}_{level}_{k}"] for k in range(3))) for level in range(depth)] for half in range(2)]


def evener(n: int, below: int, within: int, beyond: int) -> bool:
    """Whether a cut at one less than the median leaves less to compare than one at it, by the squares of both sides' points; those one beyond a cut are on both sides. below, within, beyond: points up to one less than the median, it, and one more."""
    return within**2 + (n - below) ** 2 < beyond**2 + (n - within) ** 2


def paths(half: int, cuts: list[int]) -> Column:
    """The shards of a point: at each level in (bit 0), out (1) or, just beyond the median, both."""
    if not cuts:
        return F.array(F.lit(0).cast("long"))
    side = F.array(*[F.when(distance(level, half) <= m, 0).when(distance(level, half) > m + 1, 1).otherwise(2) for level, m in enumerate(cuts)])

    def step(acc: Column, d: Column) -> Column:
        return F.when(d == 0, F.transform(acc, lambda c: c * 2)).when(d == 1, F.transform(acc, lambda c: c * 2 + 1)).otherwise(F.concat(F.transform(acc, lambda c: c * 2), F.transform(acc, lambda c: c * 2 + 1)))

    return F.aggregate(side, F.array(F.lit(0).cast("long")), step)


def shards(points: DataFrame, n: int, shard: int = SHARD, large: int = LARGE, rounds: int = 2, most: int = 500_000) -> DataFrame:
    """(shard, point): each pair of points at RADIUS or less shares a shard."""
    depth = max(0, math.ceil(math.log(max(1, n / shard)) / 0.565))
    cuts = medians(points, depth)
    out = points.select("point", F.explode(paths(0, cuts[0])).alias("path")).withColumn("half", F.lit(0))
    out = out.union(points.select("point", F.explode(paths(1, cuts[1])).alias("path"), F.lit(1).alias("half")))
    out, rows = counted(out.select(F.xxhash64("half", "path").alias("shard"), "half", "point"))
    done = []
    for level in range(depth, depth + rounds):
        over, n = counted(out.groupBy("shard", "half").agg(F.count("*").alias("n")).where(F.col("n") > large).select("shard"))
        if not n:
            break
        d = F.when(F.col("half") == 0, distance(level, 0)).otherwise(distance(level, 1))
        far = out.join(listed(over, n, most), "shard").withColumn("d", d)
        median, _ = counted(far.groupBy("shard").agg(F.percentile_approx("d", 0.5, 1000).alias("m")))
        side = F.when(F.col("d") <= F.col("m"), F.array(F.lit(0))).when(F.col("d") > F.col("m") + 1, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
        split = far.join(listed(median, n, most), "shard").select("shard", "half", "point", F.explode(side).alias("side"))
        split = split.select(F.xxhash64("shard", "side", F.lit(level)).alias("shard"), "half", "point")
        done.append(out.join(listed(over, n, most), "shard", "left_anti").select("shard", "point"))
        out, rows = counted(few(split, 2 * rows))
    else:
        out = blocks(out, large, most)
    return reduce(DataFrame.union, done, out.select("shard", "point"))


def blocks(sharded: DataFrame, large: int, most: int = 500_000) -> DataFrame:
    """(shard, point): shards of over `large` points as pairs of blocks of about half that; each pair of points still meets, no task has many more than `large`."""
    dense, n = counted(sharded.groupBy("shard").agg(F.ceil(F.count("*") * 2 / large).cast("int").alias("k")).where("k > 2"))
    if not n:
        return sharded.select("shard", "point")
    k, block = F.col("k"), F.pmod(F.xxhash64("point"), F.col("k")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.xxhash64("shard", F.least(block, j), F.greatest(block, j)))
    pairs = F.array_remove(pairs, F.xxhash64("shard", block, block))  # a block meets itself in each of its pairs
    many = sharded.join(listed(dense, n, most), "shard").select(F.explode(pairs).alias("shard"), "point")
    return sharded.join(listed(dense, n, most), "shard", "left_anti").select("shard", "point").union(many)


def shard_links(points: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): for each point b that has another within RADIUS, the point a of its class in this shard that is nearest to the vantage point."""
    points = np.unique(points)
    code = points.view("u8")
    far = np.bitwise_count(code ^ code[:1]) if len(code) else np.zeros(0, "u1")
    order = np.argsort(far, kind="stable")
    points, code, far = points[order], code[order], far[order].astype("i8")
    linked = np.zeros(len(code), bool)
    for at in range(0, len(code), block):
        part = code[at : at + block]
        end = np.searchsorted(far, far[min(at + block, len(far)) - 1] + RADIUS, "right")  # the triangle bound
        for lo in range(at, end, 65_536):
            close = np.bitwise_count(part[:, None] ^ code[None, lo : min(end, lo + 65_536)]) <= RADIUS
            if lo == at:
                close[np.arange(len(part)), np.arange(len(part))] = False
            linked[at : at + len(part)] |= close.any(axis=1)
            linked[lo : lo + close.shape[1]] |= close.any(axis=0)
    points, code, far = points[linked], code[linked], far[linked]
    root, left = np.full(len(code), -1, "i8"), np.arange(len(code))
    while len(left):  # one class after the other; a point that is reached is not compared again
        edge, left = left[:1], left[1:]
        root[edge] = edge[0]
        source = edge[0]
        while len(edge) and len(left):
            now, edge = edge[:block], edge[block:]
            lo, hi = np.searchsorted(far[left], [far[now].min() - RADIUS, far[now].max() + RADIUS + 1])
            near = left[lo:hi]
            hit = (np.bitwise_count(code[now][:, None] ^ code[near][None, :]) <= RADIUS).any(axis=0)
            got = near[hit]
            root[got] = source
            left = np.concatenate([left[:lo], near[~hit], left[hi:]])
            edge = np.concatenate([edge, got])
    return points[root], points


def links(sharded: DataFrame) -> DataFrame:
    """(a, b) of every shard, each point once in each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = shard_links(pdf["point"].to_numpy("i8"))
        return pd.DataFrame({"a": a, "b": b})

    return sharded.groupBy("shard").applyInPandas(lean(run), "a long, b long").where("a <> b")


def near_groups(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id among documents reachable over links of 3 or fewer differing bits. Null and empty texts, and texts
    without words, have the fingerprint 0 and link as any other. A null id is never a component_id unless its class has no other. Repeated
    rows each give a row. Texts of any length are read whole, other columns are not. An empty table gives no rows.
    """
    prints, _ = counted(fingerprints(docs, shingle, id_col, text_col))
    points, n = counted(prints.groupBy("point").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))  # combines map-side: a point of very many documents is one row from each task
    classes = components(links(shards(points.select("point"), n)))
    rooted, _ = counted(points.join(classes, points["point"] == classes["node"], "left").select("point", "first", "rows", F.coalesce("component", "point").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = few(spread_join(rooted.select("point", "rows", "root"), lowest, ["root"], "n").select("point", "rows", "component_id"), n)
    return spread_join(prints, named, ["point"], "rows").select("doc_id", F.lpad(F.lower(F.hex("point")), 16, "0").alias("fingerprint"), "component_id")

"""Near copies by the share of their shingles: op5's fingerprints and MinHash bands propose pairs, the exact Jaccard similarity decides.

A text is the set of its shingles of five words. Equal sets are one point from then on. Points get op5's fingerprints over these shingles,
which its vantage-point forests link at 3 or fewer bits (simhash.py). Most pairs at 0.8 are further apart than that, so each point also has BANDS fingerprints of ROWS
independent minima each; two points of similarity s have one in common with probability 1 - (1 - s ** ROWS) ** BANDS, which is 0.9999 at
0.8 and more above. Points that share a fingerprint are a bucket. First the points of each bucket are compared with its smallest one;
in those that then still hold several classes, all are: a large bucket's sets go to one task, which links each class once and makes no
pairs, and small buckets give pairs across classes. Components are worked out after the first step and, if the second links any, once more. Only pairs whose sets are as similar as asked are linked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import components, counted, few, lean, listed, map_rows, spread_join, unused, utf8
from quarry.llm.simhash import blocks, links, majority, shards

BANDS, ROWS = 24, 5
#: Pairs of one point, and points of a bucket, that one task gets at most; points of a bucket that gives pairs.
FAN, LARGE, SMALL = 1000, 2000, 16
#: Rows of ids or pairs that are broadcast at most; sets of shingles that a task has about.
MOST, SETS = 200_000, 2000
SALT = np.array([xxhash.xxh64_intdigest(f"salt {k}".encode()) for k in range(BANDS * ROWS)], "u8")[:, None]
ODD = np.array([xxhash.xxh64_intdigest(f"odd {k}".encode()) | 1 for k in range(BANDS * ROWS)], "u8")[:, None]


def digests(text: bytes, words: int = 5) -> bytes:
    """The XXH64 (seed 42) of each run of `words` words, joined; of all words where they are fewer; none without words."""
    ws = text.lower().split()
    runs = map(b" ".join, zip(*(ws[i:] for i in range(words)), strict=False)) if len(ws) >= words else [b" ".join(ws)] if ws else []
    return b"".join(xxhash.xxh64_digest(r, 42) for r in runs)


def distinct(joined: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(joined, ">u8").astype("u8"))


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The distinct ones of digests(), sorted."""
    return distinct(digests(text, words))


def bands(hashes: np.ndarray) -> list[int]:
    """BANDS fingerprints, signed as Spark's long."""
    low = np.full(BANDS * ROWS, 2**64 - 1, "u8")
    for at in range(0, len(hashes), 1024):
        np.minimum(low, ((hashes[None, at : at + 1024] ^ SALT) * ODD).min(axis=1), out=low)
    return signed([xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)])


def signed(values: list[int]) -> list[int]:
    return np.array(values, "u8").view("i8").tolist()


def sketches(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, print, point, n, bands): op5's fingerprint, the hash of the set of shingles, its size and its minima's fingerprints."""

    def run(x: dict[str, list]) -> dict[str, list]:
        joined = [digests(t, words) for t in x["text"]]
        sets = [distinct(j) for j in joined]
        return {"doc_id": x["doc_id"], "print": [majority(j) for j in joined], "point": signed([xxhash.xxh64_intdigest(s.tobytes()) for s in sets]), "n": [len(s) for s in sets], "bands": [bands(s) for s in sets]}

    return map_rows(rows, run, "doc_id long, print long, point long, n long, bands array<long>")


def shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """(point, hashes)."""

    def run(x: dict[str, list]) -> dict[str, list]:
        sets = [shingles(t, words) for t in x["text"]]
        return {"point": signed([xxhash.xxh64_intdigest(s.tobytes()) for s in sets]), "hashes": [s.view("i8").tolist() for s in sets]}

    return map_rows(rows, run, "point long, hashes array<long>", 100)


def near_sizes(a: Column, b: Column, least: float) -> Column:
    """Sets whose sizes differ by more can't be as similar as that."""
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-9


def forest(points: DataFrame, least: float) -> DataFrame:
    """(a, b) of points (point, n, print) that op5's vantage-point forests link by their fingerprints, or that share one; of each fingerprint its smallest point meets the others."""
    first, n = counted(points.groupBy("print").agg(F.min(F.struct("point", "n")).alias("low"), F.count("*").alias("rows")))
    linked_, rows = counted(links(shards(first.select(F.col("print").alias("point")), n)))
    side = lambda c: first.select(F.col("print").alias(c), F.col("low").alias(f"low_{c}"))
    apart = few(few(linked_.join(side("a"), "a"), rows).join(side("b"), "b"), rows).select(F.col("low_a").alias("x"), F.col("low_b").alias("y"))
    equal = few(spread_join(points.select("print", "point", "n"), first.where("rows > 1"), ["print"], "rows"), n).where("point <> low.point").select(F.col("low").alias("x"), F.struct("point", "n").alias("y"))
    return apart.union(equal).where(near_sizes(F.col("x.n"), F.col("y.n"), least)).select(F.col("x.point").alias("a"), F.col("y.point").alias("b")).distinct()


def confirmed(pairs: DataFrame, rows: int, sets: DataFrame, least: float) -> DataFrame:
    """Those of `rows` pairs (a, b) whose sets have a Jaccard similarity of `least` or more. A point of very many pairs goes to many tasks."""
    fan, n = counted(pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("k")))
    left = sets.join(listed(fan, n, MOST), F.col("point") == F.col("a")).select("a", F.col("hashes").alias("x"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"))
    dealt = pairs.join(listed(fan, n, MOST), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("part"))
    right = few(sets.select(F.col("point").alias("b"), F.col("hashes").alias("y")).join(listed(dealt, rows, MOST), "b"), rows, SETS)
    both = right.join(few(left, rows, SETS), ["a", "part"])
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("n"))
    return both.where(F.col("common") >= least * (F.col("n") - F.col("common")) - 1e-9).select("a", "b")


def mixed(shared: DataFrame, n: int, classes: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, point, n, root, size) of buckets that hold several classes, of `n` rows, and their rows."""
    rooted = few(shared.join(classes, F.col("point") == F.col("node"), "left"), n).select("bucket", "point", "n", F.coalesce("component", "point").alias("root"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("one"), F.max("root").alias("other"), F.count("*").alias("size")).where("one <> other")
    return counted(rooted.join(several.select("bucket", "size"), "bucket"))


def crossing(rest: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of one bucket and different classes."""
    side = lambda c: rest.select("bucket", F.col("point").alias(c), F.col("n").alias(f"n_{c}"), F.col("root").alias(f"root_{c}"))
    return side("a").join(side("b"), "bucket").where("a < b and root_a <> root_b").where(near_sizes(F.col("n_a"), F.col("n_b"), least)).select("a", "b").distinct()


def set_links(points: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """(a, b): one link for each point that a class reaches, class by class; a point that is reached is not compared again."""
    sizes = np.array([len(s) for s in sets], "i8")
    codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    mark = np.zeros(max((int(c.max()) for c in codes if len(c)), default=0) + 1, bool)
    left, a, b = np.arange(len(points)), [], []
    while len(left):
        edge, left = [int(left[0])], left[1:]
        flat = None
        while edge and len(left):
            at = edge.pop()
            if flat is None:
                flat, ends = np.concatenate([codes[i] for i in left]), np.cumsum(sizes[left])
            mark[codes[at]] = True
            upto = np.concatenate([[0], np.cumsum(mark[flat])])
            common = upto[ends] - upto[ends - sizes[left]]
            mark[codes[at]] = False
            hit = common >= least * (sizes[at] + sizes[left] - common) - 1e-9
            if hit.any():
                got, left, flat = left[hit], left[~hit], None
                a += [int(points[at])] * len(got)
                b += points[got].tolist()
                edge += got.tolist()
    return a, b


def linked(rest: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b) of large buckets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = set_links(pdf["point"].to_numpy("i8"), [np.asarray(h, "i8") for h in pdf["hashes"]], least)
        return pd.DataFrame({"a": a, "b": b}, dtype="i8")

    dealt, rows = counted(blocks(rest.select(F.col("bucket").alias("shard"), "point"), LARGE))
    return few(sets.join(listed(dealt, rows, MOST), "point"), rows, SETS).groupBy("shard").applyInPandas(lean(run), "a long, b long").distinct()


def similar(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of each id: the smallest id among documents reachable over pairs of similarity `least` or more. Null texts are empty; texts without words are one class. Null ids have no row."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    prints, n_docs = counted(sketches(rows, words))
    points, n_points = counted(prints.groupBy("point").agg(F.min("doc_id").alias("first"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.min("print").alias("print"), F.count("*").alias("rows")))
    buckets = points.select("point", "n", F.explode("bands").alias("bucket"))
    low = buckets.groupBy("bucket").agg(F.min(F.struct("point", "n")).alias("low"), F.max("point").alias("high")).where("low.point <> high").select("bucket", "low")
    shared, n_shared = counted(buckets.join(low, "bucket"))
    close, _ = counted(forest(points, least))
    near_ = shared.select("point").union(close.select("a")).union(close.select("b")).distinct()
    wanted, n_wanted = counted(points.join(near_, "point", "left_semi").select(F.col("first").alias("doc_id")))
    sets, _ = counted(shingle_sets(rows.join(listed(wanted, n_wanted, MOST), "doc_id", "left_semi"), words), SETS)
    stars = shared.where("point <> low.point").where(near_sizes(F.col("n"), F.col("low.n"), least)).select(F.col("low.point").alias("a"), F.col("point").alias("b")).union(close)
    stars, n_stars = counted(stars.distinct())
    edges, _ = counted(confirmed(stars, n_stars, sets, least))
    classes, _ = counted(components(edges))
    rest, _ = mixed(shared, n_shared, classes)
    pairs, n_pairs = counted(crossing(rest.where(F.col("size") <= SMALL), least).join(stars, ["a", "b"], "left_anti"))
    more, n_more = counted(linked(rest.where(F.col("size") > SMALL), sets, least).union(confirmed(pairs, n_pairs, sets, least)))
    if n_more:
        classes, _ = counted(components(edges.union(more)))
    rooted, _ = counted(points.join(classes, points["point"] == classes["node"], "left").select("point", "first", "rows", F.coalesce("component", "point").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = few(spread_join(rooted.select("point", "rows", "root"), lowest, ["root"], "n").select("point", "rows", "component_id"), n_points)
    return few(spread_join(prints.select("doc_id", "point"), named, ["point"], "rows").select("doc_id", "component_id"), n_docs)


def drop_similar(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", most: int = 500_000) -> DataFrame:
    """docs with one document of each class, that of the smallest id. All columns stay.

    Null texts are empty, and texts without words are one class; rows with a null id stay and link nothing; rows that repeat an id go or
    stay together. A pair of similarity 0.8 is proposed with probability 0.9999 and more above; what is proposed is decided exactly. An
    empty table gives no rows. Dropped ids are broadcast only if there are `most` or fewer.
    """
    (name,) = unused(docs, "_near_id")
    gone, n = counted(similar(docs.select(id_col, text_col), words, least, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(listed(gone, n, most), F.col(id_col) == F.col(name), "left_anti")

"""Spelling variants, exact top-k and the Merkle manifest against brute force, SQL and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import maxscore, merkle, packing, queries, spelling

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_exact_top_k", "op13_merkle_manifest"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(queries.oracle_sql()[name]).project(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, want))
    assert want


# ---- spelling ---------------------------------------------------------------------------------------------------------------------


def brute_variants(docs):
    n = Counter()
    for ident, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, k in words.items():
        around = [v for v in words if v != w and near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        out[w] = [k, len(around), best if best and words[best] >= 2 * k else None]
    rows = set()
    for w, (k, m, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.add((w, k, m, form, out[form][0] if form else None, root))
    return rows


def test_spelling_brute(spark):
    rng = random.Random(1)
    base = ["receive", "Straße", "garçon", "garcon", "ÀÉÎÕÜ", "aaaaa", "letters", "lettre", "recieve", "x×yzab", "banana", "été", "code"]
    bend = lambda w: (lambda i: rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abeé") + w[i:], w[:i] + rng.choice("abeé") + w[i + 1 :]]))(rng.randrange(len(w)))
    pool = base + [bend(w) for w in base for _ in range(12)] + [bend(bend(w)) for w in base for _ in range(6)]
    docs = [(i, " ".join(rng.choices(pool, weights=[1 + 40 * (k < len(base)) for k in range(len(pool))], k=60)).replace(" b", "\nB")) for i in range(120)]
    docs += [(None, "Receive receive 12receive"), (500, None), (501, ""), (502, " \n"), (7, docs[7][1]), (503, "longword" * 20_000 + " " + "receive " * 5000)]
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, key int")
    got = {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(df).collect()}
    want = brute_variants(docs)
    assert got == want
    assert any(r[3] and r[5] != r[3] for r in want)  # a chain
    assert spelling.variants(df.limit(0)).count() == 0


def test_masks(spark):
    """One edit flips two bits at most, and one if it changes the length."""
    words = ["receive", "recéive", "receve", "reeceive", "deceive"]
    m = {r.word: r.m for r in spark.createDataFrame([(w,) for w in words], "word string").select("word", spelling.mask("word").alias("m")).collect()}
    flips = [bin(m["receive"] ^ m[w]).count("1") for w in words]
    assert flips[0] == 0
    assert flips[2:4] == [1, 1]
    assert all(f in (0, 2) for f in (flips[1], flips[4])) or flips[1] == 1


# ---- top-k ------------------------------------------------------------------------------------------------------------------------


def brute_top(rows, asks, k=10, scale=1024):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    whole = lambda v: [int(np.floor(float(x) * scale)) for x in v]
    out = set()
    for i, q in {(i, tuple(v)) for i, v in asks if i is not None and ok(v)}:
        hits = sorted((-max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(whole(q), whole(v), strict=False)))), j) for j, v in rows if j is not None and j != i and ok(v))
        out |= {(i, r, j, -s, c) for c, (r, (s, j)) in enumerate(enumerate(hits[:k], 1))}
    return {x[:4] for x in out}


def test_top_k_brute(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=12).astype("f4").tolist()) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2100, [1.0, None] + [0.0] * 10), (2200, [float("nan")] * 12), (2300, [float("inf")] * 12), (None, [9.0] * 12), (2400, []), (2500, [1.0, -2.0]), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, id int")
    asks = df.where("vec_id % 100 = 0")
    want = brute_top(rows, [r for r in rows if r[0] is not None and r[0] % 100 == 0])
    for size in (8192, 100):
        got = [(r.query_id, r.rank, r.vec_id, r.score) for r in maxscore.top_k(df, asks, shard=size, block=4).collect()]
        assert set(got) == want
        assert len(got) == len(want)
    assert maxscore.top_k(df.limit(0), asks).count() == 0
    assert maxscore.top_k(df, asks.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert maxscore.top_k(few, few.where("vec_id = 1")).count() == 3  # 0 stands twice


def test_top_k_wide_sums(spark):
    rows = [(0, [3e6, 1.0]), (1, [3e6, 1e-3]), (2, [3e6, 2e-3]), (3, [-4e6, 5.0]), (4, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in maxscore.top_k(df, df.where("vec_id = 0")).collect()}
    assert got == brute_top(rows, rows[:1])


def test_max_score_reads_less():
    """Documents that can't reach the k-th best are left early, and no hit is lost."""
    rng = np.random.default_rng(4)
    v, q = np.floor(rng.normal(size=(6000, 64)) * 100), np.floor(rng.normal(size=(20, 64)) * 100 * np.geomspace(1, 0.01, 64))
    probed = []
    at, score, ident = maxscore.shard_hits(np.arange(6000), v, np.full(20, -1), q, 10, probed)
    assert sum(probed) < 0.7 * v.size * len(q)
    full = v @ q.T
    for i in range(20):
        want = sorted((-full[:, i][j], j) for j in range(6000))[:10]
        assert [(-s, d) for s, d in zip(score[at == i], ident[at == i], strict=True)] == want


# ---- manifest ---------------------------------------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(nodes):
    """(root, proof of each node: for each level the place and the siblings)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            proofs[k].append((i % 8, [x for j, x in enumerate(run) if j != i % 8]))
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], proofs


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    of = {}
    for r in rows:
        of.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r[0]))
    langs = sorted(of, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in sorted(of[g])]) for g in langs}
    root, upper = tree([trees[g][0] for g in langs])
    out = Counter()
    for g, top in zip(langs, upper, strict=True):
        for x, own in zip(sorted(of[g]), trees[g][1], strict=True):
            out[(x[3], x[2], trees[g][0], root, sha(*(s for _, level in [*own, *top] for s in level)))] += 1
    return out


@pytest.mark.parametrize("n", [1, 8, 9, 5000])
def test_manifest_brute(spark, n):
    lang = lambda i: "en" if n == 1 else [None, "en", "", "é", "fr", "en", "en", "en", "en", "en"][i % 10]
    rows = [(i * 3 % n if n > 9 else i, f"s{i % 3}", lang(i), None if i % 7 == 0 else i, None if i % 11 == 0 else f"Text {i} é\n" * (i % 4)) for i in range(n)]
    if n == 9:
        rows += [(None, None, None, None, None), (2, "s", "en", 1, "x" * 300_000), (2, "s", "en", 1, "again"), rows[3], rows[3]]
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g string, node int")
    made = merkle.manifest(docs)
    folded = merkle.verify(F.col("leaf"), F.col("at"), F.col("others"))
    got = made.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("others", ""), 256).alias("proof"), (folded == F.col("root")).alias("ok")).collect()
    assert all(r.ok for r in got)
    assert Counter(tuple(r)[:5] for r in got) == brute_manifest(rows)
    if n == 9:
        other = merkle.verify(F.sha2(F.lit("other"), 256), F.col("at"), F.col("others"))
        assert made.where(other == F.col("root")).count() == 0
        assert merkle.manifest(docs.limit(0)).count() == 0


# ---- packing ----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "x\n \t" * 400_000])
def test_long_white_space(text):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.ids_of(text, path).tolist() == packing.library(path).encode(text, add_special_tokens=False).ids

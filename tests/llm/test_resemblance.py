"""The pipeline's near-duplicate stage against brute force."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from quarry.llm import resemblance, simhash


def edited(rng, words, n):
    """words with n of them replaced, spread out."""
    out, step = list(words), len(words) // n
    for k in range(n):
        out[k * step + rng.randrange(max(1, step - 5))] = f"new{rng.randrange(10**9)}"
    return out


def kept_brute(docs):
    """One id of each class of pairs with Jaccard >= 0.8 over five words."""
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common * 10 >= 8 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in sets if find(i) == i}


def test_near_stage_brute(spark):
    """Lightly edited copies, on both sides of 0.8, go and stay as brute force says; so do short and empty texts."""
    rng, docs = random.Random(5), []
    for base in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([100, 200, 400]))]
        docs.append(words)
        docs += [edited(rng, words, max(1, len(words) * n // 1000)) for n in (5, 12, 18, 22, 24, 30, 60)]
    docs += [["One", "two"], ["one", "TWO"], ["one", "three"], [], []]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    rng.shuffle(rows)
    got = corpus_pipeline.near(spark, spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(kept_brute(rows))
    assert sum(r.doc_id is None for r in got) == 1


@pytest.mark.parametrize("small", [1, 1000])
def test_bucket_of_several_classes(spark, monkeypatch, small):
    """Classes that meet in a bucket only beside its smallest point, in tasks of few points and pairs."""
    monkeypatch.setattr(resemblance, "FAN", 2)
    monkeypatch.setattr(resemblance, "LARGE", 16)
    monkeypatch.setattr(resemblance, "SMALL", small)
    rng, docs = random.Random(6), []
    head = [f"h{k}" for k in range(300)]
    for _ in range(12):
        words = head + [f"t{rng.randrange(10**6)}" for _ in range(120)]
        docs += [words, edited(rng, words, 4), edited(rng, words, 4)]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    assert {r.doc_id for r in resemblance.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == kept_brute(rows)


def test_components_run_no_more_often_than_links_ask(spark, monkeypatch):
    """Once where each bucket is one class, twice where its classes differ: each run is many shuffles."""
    runs, components = [], resemblance.components
    monkeypatch.setattr(resemblance, "components", lambda edges: runs.append(1) or components(edges))
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    rows = [(0, " ".join(words)), (1, " ".join(edited(rng, words, 2))), (2, "other words")]
    assert {r.doc_id for r in resemblance.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0, 2}
    assert len(runs) == 1


def test_fingerprints_propose_pairs(spark, monkeypatch):
    """Without any MinHash band in common, texts whose fingerprints differ in 1 to 3 bits, or are the same, are linked through the forests, if they are similar enough."""
    monkeypatch.setattr(resemblance, "bands", lambda hashes: [int(hashes.sum() >> 2)])
    rng, rows, apart = random.Random(9), [], []
    for base in range(8):
        words = [f"w{rng.randrange(9000)}" for _ in range(1500)]
        code = simhash.fingerprint(" ".join(words).encode(), 5)
        while (k := (code ^ simhash.fingerprint(" ".join(copy := edited(rng, words, 2)).encode(), 5)).bit_count()) > 3 or k == 0 and base < 4:
            pass
        rows += [(2 * base, " ".join(words)), (2 * base + 1, " ".join(copy))]
        apart.append(k)
    rows += [(90, "x " * 300 + "y"), (91, "x " * 300 + "z")]  # one fingerprint, other sets
    assert any(apart)
    got = {r.doc_id for r in resemblance.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {*range(0, 16, 2), 90, 91} == kept_brute(rows)


def test_shards_even(spark):
    """The two sides of a vantage point hold about as many points, those copied included, so no shard has to be split again for its place."""
    rng = random.Random(10)
    points = spark.createDataFrame([(rng.getrandbits(64) - 2**63,) for _ in range(20_000)], "point long")
    sizes = [r["count"] for r in simhash.shards(points, 20_000, 1000, 10**9).groupBy("shard").count().collect()]
    assert max(sizes) < 1800


def test_small_tables_take_few_tasks(spark):
    """A few hundred rows don't leave as many shuffle files as there are partitions, stage by stage."""
    rng, docs = random.Random(11), []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        docs += [words, edited(rng, words, 2), edited(rng, words, 3)]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    sc = spark.sparkContext
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few tasks", "")
        got = {r.doc_id for r in resemblance.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == kept_brute(rows)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few tasks") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    assert tasks < 4500

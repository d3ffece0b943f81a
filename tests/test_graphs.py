"""Tenants' views, walks, sketches and phrases against small cases and brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import phrases, security, sketches, walks
from quarry.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture
def secured(spark):
    return catalog.secured(spark, SF)


def test_tenants_see_disjoint_rows(secured):
    for t, key in catalog.KEYS.items():
        a, b = ({r[0] for r in secured.view(t, org).select(key).collect()} for org in (3, 7))
        assert not a & b
        assert {r[0] for r in secured.erased(7)[t].select(key).collect()} & b == set()


def test_every_plan_has_the_filter(spark, secured):
    secured.register(spark, 3, "mine_")
    for t in catalog.KEYS:
        plan = spark.table(f"mine_{t}")._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"nationkey#\d+L? = 3\)", plan), t
    assert spark.sql("SELECT count(*) FROM mine_orders o JOIN mine_lineitem l ON l_orderkey = o_orderkey").first()[0] == spark.table("mine_lineitem").count()


def test_policies(spark):
    t = {"a": spark.createDataFrame([(1, 1), (2, None), (3, 2)], "k int, org int"), "b": spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "a_k int, v string"), "c": spark.createDataFrame([(5,)], "x int")}
    s = security.Secured(t, [security.Policy("a", "org"), security.Policy("b", "a_k", "a", "k")], public=("c",))
    assert [r.v for r in s.view("b", 1).collect()] == ["x"]
    assert s.view("c", 1).count() == 1
    assert {r.v for r in s.erased(1)["b"].collect()} == {"y", "z"}
    assert s.erased(1)["a"].count() == 2
    with pytest.raises(PermissionError):
        security.Secured(t, [security.Policy("a", "org")]).view("b", 1)
    with pytest.raises(ValueError, match="no owner"):
        security.Secured(t, [security.Policy("b", "a_k", "a", "k")])


def test_walks(spark):
    edges = spark.createDataFrame([("a", "owns", "b"), ("a", "owns", "b"), ("b", "owns", "c"), ("c", "faces", "a"), ("a", "faces", "c"), (None, "owns", "a"), ("d", "owns", None)], "src string, relation string, dst string")
    got = {(r.start, r.hop, ">".join(r.path)) for r in walks.walks(edges, spark.createDataFrame([("a",), ("z",), (None,)], "node string"), 3).collect()}
    assert got == {("a", 0, "a"), ("z", 0, "z"), ("a", 1, "a>b"), ("a", 1, "a>c"), ("a", 2, "a>b>c")}
    near = {(r.node, r.hop) for r in walks.nearest(walks.walks(edges, spark.createDataFrame([("a",)], "node string"), 3)).collect()}
    assert near == {("a", 0), ("b", 1), ("c", 1)}


def test_sketches_keep_to_their_errors(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("event_type"), (F.col("id") % 20_000).alias("user_id"), (F.col("id") * 7919 % 60_000).cast("double").alias("value"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 20).alias("ts"))
    ranges = spark.createDataFrame([(1, "2023-01-01", "2024-12-31"), (2, "2023-11-16", "2023-11-18")], "rid int, first string, last string").select("rid", F.to_date("first").alias("first"), F.to_date("last").alias("last"))
    got = sketches.merged(sketches.daily(rows, "event_type", "user_id", "value"), ranges).collect()
    assert len(got) == 6
    for r in got:
        first, last = ("2023-01-01", "2024-12-31") if r.rid == 1 else ("2023-11-16", "2023-11-18")
        own = rows.where((F.col("event_type") == r.kind) & F.to_date("ts").between(first, last))
        n, ids, half, most = own.agg(F.count("*"), F.countDistinct("user_id"), F.avg((F.col("value") <= r.q_50).cast("int")), F.avg((F.col("value") <= r.q_90).cast("int"))).first()
        assert r.n == n
        assert abs(r.ids - ids) <= sketches.ERROR * ids
        assert abs(half - 0.5) <= sketches.RANK_ERROR
        assert abs(most - 0.9) <= sketches.RANK_ERROR


def test_phrases_brute(spark):
    rng = random.Random(5)
    said = lambda n: " ".join(rng.choices(["Net", "sales", "of", "the", "year,", "rose"], k=n))
    texts = [(i, said(rng.randint(0, 30))) for i in range(60)] + [(98, None), (99, "")]
    listed = sorted({said(rng.randint(1, 5)) for _ in range(200)})
    got = {(r.id, r.phrase, r["at"]) for r in phrases.hits(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p,) for p in [*listed, None, " ,"]], "phrase string")).collect()}
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    want = {(i, p, k) for i, t in texts if t for p in listed for k in range(len(words(t))) if words(t)[k : k + len(words(p))] == words(p)}
    assert got == want
    assert len(want) > 500


def test_question_without_vector(spark, tmp_path):
    from quarry.operators import ann, hybrid, segments

    docs = spark.createDataFrame([(1, "red lamp. it is red."), (2, "blue door"), (3, "red door"), (4, None)], "doc_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "vec_id long, embedding array<double>")
    index = segments.Index(spark, f"{tmp_path}/w")
    index.append(docs)
    ann.write_index(vectors, f"{tmp_path}/v", 2)
    q = spark.createDataFrame([(1, "red lamp", "red lamp", None), (2, "door", "door", [0.0, 1.0]), (3, "absent", "absent", None)], "qid long, question string, qtext string, qvec array<double>")
    hits = hybrid.retrieve(spark, f"{tmp_path}/v", index, q)
    got = {}
    for r in hits.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got[1] == [1, 3]
    assert got[2][:2] == [2, 3]
    assert set(got) == {1, 2}
    told = {r.qid: r.answer for r in hybrid.answers(hits, docs.withColumnRenamed("doc_id", "id"), q, spark.createDataFrame([(3, "A fact.")], "qid long, line string")).collect()}
    assert told == {1: "red lamp. [1] red door [2]", 2: told[2], 3: "A fact. [F]"}

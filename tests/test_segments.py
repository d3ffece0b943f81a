"""Segments, fields and as-of joins against hand-made cases."""

from __future__ import annotations

import math
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.operators import asof, fielded, search, segments

DOCS = [(1, "red lamp red"), (2, "blue lamp"), (3, "green door"), (4, None), (5, "red door lamp lamp")]


@pytest.fixture
def index(spark, tmp_path):
    x = segments.Index(spark, str(tmp_path))
    x.append(spark.createDataFrame(DOCS[:3], "doc_id long, text string"))
    x.append(spark.createDataFrame([*DOCS[3:], (None, "red")], "doc_id long, text string"))
    return x


def same(spark, index, docs):
    """The index ranks as the live documents do."""
    live = spark.createDataFrame(docs, "doc_id long, text string")
    asks = spark.createDataFrame([(1, "red lamp"), (2, "door absent")], "qid long, qtext string")
    got = {tuple(r) for r in search.ranked(index.read(asks), asks, 9).select("qid", "id", "score", "rank").collect()}
    assert got == {tuple(r) for r in search.bm25(live.na.fill("", ["text"]), asks, 9).select("qid", "id", "score", "rank").collect()}


def test_life(spark, index, tmp_path):
    same(spark, index, DOCS)
    index.delete(spark.createDataFrame([(1,), (4,), (77,)], "id long"))
    same(spark, index, [DOCS[1], DOCS[2], DOCS[4]])
    index.append(spark.createDataFrame([(1, "lamp back"), (2, "blue lamp again")], "doc_id long, text string"))  # 2 takes its own place
    live = [(1, "lamp back"), (2, "blue lamp again"), DOCS[2], DOCS[4]]
    same(spark, index, live)
    index.merge()
    same(spark, index, live)
    assert len(index.numbers()) == 1
    index.vacuum()
    same(spark, index, live)
    assert len(list((tmp_path / "postings").glob("seq=*"))) == 1
    index.delete(spark.createDataFrame([(3,)], "id long"))
    same(spark, index, [live[0], live[1], live[3]])


def test_half_written_segment_does_not_count(spark, index, tmp_path):
    seq = max(index.numbers()) + 1
    spark.createDataFrame([(9, "red", 1, 1, 0)], "id long, term string, tf long, dl int, slot int").write.partitionBy("slot").parquet(f"{tmp_path}/postings/seq={seq}")
    same(spark, index, DOCS)
    index.append(spark.createDataFrame([(6, "red")], "doc_id long, text string"))
    same(spark, index, [*DOCS, (6, "red")])


def test_reads_slots_asked_for(spark, index):
    asks = spark.createDataFrame([(1, "red")], "qid long, qtext string")
    plan = index.read(asks)["postings"]._jdf.queryExecution().toString()
    assert "slot" in plan.split("PartitionFilters:")[1].split("]")[0]
    files = {r.f for r in index._seen("postings").where(segments.slot(F.lit("red")) == F.col("slot")).select(F.input_file_name().alias("f")).collect()}
    assert files
    assert len(files) < len(list(Path(index.folder).glob("postings/*/*/*.parquet")))


def test_empty_index(spark, tmp_path):
    x = segments.Index(spark, str(tmp_path))
    asks = spark.createDataFrame([(1, "red")], "qid long, qtext string")
    assert search.ranked(x.read(asks), asks, 3).count() == 0
    x.delete(spark.createDataFrame([(1,)], "id long"))
    x.append(spark.createDataFrame([], "doc_id long, text string"))
    assert search.ranked(x.read(asks), asks, 3).count() == 0


def test_stems(spark):
    words = {"stories": "story", "classes": "class", "cars": "car", "bus": "bus", "glass": "glass", "walking": "walk", "sing": "sing", "walked": "walk", "agreed": "agreed"}
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", fielded.stem(F.col("w")).alias("s")).collect()}
    assert got == words


def test_bm25f_by_hand(spark):
    docs = spark.createDataFrame([(1, "lamp", "the red lamps"), (2, "door", "lamp of brass"), (3, None, "door")], "doc_id long, title string, text string")
    asks = spark.createDataFrame([(1, "A lamp"), (2, None)], "qid long, qtext string")
    got = {r.id: r.score for r in fielded.bm25f(docs, asks, {"title": 3.0, "text": 1.0}, 5).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    title, text = 2 / 3, 5 / 3  # mean sizes: one, one and none; two, two and one
    w = {1: 3 / (0.25 + 0.75 / title) + 1 / (0.25 + 0.75 * 2 / text), 2: 1 / (0.25 + 0.75 * 2 / text)}
    assert got == {i: pytest.approx(idf * x * 2.2 / (x + 1.2), abs=1e-6) for i, x in w.items()}


def test_as_of(spark):
    day = date.fromisoformat
    known = spark.createDataFrame([("a", day("2020-01-05"), 1), ("a", day("2020-03-01"), 2), ("a", day("2022-02-01"), 3), ("b", day("2021-01-01"), 9), ("a", None, 7), (None, day("2020-01-01"), 8)], "k string, t date, v int")
    asks = [("a", "2020-01-04", None), ("a", "2020-01-05", 1), ("a", "2020-12-31", 2), ("a", "2021-06-01", 2), ("a", "2022-01-31", 2), ("a", "2023-01-01", 3), ("b", "2020-12-31", None), ("c", "2023-01-01", None), (None, "2023-01-01", None), ("a", None, None), ("a", "2021-06-01", 2)]
    df = spark.createDataFrame([(k, None if t is None else day(t), i) for i, (k, t, _) in enumerate(asks)], "k string, t date, i int")
    for period in (None, F.date_trunc("month", "t"), F.lit(1)):
        got = {r.i: r.v for r in asof.as_of(df, known, ["k"], "t", ["v"], period).collect()}
        assert got == {i: v for i, (_, _, v) in enumerate(asks)}
    bare = asof.as_of(df.select("k", "t"), known, ["k"], "t", ["v"])
    assert bare.columns == ["k", "t", "v"]
    assert bare.count() == len(asks)

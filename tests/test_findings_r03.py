"""Odd inputs and larger tables of the third round's findings."""

from __future__ import annotations

import json
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import ann, extract, phrases, search, segments, walks
from quarry.sources import companyfacts


def test_numbers_round_as_printf_does(spark):
    v = [0.25, 0.35, 412.15, -33.65, 14.85, 2.5, -0.04, 1234.56, None]
    got = spark.createDataFrame([(x,) for x in v], "v double").select(T.fixed(F.col("v"), 1).alias("f"), extract.compact(F.col("v")).alias("c")).collect()
    assert [r.f for r in got] == [None if x is None else f"{x:.1f}" for x in v]
    assert [r.c for r in got] == ["0.2", "0.3", "412.1", "-33.6", "14.8", "2.5", "-0.0", "1.2K", None]


def test_a_figure_without_words_is_its_own_label(spark):
    found = extract.charts(extract.findings(spark.createDataFrame([(1, "$12 million a year, $5bn")], "id long, text string")))
    assert {(r.label, r.value) for r in found.collect()} == {("$12 million", 12e6), ("$12 million a year,", 5e9)}


def test_findings_on_odd_blanks(spark):
    found = extract.findings(spark.createDataFrame([(1, "  12%"), (2, "a\x0b12\x0bmillion 3.5"), (3, "5 thouſand")], "id long, text string")).collect()
    assert {(r.id, r.figure, r.label) for r in found} == {(1, "12%", ""), (2, "3.5", "a\x0b12\x0bmillion"), (3, "5 thouſand", "")}


def test_every_subsidiary_of_a_long_list(spark):
    text = "\n".join(f"Company {i} LLC   Delaware" for i in range(450))
    assert extract.subsidiaries(spark.createDataFrame([(1, text)], "id long, text string"), None).count() == 450


def test_best_over_shards_and_blocks(spark):
    """Sums over many shards and blocks of questions as over one, with ties, zero and negative weights."""
    rng = random.Random(3)
    post = [(d, f"t{t}", rng.choice([0.5, 1.0, 2.0])) for d in range(700) for t in rng.sample(range(90), 9)]
    terms = [(q, f"t{t}", rng.choice([0.0, -0.5, 1.0, 1.0, 2.0])) for q in range(40) for t in rng.sample(range(100), 6)]
    sums: dict = {}
    by: dict = {}
    for d, t, v in post:
        by.setdefault(t, []).append((d, v))
    for q, t, w in terms:
        for d, v in by.get(t, []):
            sums.setdefault(q, {})[d] = sums.get(q, {}).get(d, 0.0) + w * v
    want = {(q, d, r + 1) for q, s in sums.items() for r, (d, _) in enumerate(sorted(s.items(), key=lambda x: (-round(x[1], 6), x[0]))[:7])}
    p, t = spark.createDataFrame(post, "id long, term string, v double"), spark.createDataFrame(terms, "qid long, term string, w double")
    got = search.best(p, t, 7, 700, 40, shard=100, block=11)
    assert {(r.qid, r.id, r["rank"]) for r in got.collect()} == want
    # pairs don't leave the groups: what is shuffled after them is at most k rows for each question and shard
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()


def test_postings_of_a_slot_are_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "DOCUMENTS", 20)
    docs = spark.createDataFrame([(i, f"the word w{i % 7}") for i in range(100)] + [(100, None)], "doc_id long, text string")
    index = segments.Index(spark, str(tmp_path))
    index.append(docs)
    files = [f for f in spark.read.parquet(f"{tmp_path}/postings").inputFiles()]
    assert len(files) > spark.read.parquet(f"{tmp_path}/postings").select("slot").distinct().count()
    built = index.read()
    assert built["total"].first()["n"] == 101 and built["postings"].count() == 300
    assert {r.term: r.df for r in built["terms"].collect()}["the"] == 100


def test_cells_dealt_among_tasks(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 10)
    monkeypatch.setattr(ann, "ASKS", 3)
    rng = random.Random(5)
    unit = lambda: [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)]
    v, u = [(i, unit(), i % 2) for i in range(60)], [(q, unit(), c) for q in range(8) for c in (0, 1)]
    got = ann.scored(spark.createDataFrame(v, "id long, v array<double>, cell int"), spark.createDataFrame(u, "qid long, u array<double>, cell int"), spark.createDataFrame([(0, 30), (1, 30)], "cell int, n long"), 4)
    want = set()
    for q in range(8):
        s = sorted(((-round(sum(a * b for a, b in zip(x, y, strict=True)), 6), i) for k, y, c in u if k == q for i, x, e in v if e == c))[:4]
        want |= {(q, i, r + 1) for r, (_, i) in enumerate(s)}
    assert {(r.qid, r.id, r["rank"]) for r in got.collect()} == want


def test_many_small_files_share_tasks(spark, tmp_path):
    companyfacts.register(spark)
    for i in range(400):
        entry = {"end": "2024-12-31", "val": i, "accn": "a"}
        (tmp_path / f"CIK{i}.json").write_text("{bad" if i % 10 == 0 else json.dumps({"cik": i, "facts": {"x": {"A": {"units": {"USD": [entry]}}}}}))
    df = spark.read.format("companyfacts").load(str(tmp_path))
    assert df.rdd.getNumPartitions() <= 150
    rows = df.collect()
    assert sorted(r.cik for r in rows if r.error is None) == [i for i in range(400) if i % 10] and sum(r.error is not None for r in rows) == 40


def hub(spark, n, m):
    """n nodes of start a, which all lead to one that leads to m others."""
    edges = [("a", "owns", f"s{i}") for i in range(n)] + [(f"s{i}", "faces", "hub") for i in range(n)] + [("hub", "owns", f"t{i}") for i in range(m)]
    return spark.createDataFrame(edges, "src string, relation string, dst string"), spark.createDataFrame([("a",)], "node string")


def test_walks_through_a_hub_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(walks, "WALKS", 10, raising=False)
    monkeypatch.setattr(walks, "EDGES", 20, raising=False)
    last = walks.walks(*hub(spark, 100, 200), 3).where("hop = 3")
    sizes = [r["count"] for r in last.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 100 * 200
    assert max(sizes) < 5000


def test_shortest_is_nearest_of_walks(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(30)}", rng.choice(["owns", "faces"]), f"n{rng.randrange(30)}") for _ in range(90)]
    edges, starts = spark.createDataFrame(edges, "src string, relation string, dst string"), spark.createDataFrame([("n1",), ("n2",), ("z",), (None,)], "node string")
    told = lambda df: sorted((r.start, r.node, r.hop, tuple(r.path)) for r in df.collect())
    assert told(walks.shortest(edges, starts, 4)) == told(walks.nearest(walks.walks(edges, starts, 4)))


def test_shortest_keeps_one_walk_a_node(spark, monkeypatch):
    """What goes on from a hub is the first path to it, not each."""
    met, step = [], walks.step
    monkeypatch.setattr(walks, "step", lambda front, *more: met.append(front.count()) or step(front, *more))
    assert walks.shortest(*hub(spark, 100, 50), 3).count() == 1 + 100 + 1 + 50
    assert met == [1, 100, 1]


def test_phrases_short_long_and_common(spark):
    """Phrases of one to twelve words, of which the filter sees eight, in texts of none to 900, against brute force."""
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choices("abc", k=rng.choice([0, 1, 5, 300, 900])))) for i in range(30)] + [(90, None), (None, "a b")]
    said = ["a", "B a", "a-b-c", "zz a", "", None, *[" ".join(rng.choice([t for _, t in texts if t and len(t) > 500]).split()[40 : 40 + n]) for n in (4, 8, 9, 12)]]
    got = phrases.hits(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in said], "phrase string")).collect()
    want = []
    for p in {p for p in said if p}:
        ws = p.lower().replace("-", " ").split()
        for i, t in texts:
            own = (t or "").split()
            want += [(i, p, k) for k in range(len(own) - len(ws) + 1) if own[k : k + len(ws)] == ws]
    assert sorted(map(str, got)) == sorted(f"Row(id={i}, phrase={p!r}, at={k})" for i, p, k in want)


def test_runs_that_are_no_phrase_stay_where_they_are(spark):
    """Of runs whose first word begins some phrase, those that are none don't move, but for a few."""
    words = [f"w{i}" for i in range(400)]
    said = spark.createDataFrame([(f"{w} {w}", [w, w]) for w in words], "phrase string, ws array<string>")
    bits = phrases.BITS_EACH * 1024
    filled = np.unpackbits(phrases.bitmap(said, [2], bits), bitorder="little")
    assert filled.sum() <= 400
    flat = pa.array([w for i in range(20) for j in range(400) for w in (words[j], words[(j + 1 + i) % 400])])
    ((_, at, bit),) = phrases.marks(flat, np.arange(0, len(flat) + 1, 2), [2], bits)
    assert len(at) == 8000
    assert filled[bit].sum() < 8000 / 10


def test_equal_questions_are_looked_for_once(spark, monkeypatch):
    """Questions that differ in words that no document has alone are one for the ranking, and each has its rows."""
    met, best = [], search.best
    monkeypatch.setattr(search, "best", lambda post, terms, k, n, asked: met.append(asked) or best(post, terms, k, n, asked))
    docs = spark.createDataFrame([(i, f"{'sales of ' * (i % 3)}the year w{i}") for i in range(40)] + [(40, None), (41, "")], "doc_id long, text string")
    q = spark.createDataFrame([(i, f"Sales S{i}" if i % 2 else f"the w{i % 4}") for i in range(20)] + [(20, "unheard"), (21, None)], "qid long, qtext string")
    got = {}
    for r in search.bm25(docs, q, 3).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id, r.score))
    assert met == [3]
    assert set(got) == set(range(20)) and all(len(x) == 3 for x in got.values())
    for i in (3, 4):
        one = search.bm25(docs, q.where(f"qid = {i}"), 3).collect()
        want = sorted((r["rank"], r.id, r.score) for r in one)
        assert all(sorted(got[j]) == want for j in range(i % 4 if i % 2 == 0 else 1, 20, 4 if i % 2 == 0 else 2))


def test_words_are_counted_as_tokens_are(spark):
    """Odd letters, empty and null texts and repeated ids, against tokens() and groupBy."""
    texts = [(1, "The the THE \u0130x \u212aelvin \u212b Été ΣΣ a1-b2_c3"), (2, None), (3, ""), (4, "..."), (5, "one"), (5, "two one"), (6, "x\x00y \U0001d400z")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    words = docs.select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("ts"))
    want = words.select("id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf")).select("id", "term", "tf", "dl")
    assert sorted(search.postings(docs, "doc_id", "text").collect()) == sorted(want.collect())
    df = words.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").count()
    assert sorted(map(tuple, search.document_frequency(docs, "text").collect())) == sorted(map(tuple, df.collect()))
    total = search.frequencies(docs, "text").agg(F.sum("size")).first()[0]
    assert total == words.where("ts is not null").agg(F.sum(F.size("ts"))).first()[0]


def test_postings_of_repeated_ids_and_of_many_words(spark, monkeypatch):
    """Of rows that share an id and a length the counts are one, whether the questions' words are few or many."""
    docs = spark.createDataFrame([(1, "a b a"), (1, "a c d"), (1, "a"), (2, "b z"), (None, "a"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(0, "a B unheard")], "qid long, qtext string")
    want = {(1, "a", 3, 3), (1, "b", 1, 3), (1, "a", 1, 1), (2, "b", 1, 2), (None, "a", 1, 1)}
    for few in (100, 1):
        monkeypatch.setattr(search, "FEW", few)
        post = search.built_for(docs, q)["postings"].select("id", "term", "tf", "dl")
        assert set(map(tuple, post.collect())) == want and post.count() == 5
        assert search.built_for(docs.where("doc_id > 1"), q)["postings"].count() == 1


def test_texts_that_are_hit_are_read_once(spark, monkeypatch):
    """eval_summary goes through all texts for its ranking, and no join of hits and texts has the corpus on a side."""
    from quarry.plans import catalog

    met, rows = [], catalog.evaluate.rows
    monkeypatch.setattr(catalog.evaluate, "rows", lambda b, hits, texts, *more: met.append((hits, texts)) or rows(b, hits, texts, *more))
    catalog.eval_summary(spark, "/root/testdata/sf0.001")
    ((hits, texts),) = met
    assert texts.count() == hits.select("id").distinct().count() < spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_exact_search_never_holds_every_question_with_every_cell(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    around = rng.normal(size=(20, 8)) * 5
    rows = [(i, (around[i % 20] + rng.normal(size=8) * 0.1).tolist()) for i in range(600)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ann.write_index(v, str(tmp_path), 20)
    held, cut = [], ann.cut
    monkeypatch.setattr(ann, "cut", lambda df: held.append(out := cut(df)) or out)
    q = v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    got = {(r.qid, r.id, r["rank"]) for r in ann.search(spark, str(tmp_path), q, 3).collect()}
    assert got == {(r.qid, r.id, r["rank"]) for r in search.dense(v, q, 3).collect()}
    assert max(df.count() for df in held) < 600 * 8

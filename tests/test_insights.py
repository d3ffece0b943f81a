"""Red flags, compliance, valuation, markets, evaluation, ingest and graph operators on small fixtures."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluate, graph, ingest, insights, market, search, valuation
from quarry.sources import tables as S

D = datetime.date


def test_red_flags_and_compliance(spark):
    chunks = spark.createDataFrame([(1, "There is substantial doubt about our\n going  concern status. " + "x" * 200), (2, "A lawsuit and litigation."), (3, "All is well.")], "id long, text string")
    hits = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (8, 3, 1)], "qid long, id long, rank long")
    sources = spark.createDataFrame([(1, "Annual report", "u/1")], "id long, title string, source_url string")
    flags = insights.red_flags(hits, chunks, sources)
    assert {(r.qid, r.flag, r.marker, r.severity, r.title) for r in flags.collect()} == {(7, "going_concern", "[1]", "high", "Annual report"), (7, "litigation", "[2]", "medium", "")}
    shown = {r.flag: r.snippet for r in flags.collect()}
    assert shown["going_concern"].startswith("There is substantial doubt about our going concern status.")
    assert shown["going_concern"].endswith("…")
    questions = spark.createDataFrame([(7,), (8,), (9,)], "qid long")
    findings = spark.createDataFrame([(7, "a", "[1]"), (7, "b", "[5]")], "qid long, label string, marker string")
    got = {r.qid: (r.verdict, r.n_flags, r.n_uncited) for r in insights.compliance(questions, hits, flags, findings).collect()}
    assert got == {7: ("ok", 2, 1), 8: ("ok", 0, 0), 9: ("insufficient_evidence", 0, 0)}
    assert {r.qid: r.clean for r in insights.scan_report(questions, hits, flags).collect()} == {7: False, 8: True, 9: True}


def test_risk_years(spark):
    rows = [("A", 1, "Item 1A. Risk Factors", D(2021, 1, 1), "cyber"), ("A", 2, "risk factors", D(2022, 1, 1), "cyber cyber"), ("A", 3, "risk factors", D(2022, 2, 1), "supply"), ("A", 4, "risk factors", D(2019, 1, 1), "old"), ("A", 5, "Business", D(2022, 1, 1), "none"), ("A", 6, None, None, "none")]
    own = insights.risk_sections(spark.createDataFrame(rows, "ticker string, chunk_id long, section string, filing_date date, text string"))
    two = insights.newest_years(own)
    assert sorted((r.chunk_id, r.place) for r in two.collect()) == [(1, 2), (2, 1), (3, 1)]
    assert {r.year: r.text for r in insights.risk_text(two, size=5).collect()} == {"2021": "cyber", "2022": "cyber\n\nsuppl"}
    topics = two.select("ticker", "year", F.explode(F.split("text", " ")).alias("topic"))
    assert {(r.topic, r.change) for r in insights.risk_changes(topics).collect()} == {("cyber", "escalated"), ("supply", "new")}


def test_assumptions_and_upside(spark):
    rows = spark.createDataFrame([("A", 2020, 100.0, 20.0), ("A", 2021, 130.0, None), ("B", 2021, 5.0, 1.0), ("C", 2021, None, 2.0), ("E", 2020, 100.0, 0.0), ("E", 2021, 110.0, 0.0)], "ticker string, year int, ocf double, capex double")
    balance = spark.createDataFrame([("A", 50.0, 20.0, 10.0), ("B", None, None, None)], "ticker string, cash double, debt double, shares double")
    got = {r.id: (r.base_fcf, r.growth_rate, r.net_cash, r.shares) for r in valuation.assumptions(rows, balance).collect()}
    assert got == {"A": (130.0, 0.3, 30.0, 10.0), "B": (4.0, 0.08, 0.0, None), "E": (110.0, 0.1, 0.0, None)}
    over = valuation.assumptions(rows, balance, spark.createDataFrame([("A", 0.05)], "ticker string, growth_rate double"))
    assert {r.id: r.growth_rate for r in over.collect()} == {"A": 0.05, "B": 0.08, "E": 0.1}
    valued = spark.createDataFrame([("A", 110.0), ("B", None)], "id string, per_share double")
    assert {r.id: r.upside_pct for r in valuation.upside(valued, spark.createDataFrame([("A", 100.0)], "ticker string, price double")).collect()} == {"A": 10.0, "B": None}


def test_derived(spark):
    p = spark.createDataFrame([("A", "gp", D(2022, 12, 31), 50.0), ("A", "rev", D(2022, 12, 31), 200.0), ("A", "rev", D(2023, 12, 31), 400.0), ("B", "gp", D(2022, 12, 31), 5.0)], "ticker string, concept string, period_end date, val double")
    assert [(r.ticker, r.value, r.unit) for r in valuation.derived(p, "gp", "rev").collect()] == [("A", 25.0, "percent")]
    assert [(r.ticker, r.value) for r in valuation.derived(p, "gp", "rev", same_period=False).collect()] == [("A", 12.5)]
    assert {(r.ticker, r.value) for r in valuation.derived(p, "gp", "rev", "difference", zero_b=True).collect()} == {("A", -150.0), ("B", 5.0)}


@pytest.mark.parametrize(("value", "unit", "want"), [(12.345, "percent", "12.35%"), (1234.5, "USD/shares", "$1,234.50 per share"), (12000.0, "shares", "12,000 shares"), (391035.0, "USD", "$391,035")])
def test_money(spark, value, unit, want):
    assert spark.createDataFrame([(value, unit)], "v double, u string").select(valuation.money(F.col("v"), F.col("u")).alias("m")).first().m == want


def test_income_links(spark):
    r = spark.createDataFrame([("A", 1, 100.0, 60.0, None, 10.0, None, 25.0, 20.0), ("B", 1, 100.0, None, None, None, None, 25.0, None)], "ticker string, year int, revenue double, cogs double, gross double, rnd double, sga double, operating double, net double")
    got = {(x.source, x.target): x.value for x in valuation.income_links(r).collect()}
    assert got == {("Revenue", "Cost of revenue"): 60, ("Revenue", "Gross profit"): 40, ("Gross profit", "R&D"): 10, ("Gross profit", "Other opex"): 5, ("Gross profit", "Operating income"): 25, ("Operating income", "Tax & other"): 5, ("Operating income", "Net income"): 20}


def test_market(spark):
    s = spark.createDataFrame([("A", [0, 86400, 172800], [1.0, None, 3.0])], "ticker string, at array<long>, close array<double>")
    points = market.points(s)
    assert sorted((r.d, r.close) for r in points.collect()) == [(D(1970, 1, 1), 1.0), (D(1970, 1, 3), 3.0)]
    meta = spark.createDataFrame([("A", None, None, 0.5), ("B", 10.0, 8.0, -1.0)], "ticker string, price double, previous double, eps double")
    assert {r.ticker: (r.price, r.previous, r.change_pct, r.pe) for r in market.quotes(meta, points).collect()} == {"A": (3.0, 1.0, 200.0, 6.0), "B": (10.0, 8.0, 25.0, None)}
    raw = spark.createDataFrame([("1.5",), ("n/a",), ("NaN",), (None,)], "t string")
    assert [r.v for r in raw.select(market.number(F.col("t")).alias("v")).collect()] == [1.5, None, None, None]
    dates = spark.createDataFrame([("A", D(2024, 1, 1), 1.0), ("A", D(2024, 9, 1), None), ("A", D(2024, 6, 1), None)], "ticker string, d date, eps_reported double")
    assert market.next_earnings(dates, "2024-02-01").first().next == D(2024, 6, 1)
    watched = spark.createDataFrame([("A",), ("Z",)], "ticker string")
    flags = spark.createDataFrame([("A", "high"), ("A", "medium")], "ticker string, severity string")
    changes = spark.createDataFrame([("A", "t", "new")], "ticker string, topic string, change string")
    assert {r.ticker: (r.n_flags, r.notable) for r in market.digest(watched, market.quotes(meta, points), flags, changes).collect()} == {"A": (2, 2), "Z": (0, 0)}


def test_evaluation(spark):
    q = spark.createDataFrame([(1, "net  sales rose"), (2, "nothing")], "qid long, gold string")
    hits = spark.createDataFrame([(1, 5), (2, 5)], "qid long, id long")
    texts = spark.createDataFrame([(5, "The Net sales\nrose again")], "id long, text string")
    answered = spark.createDataFrame([(1, "rose [1]", True), (2, "no", False)], "qid long, answer string, matched boolean")
    verdicts = spark.createDataFrame([(1, True), (2, False)], "id long, passed boolean")
    measured = evaluate.rows(q, hits, texts, answered, verdicts)
    assert tuple(evaluate.summary(measured).first()) == (2, 0.5, 0.5, 0.5, 0.5, 0.5)
    assert tuple(evaluate.summary(measured.limit(0)).first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert spark.createDataFrame([("http://a/b/x-1.htm",)], "u string").select(evaluate.tail(F.col("u")).alias("t")).first().t == "x-1.htm"


HTML = "<h1>Item 1. Business</h1><p>We&nbsp;sell   things.</p><div><table><tr><th>a</th></tr><tr><td>1</td></tr></table></div><h2>Item 1A. Risk Factors</h2><p>" + "risk " * 30 + "</p><p>" + "".join(f"{i:04d}" for i in range(225)) + "</p>"


def test_ingest(spark):
    raw = spark.createDataFrame([(1, "A", "10-K", "Report", HTML, "html"), (2, "B", "news", None, "one\n\n\ntwo  words", "text"), (3, "B", "news", None, "one\n\n\ntwo  words", None)], "id long, ticker string, doc_type string, title string, content string, content_type string")
    none = spark.createDataFrame([], "chunk_id string")
    chunks = ingest.ingested(raw, none, 100, 20, {"10-K": "annual report (10-K)"})
    got = [(r.chunk_seq, r.section, r.text) for r in chunks.where("id = 1").orderBy("chunk_seq").collect()]
    assert [g[:2] for g in got] == [(0, "Item 1. Business"), (1, "Item 1. Business"), (2, "Item 1A. Risk Factors"), (3, "Item 1A. Risk Factors"), (4, "Item 1A. Risk Factors"), (5, "Item 1A. Risk Factors")]
    assert got[0][2] == "Item 1. Business\n\nWe sell things."
    assert got[1][2] == "a\n1"
    assert got[2][2].startswith("Item 1A. Risk Factors\n\nrisk risk")
    assert [len(g[2]) for g in got[3:]] == [400, 400, 260]
    assert chunks.where("id = 1").first().context.startswith("This excerpt is from A's annual report (10-K) titled \"Report\"")
    assert [r.text for r in chunks.where("id = 2").collect()] == ["one\n\ntwo words"]
    again = ingest.ingested(raw, chunks, 100, 20)
    assert again.count() == 0
    stats = {r.ticker: (r.docs, r.chunks_total, r.chunks_new, r.chunks_skipped) for r in ingest.ingest_stats(raw, chunks, again).collect()}
    assert stats == {"A": (1, 6, 0, 6), "B": (2, 2, 0, 2)}


def test_dimension(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    assert ingest.same_dimension(v, "v", 2).count() == 1
    with pytest.raises(Exception, match="not 3 dimensions"):
        ingest.same_dimension(v, "v", 3).collect()


def test_graph_build(spark):
    chunks = spark.createDataFrame([(1, "A", "Cyber  ATTACK risk"), (2, "A", "cyber attack"), (3, "B", "quiet")], "chunk_id long, ticker string, text string")
    phrases = spark.createDataFrame([("cyber", "cyber attack"), ("supply", "supply chain")], "topic string, phrase string")
    e = graph.build(chunks, phrases, spark.createDataFrame([(3, "Jo Roe")], "id long, name string"), spark.createDataFrame([(3, "B Foods LLC"), (3, "A Foods LLC")], "id long, name string"))
    assert {r.kind: r.n for r in graph.stats(e).collect()} == {"company": 2, "topic": 1, "officer": 1, "subsidiary": 2, "faces": 2, "has_officer": 1, "owns": 2}
    assert graph.related(e, "owns").first().names == "A Foods LLC; B Foods LLC"
    assert graph.evidence_of(e, "faces", "A", "cyber").count() == 2
    names = e.where("relation = 'owns'").select("src", F.col("dst").alias("name"))
    assert graph.listed(names, 1).first().line == "A Foods LLC +1 more"


def test_index_tables(spark, tmp_path):
    """Ranking from the written tables gives what ranking from the documents does, and reads few folders."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    q = spark.createDataFrame([(0, "the tion license"), (1, "ereding and")], "qid long, qtext string")
    search.write_index(search.index(docs), str(tmp_path / "i"), 16)
    read = search.read_index(spark, str(tmp_path / "i"), q, parts=16)
    assert sorted(map(tuple, search.ranked(read, q, 5).collect())) == sorted(map(tuple, search.bm25(docs, q, 5).collect()))
    assert read["postings"].select("slot").distinct().count() < 16


def test_sources(spark):
    lines = spark.createDataFrame([('{"id": "1", "question": "q"}',), ("# note",), ("",), ('{"id": "2"}',), ("{bad",)], "value string")
    assert [r.id for r in S.questions_file(lines).collect()] == ["1"]
    flat = spark.createDataFrame([("us-gaap", "A"), ("dei", "A"), ("us-gaap", "B")], "taxonomy string, concept string")
    assert S.wanted_facts(flat, spark.createDataFrame([("A",)], "concept string")).count() == 1
    rows = spark.createDataFrame([(1, None), (2, "ws"), (3, "public")], "id long, workspace_id string")
    assert sorted(r.id for r in S.in_workspaces(rows, ["public"]).collect()) == [1, 3]
    new = spark.createDataFrame([(1, "b"), (1, "a")], "k long, v string")
    assert [tuple(r) for r in S.insert_absent(new.limit(0), new, ["k"], ["v"]).collect()] == [(1, "a")]

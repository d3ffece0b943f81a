"""Filings, statements, news, uploads, and small operators of search and tenants."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quarry.operators import search, tenancy
from quarry.sources import filings

D = datetime.date


def test_filings(spark):
    f = spark.createDataFrame([("A", "10-K", D(2020 + k, 1, 1), f"a{k}") for k in range(4)] + [("A", "8-K", D(2020, 1, 1), "b")], "ticker string, form string, filing_date date, accn string")
    assert sorted(r.accn for r in filings.recent(f, 2).collect()) == ["a2", "a3", "b"]
    known = spark.createDataFrame([("aapl", 320193), ("x", 1)], "ticker string, cik long")
    assert [(r.ticker, r.cik) for r in filings.registrants(spark.createDataFrame([("AAPL",), ("none",)], "ticker string"), known).collect()] == [("AAPL", "0000320193")]
    files = spark.createDataFrame([("a", 1, "main.htm"), ("a", 2, "ex-21.htm"), ("a", 3, "exhibit21b.htm"), ("b", 1, "x.htm")], "accn string, pos int, name string")
    assert [tuple(r) for r in filings.exhibits(files).collect()] == [("a", "ex-21.htm")]
    u = spark.createDataFrame([("0000320193", "0000-24-1")], "cik string, accn string")
    assert u.select(filings.url(F.col("cik"), F.col("accn"), "http://x").alias("u")).first().u == "http://x/320193/0000241"


def test_texts(spark, tmp_path):
    p = spark.createDataFrame([("A", "Sales", D(2018 + k, 12, 31), 1000.0 * k) for k in range(6)] + [("A", "Cost", D(2020, 12, 31), None)], "ticker string, item string, period_end date, val double")
    assert [r.line for r in filings.statement_lines(p, 2).collect()] == ["Sales: 2023-12-31 5,000; 2022-12-31 4,000"]
    n = spark.createDataFrame([(1, "A", "T", "S", "20240131T1200"), (2, "A", "", "S", "soon")], "id long, ticker string, title string, summary string, published string")
    assert [(r.filing_date, r.content) for r in filings.articles(n).orderBy("id").collect()] == [(D(2024, 1, 31), "T\n\nS"), (None, "S")]
    for name, text in (("a.html", "<p>x</p>"), ("b.TXT", "é"), ("c.pdf", "z"), ("d.md", "long " * 50)):
        (tmp_path / name).write_text(text)
    got = {r.name: (r.content, r.content_type, r.error) for r in filings.uploads(spark, str(tmp_path), 100).collect()}
    assert got == {"a.html": ("<p>x</p>", "html", None), "b.TXT": ("é", "text", None), "c.pdf": (None, "text", "unsupported"), "d.md": (None, "text", "too large")}
    flat = spark.createDataFrame([(1,), (1,)], "cik long")
    assert {r.ticker: r.n for r in filings.ingested_facts(flat, spark.createDataFrame([(1, "A"), (2, "B")], "cik long, ticker string")).collect()} == {"A": 2, "B": 0}


def test_small(spark):
    q = spark.createDataFrame([("A b cc dd cc",)], "q string")
    assert q.select(search.or_terms(F.col("q")).alias("t")).first().t == "cc | dd"
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 9)], "qid long, id long, rank long")
    texts = spark.createDataFrame([(10, "Nothing here. Net sales rose. Sales net."), (11, "Only this."), (12, "net sales")], "id long, text string")
    asked = spark.createDataFrame([(1, "net sales")], "qid long, qtext string")
    assert search.extractive(hits, texts, asked).first().answer == "Net sales rose. [1] Only this. [2]"
    c = spark.createDataFrame([(1, " ctx ", "t"), (2, None, "t")], "chunk_id long, context string, text string")
    assert [r.indexed for r in search.contextual(c).orderBy("chunk_id").collect()] == ["ctx\n\nt", "t"]
    rows = spark.createDataFrame([(1, "m1"), (2, "m2")], "conv_id long, text string")
    parents = spark.createDataFrame([(1, 5), (2, 6)], "conv_id long, org_id long")
    assert [r.text for r in tenancy.owned(rows, parents, "conv_id", 5).collect()] == ["m1"]
    wanted = spark.createDataFrame([(5, "a", 1), (5, "b", 2), (6, "c", 1)], "org_id long, email string, ts long")
    taken = spark.createDataFrame([(5, 2, 1), (6, 3, 0)], "org_id long, used long, free long")
    assert [r.email for r in tenancy.invitations(wanted, taken).collect()] == ["a"]
    assert [r.email for r in tenancy.newest(wanted, "org_id", 5, "ts", 1).collect()] == ["b"]

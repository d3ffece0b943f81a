"""Behaviour of operators on small tables, against values worked out by hand or by plain Python."""

from __future__ import annotations

import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import facts as X
from quarry.operators import gate, graph, ingest, metering, search
from quarry.sources import tables as S

D = datetime.date


def fact(ticker, concept, end, start, val, filed, form="10-K", seq=1):
    return (ticker, concept, "USD", end, start, form, float(val), filed, seq, 1)


FACTS = "ticker string, concept string, unit string, period_end date, period_start date, form string, val double, filed date, seq1 long, seq2 int"


def test_annual_restated_chain(spark):
    rows = [
        fact("A", "x", D(2020, 12, 31), D(2020, 1, 1), 1, D(2021, 2, 1)), fact("A", "x", D(2020, 12, 31), D(2020, 1, 1), 2, D(2022, 2, 1)), fact("A", "x", D(2020, 12, 31), D(2020, 10, 1), 9, D(2023, 2, 1)),
        fact("A", "x", D(2021, 12, 31), None, 3, None), fact("A", "y", D(2021, 12, 31), D(2021, 1, 1), 4, D(2022, 2, 1)), fact("A", "y", D(2022, 12, 31), D(2022, 1, 1), 5, D(2023, 2, 1)),
        fact("A", "y", D(2022, 12, 31), D(2022, 1, 1), 6, D(2024, 2, 1), form="10-Q"),
    ]
    own = X.resolved(spark.createDataFrame(rows, FACTS))
    chained = {(r.period_end.year, r.val) for r in X.chained(own, ["x", "y"]).collect()}
    assert chained == {(2020, 2.0), (2021, 3.0), (2022, 5.0)}
    assert [r.val for r in X.newest(X.chained(own, ["x", "y"])).collect()] == [5.0]
    assert {r.val for r in X.as_of(spark.createDataFrame(rows, FACTS), "2021-12-31").collect()} == {1.0}


@pytest.mark.parametrize(("days", "kept"), [(299, 0), (300, 1), (400, 1), (401, 0)])
def test_annual_span(spark, days, kept):
    row = fact("A", "x", D(2021, 12, 31), D(2021, 12, 31) - datetime.timedelta(days=days), 1, D(2022, 1, 1))
    assert X.annual(spark.createDataFrame([row], FACTS)).count() == kept


def test_dcf(spark):
    cols = "id string, base_fcf double, growth_rate double, terminal_growth double, discount_rate double, years int, net_cash double, shares double"
    rows = [("grow", 100.0, 0.1, 0.02, 0.1, 3, 0.0, 10.0), ("flat", 100.0, 0.0, 0.0, 0.1, 1, 500.0, None), ("clamp", 100.0, 0.0, 0.2, 0.1, 1, 0.0, 1.0)]
    df = spark.createDataFrame(rows, cols)
    assert [r.fcf for r in X.dcf(df).where("id = 'grow'").orderBy("year").collect()] == [110.0, 121.0, 133.1]
    assert X.dcf(df).where("id = 'flat'").first().pv == pytest.approx(90.9091)
    value = {r.id: r for r in X.dcf_value(df).collect()}
    assert value["flat"].per_share is None
    assert value["flat"].equity == pytest.approx(100 / 1.1 + 100 / 0.1 / 1.1 + 500, abs=0.01)
    assert value["clamp"].equity == pytest.approx(100 / 1.1 + 100 * 1.095 / 0.005 / 1.1, abs=0.01)
    assert X.sensitivity(df).count() == 75


def test_screen_skips_unknown(spark):
    df = spark.createDataFrame([("A", 1.0, None), ("B", 3.0, 2.0), ("C", 2.0, 9.0)], "ticker string, revenue double, margin double")
    assert [r.ticker for r in X.screen(df, [("revenue", ">", 1.0), ("no", ">", 0.0), ("margin", "=", 1.0)], "revenue").collect()] == ["B", "C"]
    assert [r.ticker for r in X.screen(df, [("margin", ">", 1.0)], "revenue").collect()] == ["C", "B"]


def brute_cut(scores, top):
    s = sorted(scores, reverse=True)[:top]
    if len(s) <= 3 or s[0] == s[-1]:
        return min(top, len(s))
    gaps = [round(a - b, 6) for a, b in zip(s, s[1:], strict=False)]
    if max(gaps) < 0.35 * round(s[0] - s[-1], 6):
        return min(top, len(s))
    return min(len(s), max(3, min(top, gaps.index(max(gaps)) + 1 + 2)))


def test_adaptive_k(spark):
    rng = random.Random(3)
    lists = {0: [9, 8.5, -6, -7, -8], 1: [9, 8, 7, 6, 5, 4], 2: [9, 1, 0.9, 0.8], 500: [9, 5, 4.9, 4.8, 4.7, 4.6, 4.5, -9]} | {i: [round(rng.uniform(0, 9), rng.choice([0, 2])) for _ in range(rng.randint(1, 9))] for i in range(3, 80)}
    df = spark.createDataFrame([(q, i, float(s)) for q, x in lists.items() for i, s in enumerate(x)], "qid long, id long, score double")
    got = {r.qid: r["count"] for r in search.adaptive_k(df, 6).groupBy("qid").count().collect()}
    assert got == {q: brute_cut(x, 6) for q, x in lists.items()}
    assert got[500] == 3


def test_rrf(spark):
    hits = lambda x: spark.createDataFrame([(0, i, r + 1) for r, i in enumerate(x)], "qid long, id string, rank long")
    got = [r.id for r in search.rrf(hits("abc"), hits("bde")).orderBy("rank").collect()]
    assert got[0] == "b"
    assert set(got) == set("abcde")
    assert [r.id for r in search.rrf(hits("abc"), hits("")).orderBy("rank").collect()] == ["a", "b", "c"]


def test_interleave(spark):
    df = spark.createDataFrame([(0, i, i + 1) for i in range(5)], "qid long, id long, rank long")
    assert [r.id for r in search.interleave(df).orderBy("place").collect()] == [0, 2, 4, 3, 1]


def test_bm25_brute(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices("alpha beta gamma delta eps zeta".split(), k=rng.randint(1, 12)))) for i in range(30)]
    ask = "alpha zeta zeta"
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: r.score for r in search.bm25(df, spark.createDataFrame([(0, ask)], "qid long, qtext string"), 30).collect()}
    words = {i: t.split() for i, t in docs}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    vocabulary = {w for x in words.values() for w in x}
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w in vocabulary if (d := sum(w in x for x in words.values()))}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    for i, x in words.items():
        want = sum(idf[w] * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for w in ask.split())
        assert got.get(i, 0) == pytest.approx(want, abs=2e-6)


def test_overlap(spark):
    e = spark.createDataFrame([("A", "t"), ("B", "t"), ("C", "t"), ("A", "u"), ("B", "u"), ("C", "v"), ("A", "t")], "ticker string, topic string")
    got = {r.topic: (r.n, r.share) for r in graph.overlap(e, ["A", "B", "C"]).collect()}
    assert got == {"t": (3, 1.0), "u": (2, 0.67)}
    assert graph.overlap(e, ["A"]).count() == 0


def test_arithmetic(spark):
    df = spark.createDataFrame([("2 + 2 = 4 and 10 / 4 = 2.51 but 3 * 3 = 10 or 1 / 0 = 5; 1,000 + 2,000 = 9,999 and 1,000 + 2,000 = 3,000",)], "t string")
    assert [c.ok for c in df.select(T.arithmetic_claims(F.col("t")).alias("c")).first().c] == [True, True, False, True, False, True]


GATE = [
    ("good", "Revenue was 1,234 in total.", "total revenue was 1234", True),
    ("figure", "Revenue was 9,876 in total.", "total revenue was 1234", False),
    ("empty", "", "x", False),
    ("blank", " \n ", "x", False),
    ("null answer", None, "x", False),
    ("no evidence", "Revenue was 391,035 million.", None, False),
    ("blank evidence", "All is well here today.", "  ", False),
    ("sum", "So 2 + 2 = 5 holds.", "so holds 2 2 5", False),
    ("commas", "So 1,000 + 2,000 = 9,999 holds.", "so holds 1000 2000 9999", False),
    ("near sum", "So 10 / 4 = 2.51 holds.", "so holds 10 4 2.51", True),
    ("share", "It grew by 45% then.", "it grew then", False),
    ("scaled", "It was $12 billion then.", "it was then 13 billion", False),
    ("small count", "It had 12 parts in all.", "it had parts in all", True),
    ("prose doubt", "Revenue was 1234 in total. Zebras quietly admire purple submarines. It was in total.", "revenue was 1234 in total it", True),
    ("cited doubt", "Zebras quietly admire purple submarines [1].", "revenue was 1234", True),
    ("all doubt", "Zebras quietly admire purple submarines.", "revenue was 1234", False),
    ("doubt with a figure", "Revenue was in total. It was so. Zebras admire purple submarines 1234 times.", "revenue 1234 was in total it was so", False),
]


def test_verdict(spark):
    got = {r.id: r for r in gate.verdict(spark.createDataFrame([r[:3] for r in GATE], "id string, answer string, evidence string")).collect()}
    assert {k: r.passed for k, r in got.items()} == {k: ok for k, _, _, ok in GATE}
    assert (got["empty"].score, got["empty"].reason) == (0.0, "Empty answer.")
    assert got["no evidence"].reason == "No evidence to support the answer."
    assert got["prose doubt"].score == 0.667


def test_evaluated(spark):
    df = spark.createDataFrame([("2+3*4",), ("1/0",), ("open('x')",), (None,)], "expression string")
    assert [(r.value, r.ok) for r in gate.evaluated(df).collect()] == [(14.0, True), (None, False), (None, False), (None, False)]


def test_parts(spark):
    df = spark.createDataFrame([("What is A and B?",), ("apples AND Apples",), ("x",), ("a versus b. as well as c compared to d",)], "q string")
    assert [r.p for r in df.select(T.parts(F.col("q")).alias("p")).collect()] == [["What is A and B?", "What is A", "B"], ["apples AND Apples", "apples"], ["x"], ["a versus b. as well as c compared to d", "a", "b"]]


@pytest.mark.parametrize(("expression", "value"), [("2+3*4", 14.0), ("2**3", 8.0), ("-(1+1)", -2.0), ("7 % 4", 3.0), ("1/0", None), ("abs(1)", None), ("x", None), ("9**999", None), ("", None)])
def test_safe_eval(expression, value):
    assert gate.safe_eval(expression) == value


def test_html():
    page = "<html><script>no <p> here</script><h1>Item 1.</h1><div><p>One  two<br>three</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table></div><p>open<p>last"
    assert ingest.parse_html(page) == [("Item 1.", False), ("One twothree", False), ("a | b\n1 | 2", True), ("open", False), ("last", False)]


def brute_pack(blocks, target):
    out, cur, t, alone = [], [], 0, False
    for seq, text, table in blocks:
        k = max(1, len(text) // 4)
        if cur and (table or alone or t + k > target):
            out.append((cur[0], cur[-1]))
            cur, t = [], 0
        cur.append(seq)
        t, alone = t + k, table
    return out + ([(cur[0], cur[-1])] if cur else [])


def test_pack_blocks(spark):
    rng = random.Random(2)
    docs = {i: [(s, "x" * rng.randint(1, 120), rng.random() < 0.2) for s in range(rng.randint(1, 15))] for i in range(20)}
    df = spark.createDataFrame([(i, *b) for i, x in docs.items() for b in x], "id long, block_seq long, text string, is_table boolean")
    got: dict = {}
    for r in ingest.pack_blocks(df, 30).orderBy("id", "chunk_seq").collect():
        got.setdefault(r.id, []).append((r.first_seq, r.last_seq))
    assert got == {i: brute_pack(x, 30) for i, x in docs.items()}


def test_rate_limit_and_downsample(spark):
    t = datetime.datetime(2024, 1, 1, 10, 0)
    calls = spark.createDataFrame([("a", t + datetime.timedelta(seconds=s), s) for s in (0, 10, 20, 70)] + [("b", t, 1)], "key string, ts timestamp, id long")
    assert sorted((r.key, r.id) for r in metering.rate_limited(calls, 2).where("not allowed").collect()) == [("a", 20)]
    series = spark.createDataFrame([("x", D(2024, 1, 1) + datetime.timedelta(days=i), float(i)) for i in range(12)], "ticker string, d date, close double")
    assert sorted(r.close for r in metering.downsample(series, 5).collect()) == [0.0, 5.0, 10.0, 11.0]


def test_companyfacts_and_insert(spark):
    entry = {"end": "2023-12-31", "start": "2023-01-01", "val": 5, "accn": "a1", "form": "10-K", "filed": "2024-02-01"}
    raw = json.dumps({"cik": 7, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [entry, entry | {"val": None}]}}}}})
    rows = S.companyfacts(spark.createDataFrame([(raw,)], "json string")).collect()
    assert [(r.cik, r.concept, r.unit, r.val) for r in rows] == [(7, "Revenues", "USD", 5.0)]
    known = spark.createDataFrame([(1, "x")], "k long, v string")
    new = spark.createDataFrame([(1, "y"), (2, "a"), (2, "a")], "k long, v string")
    assert [r.k for r in S.insert_absent(known, new, ["k"]).collect()] == [2]

from __future__ import annotations

import datetime

from quarry.operators import graph, tenancy


def test_scope_state_seats(spark):
    rows = spark.createDataFrame([(1, "public"), (2, "a"), (3, "b")], "id long, workspace_id string")
    own = spark.createDataFrame([("a", 1), ("b", 2)], "workspace_id string, org_id long")
    assert sorted(r.id for r in tenancy.accessible(rows, own, 1).collect()) == [1, 2]
    changes = spark.createDataFrame([("x", 1, "on"), ("x", 2, "off"), ("y", 1, "on"), ("y", 3, None)], "k string, t long, v string")
    assert [(r.k, r.v) for r in tenancy.current(changes, ["k"], "v", ["t"]).collect()] == [("x", "off")]
    members = spark.createDataFrame([(1, "admin"), (1, "viewer"), (2, "owner")], "org_id long, role string")
    invites = spark.createDataFrame([(1, "pending"), (1, "gone")], "org_id long, status string")
    limits = spark.createDataFrame([(1, 3), (2, 5), (3, 2)], "org_id long, seats long")
    assert sorted(map(tuple, tenancy.seats(members, invites, limits).collect())) == [(1, 3, 0), (2, 1, 4), (3, 0, 2)]
    ranks = spark.createDataFrame([("viewer", 0), ("admin", 1), ("owner", 2)], "role string, rank int")
    assert sorted(r.role for r in tenancy.ranked_at_least(members, ranks, "admin").collect()) == ["admin", "owner"]
    tables = {"members": members, "invites": invites}
    assert tenancy.export(tables, 1).count() == 4
    assert tenancy.erase(tables, 1)["members"].count() == 1


def test_sources_and_surprises(spark):
    rows = spark.createDataFrame([("A", 1, float("nan")), ("A", 2, 5.0), ("A", 3, 6.0), ("B", 1, None)], "ticker string, priority int, price double")
    assert [(r.ticker, r.price) for r in tenancy.first_source(rows, ["ticker"], "price").collect()] == [("A", 5.0)]
    d = datetime.date
    earned = spark.createDataFrame([("A", d(2024, 1, 1), 1.0, 1.1), ("A", d(2024, 4, 1), -2.0, -1.0), ("A", d(2024, 7, 1), 1.0, None), ("A", d(2023, 1, 1), 0.0, 1.0)], "ticker string, d date, eps_estimate double, eps_reported double")
    assert sorted((r.d.year, r.d.month, r.surprise_pct) for r in tenancy.surprises(earned).collect() if r.surprise_pct is not None) == [(2024, 1, 10.0), (2024, 4, 50.0)]


def test_topics_of_questions(spark):
    phrases = spark.createDataFrame([("supply chain", "shortage"), ("patents", "patent")], "topic string, phrase string")
    q = spark.createDataFrame([(1, "any shortage or Patent risk?"), (2, "supply chain"), (3, "none")], "qid long, question string")
    assert sorted(map(tuple, graph.query_topics(q, phrases).collect())) == [(1, "patents"), (1, "supply chain"), (2, "supply chain")]

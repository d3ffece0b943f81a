"""Hybrid retrieval of all stated questions against some asked alone, over the same indexes."""

from __future__ import annotations

from quarry.operators import hybrid
from quarry.plans import catalog

SF = "/root/testdata/sf0.001"


def test_hybrid_batch(spark, tmp_path):
    qs = catalog.batch(spark, SF)
    ids = sorted(r.qid for r in qs.select("qid").collect())
    assert len(ids) > 1
    vectors, index = catalog.indexes(spark, SF, str(tmp_path))
    got = {tuple(r) for r in hybrid.retrieve(spark, vectors, index, qs).collect()}
    assert {r[0] for r in got} == set(ids)
    for i in ids[:2]:
        one = hybrid.retrieve(spark, vectors, index, qs.where(f"qid = {i}"))
        assert {r for r in got if r[0] == i} == {tuple(r) for r in one.collect()}


def test_candidates_are_worked_out_once(spark, tmp_path):
    """Reranking reads the index's postings and the checkpointed candidates: neither texts nor vectors are read again."""
    vectors, index = catalog.indexes(spark, SF, str(tmp_path))
    qs = catalog.batch(spark, SF)
    found = hybrid.candidates(spark, vectors, index, qs)
    plan = hybrid.reranked(index, found, catalog.asks(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "embeddings.parquet" not in plan
    assert str(tmp_path / "vectors") not in plan
    assert "ExistingRDD" in plan

"""Company facts by Spark's reader interface: filters that leave out files, broken files, empty folders."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quarry.sources import companyfacts


@pytest.fixture
def folder(spark, tmp_path):
    companyfacts.register(spark)
    for cik in (1, 20, 300):
        entry = {"start": "2023-01-01", "end": "2023-12-31", "val": cik * 1.5, "accn": "x", "form": "10-K", "filed": "2024-02-01"}
        facts = {"us-gaap": {"Revenues": {"units": {"USD": [entry, {**entry, "val": None}]}}, "Assets": {"units": {"USD": [entry]}}}, "dei": {"Shares": {"units": {"shares": [entry]}}}}
        (tmp_path / f"CIK{cik:010d}.json").write_text(json.dumps({"cik": cik, "facts": facts}))
    (tmp_path / "CIK0000000007.json").write_text("{no")
    (tmp_path / "note.txt").write_text("not read")
    return str(tmp_path)


def test_rows_and_errors(spark, folder):
    df = spark.read.format("companyfacts").load(folder)
    assert df.rdd.getNumPartitions() == 4
    good = df.where("error is null")
    assert sorted((r.cik, r.taxonomy, r.concept, r.unit, r.val) for r in good.collect()) == sorted((c, t, k, u, c * 1.5) for c in (1, 20, 300) for t, k, u in (("us-gaap", "Revenues", "USD"), ("us-gaap", "Assets", "USD"), ("dei", "Shares", "shares")))
    bad = df.where("error is not null").collect()
    assert [(r.cik, r.file.rsplit("/", 1)[1]) for r in bad] == [(None, "CIK0000000007.json")]


def test_filters_leave_out_files_and_concepts(spark, folder):
    df = spark.read.format("companyfacts").load(folder)
    one = df.where((F.col("cik") == 20) & (F.col("concept") == "Revenues"))
    assert one.rdd.getNumPartitions() == 1
    assert [(r.cik, r.concept) for r in one.collect()] == [(20, "Revenues")]
    assert df.where(F.col("cik").isin(1, 300)).rdd.getNumPartitions() == 2
    assert {r.taxonomy for r in df.where("taxonomy = 'dei' and val > 2").collect()} == {"dei"}
    assert df.where("taxonomy = 'dei' and val > 2").count() == 2


def test_empty_folder(spark, tmp_path):
    companyfacts.register(spark)
    assert spark.read.format("companyfacts").load(str(tmp_path)).count() == 0

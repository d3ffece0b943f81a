"""The linear model against Newton's method, scoring against features, and one exchange of labels by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import quality_classifier as qc
from quarry.llm.learn import Rows, logistic, sigmoid

TEXTS = [b"", b" \n ", b"one", b"Two two TWO", "Größe 12,5% (x) ça va — va".encode(), b"a-b a-b c1 c1 c1 !!", b"word " * 400]


def test_logistic_is_the_minimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5)) * (rng.random((200, 5)) < 0.6)
    y = (x @ [1.0, -2, 0.5, 0, 1] + rng.normal(size=200) > 0).astype(float)
    rows = Rows([np.flatnonzero(r).astype("i4") for r in x], [r[r != 0] for r in x])
    w, b = logistic(rows, y, 5, l2=1e-2, steps=4000)
    full, theta = np.hstack([x, np.ones((200, 1))]), np.zeros(6)
    ridge = 1e-2 * np.diag([1.0] * 5 + [0.0])
    for _ in range(50):
        p = sigmoid(full @ theta)
        theta -= np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full / 200 + ridge, full.T @ (p - y) / 200 + ridge @ theta)
    assert np.append(w, b) == pytest.approx(theta, abs=1e-4)


@pytest.mark.parametrize("text", TEXTS)
def test_scoring_is_the_features_product(text):
    w = np.random.default_rng(1).normal(size=qc.CONTENT)
    want = 0.25 + sum(w[k] * v for k, v in qc.content_view(text).items())
    scorer = qc.ContentScorer(w, 0.25)
    assert scorer(text) == pytest.approx(want, abs=1e-9)
    assert scorer(text) == pytest.approx(want, abs=1e-9)  # remembered words


def test_one_exchange(spark):
    """What a view is surest of, by scoring every unlabelled document and sorting."""
    words = ["good", "fine", "bad", "junk", "plain", "other"]
    docs = [(i, " ".join(words[(i * k) % 6] for k in range(1, 9)), "en" if i % 2 else "fr", f"s{i % 3}", 100 + i) for i in range(60)] + [(None, "good", "en", "s1", 4), (7, "good good", "en", "s1", 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i,) for i in range(0, 60, 5)], "doc_id long")
    rng = np.random.default_rng(0)
    model = qc.Model((rng.normal(size=qc.CONTENT) * 2, 0.1), (rng.normal(size=qc.META) * 2, -0.1), np.zeros(3), np.ones((2, 2)))
    got = {r.doc_id: r.y for r in qc.sure(df, labels, model, teach=8, rate=0.5, certain=0.6).collect()}
    best = [{}, {}]
    for i, *rest in docs:
        if i is not None and i % 5:
            p = sigmoid(model.raw({"text": [rest[0].encode()], "lang": [rest[1]], "source": [rest[2]], "n_chars": [rest[3]]}))[0]
            for v in range(2):
                best[v][i] = max(best[v].get(i, 0), p[v])
    hashes = {r.i: r.h for r in spark.range(60).select(F.col("id").alias("i"), F.xxhash64("id").alias("h")).collect()}
    want = {}
    for v in range(2):
        ids = sorted(best[v], key=lambda i: (-best[v][i], hashes[i], i))
        for i in [i for i in ids if best[v][i] > 0.6][:2]:
            want[i] = want.get(i, 0) + (3 << 2 * v)
        for i in [i for i in sorted(best[v], key=lambda i: (best[v][i], hashes[i], i)) if best[v][i] < 0.4][:2]:
            want[i] = want.get(i, 0) + (2 << 2 * v)
    assert got == want
    assert len(got) > 4

"""Operator 5's effort follows the table, not constants."""

import numpy as np

from lectern.llm import ann


def _recall(got, x, k=20):
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    kth = np.sort(s, axis=1)[:, -k]
    return sum(r["score"] >= kth[r["query_id"]] - 1e-9 for r in got) / len(got)


def test_search_goes_on_until_the_recall_is_reached(spark, monkeypatch):
    # a beam and leaves as small against this table as the real ones are against a very large one
    monkeypatch.setattr(ann, "LEAF", 60)
    monkeypatch.setattr(ann, "TREES", 2)
    monkeypatch.setattr(ann, "BEAM", 24)
    x = np.random.default_rng(6).standard_normal((3000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(vectors, degree=12).collect()
    assert len(got) == 150 * 20
    assert _recall(got, x) >= 0.94

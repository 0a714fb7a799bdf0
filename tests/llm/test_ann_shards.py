"""Operator 5's disk follows the input, and its shards together have every row."""

import os

import numpy as np

from lectern.llm import ann


def _written(spark):
    """Bytes in the session's shuffle and checkpoint folders."""
    context = spark.sparkContext
    folders = [f.getPath() for f in context._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    kept = context._jsc.sc().getCheckpointDir()
    folders += [kept.get().removeprefix("file:")] if kept.isDefined() else []
    return sum(os.path.getsize(os.path.join(d, f)) for top in folders for d, _, names in os.walk(top) for f in names)


def _check(got, x, k=20):
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    kth = np.sort(s, axis=1)[:, -k]
    return sum(r["score"] >= kth[r["query_id"]] - 1e-9 for r in got) / len(got)


def test_disk_follows_the_input(spark, tmp_path):
    x = np.random.default_rng(9).standard_normal((4000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "v"))
    before = _written(spark)
    got = ann.search(spark.read.parquet(str(tmp_path / "v"))).collect()
    size = sum(f.stat().st_size for f in (tmp_path / "v").glob("*.parquet"))
    assert len(got) == 200 * 20 and _check(got, x.astype(np.float64)) >= 0.93
    assert _written(spark) - before <= 4 * size


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 150)
    rng = np.random.default_rng(10)
    x = rng.standard_normal((3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    x[1000:2000] = x[1000]  # in several shards of one cell
    got = ann.search(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert len(got) == 150 * 20 and len({(r["query_id"], r["vec_id"]) for r in got}) == len(got)
    assert _check(got, x) >= 0.93
    by_query = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by_query.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert all(found == sorted(found) for found in by_query.values())
    same = [i for _, i in by_query[1500] if 1000 <= i < 2000]
    assert same == list(range(1000, 1000 + len(same)))

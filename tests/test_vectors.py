"""The store of vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstead.operators import vectors


def brute(points, keys, asked, k, kept=None):
    out = []
    for q in asked:
        score = np.round(points @ points[keys.index(q)], 9)
        rows = sorted((-s, x) for s, x in zip(score, keys, strict=True) if x != q and (kept is None or x in kept))
        out += [(q, x, -s, i) for i, (s, x) in enumerate(rows[:k], 1)]
    return sorted(out)


def table(spark, points, keys):
    rows = [(k, p.tolist()) for k, p in zip(keys, points, strict=True)] + [(10**6, None)]
    return spark.createDataFrame(rows, "id long, v array<double>").withColumns({"cell": F.lit("x"), "off": F.lit(1), "key": F.lit(2)})


def close(got, want):
    got = sorted((r.query, r.key, r.score, r["rank"]) for r in got.collect())
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-8)


@pytest.mark.parametrize("k,probe,size", [(3, 1, 5), (10, 2, 8192), (1, 4, 50), (400, 1, 64)])
def test_exact_way(spark, tmp_path, monkeypatch, k, probe, size):
    monkeypatch.setattr(vectors, "ROWS", size)
    rng = np.random.default_rng(k)
    points = np.round(rng.normal(size=(300, 6)) + 4 * rng.integers(0, 2, (300, 6)), 3)
    points[40:60] = points[40]  # ties
    keys, at = list(range(300)), f"file://{tmp_path}/store"
    every = table(spark, points, keys)
    vectors.write_store(every.where("id < 200 or id = 1000000"), "id", "v", at, cells=9)
    vectors.append(every.where("id >= 200"), "id", "v", at)
    close(vectors.search(every.where("id % 10 = 0"), "id", "v", at, f"file://{tmp_path}/a", k, probe), brute(points, keys, range(0, 300, 10), k))
    some = vectors.search(every.where("id % 10 = 0"), "id", "v", at, f"file://{tmp_path}/b", k, probe, where=lambda d: d.where("key % 3 = 0"))
    close(some, brute(points, keys, range(0, 300, 10), k, {i for i in keys if i % 3 == 0}))


def test_quick_way_on_the_provided_vectors(spark, data, tmp_path):
    """Recall of the ten nearest, three cells of four looked into: these vectors have no clusters."""
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    found = rows.orderBy("vec_id").collect()
    keys, points = [r.vec_id for r in found], np.array([r.embedding for r in found], float)
    at, asked = f"file://{tmp_path}/store", [k for k in keys if k % 10 == 0]
    vectors.write_store(rows, "vec_id", "embedding", at, cells=16)
    got = vectors.search(rows.where("vec_id % 10 = 0"), "vec_id", "embedding", at, f"file://{tmp_path}/w", 10, probe=12, exact=False).collect()
    want = {(q, x) for q, x, _, _ in brute(points, keys, asked, 10)}
    recall = len(want & {(r.query, r.key) for r in got}) / len(want)
    assert recall >= 0.9


def test_quick_way_on_clusters(spark, tmp_path):
    """Recall with one cell of eight looked into, and how few cells the exact way adds."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(16, 32))
    points = centres[rng.integers(0, 16, 1600)] + 0.1 * rng.normal(size=(1600, 32))
    points /= np.linalg.norm(points, axis=1)[:, None]
    keys, at = list(range(1600)), f"file://{tmp_path}/store"
    every = table(spark, points, keys)
    vectors.write_store(every, "id", "v", at, cells=16)
    asked = every.where("id % 40 = 0")
    got = vectors.search(asked, "id", "v", at, f"file://{tmp_path}/w", 10, probe=2, exact=False).collect()
    want = brute(points, keys, range(0, 1600, 40), 10)
    assert len({w[:2] for w in want} & {(r.query, r.key) for r in got}) >= 0.9 * len(want)
    close(vectors.search(asked, "id", "v", at, f"file://{tmp_path}/x", 10, probe=2), want)
    fitted = vectors._centres(spark, at)
    far = dict(vectors.open_store(spark, at).groupBy("cell").agg(F.max("off")).collect())
    radius = np.array([far.get(c, -1.0) for c in range(len(fitted))])
    first = spark.read.parquet(f"{tmp_path}/x/first").groupBy("query").agg(F.min("score").alias("least")).withColumnRenamed("query", "key")
    more = asked.select(F.col("id").alias("key"), F.col("v").alias("vector")).join(first, "key")
    assert vectors._cells_of(more, fitted, radius, 2, others=True).count() < 0.3 * 40 * len(fitted)


def test_odd_rows(spark, tmp_path):
    none = spark.createDataFrame([], "id string, v array<float>")
    at = f"file://{tmp_path}/none"
    vectors.write_store(none, "id", "v", at)
    asked = spark.createDataFrame([("a", [1.0, 2.0])], "id string, v array<float>")
    assert vectors.search(asked, "id", "v", at, f"file://{tmp_path}/w").collect() == []
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, 1.0]), ("b", [2.0, 0.0]), ("c", None)], "id string, v array<float>")
    at = f"file://{tmp_path}/some"
    vectors.write_store(rows, "id", "v", at)
    got = vectors.search(rows.where("id = 'a'"), "id", "v", at, f"file://{tmp_path}/x", 5)
    assert [(r.key, r.score) for r in got.orderBy("rank").collect()] == [("b", 2.0), ("b", 0.5)]
    with pytest.raises(Exception, match="2 numbers"):
        vectors.append(spark.createDataFrame([("d", [1.0])], "id string, v array<float>"), "id", "v", at)

"""Places in an order against sorting on the driver."""

import random

from pyspark.sql import functions as F

from loomstead.operators import numbering


def test_places_with_ties_and_nulls(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice(["a", "b", None]), i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, part string, tie int").repartition(7)
    got = numbering.numbered(df, f"file://{tmp_path}/a", F.desc("k"), "part")
    assert got.columns == ["k", "part", "tie", "place"] and "SinglePartition" not in got._jdf.queryExecution().toString()
    found = sorted(got.collect(), key=lambda r: r.place)
    assert [r.place for r in found] == list(range(1, 501))
    order = [(r.k is None, -(r.k or 0), r.part is not None, r.part or "") for r in found]
    assert order == sorted(order)
    assert sorted(map(repr, (tuple(r)[:3] for r in found))) == sorted(map(repr, rows))


def test_equal_rows_are_spread(spark, tmp_path):
    df = spark.range(4000).select(F.lit(7).alias("k")).repartition(8)
    got = numbering.numbered(df, f"file://{tmp_path}/a", "k")
    assert sorted(r.place for r in got.collect()) == list(range(1, 4001))
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/a").groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2500


def test_tables_of_different_length(spark, tmp_path):
    a, b = spark.createDataFrame([(3, "c"), (1, "a")], "i int, place string"), spark.createDataFrame([(9,), (8,), (7,)], "i int")
    got = sorted(numbering.by_position(a, b, "i", F.desc("i"), f"file://{tmp_path}").collect())
    assert [(r.place, r.a and tuple(r.a), r.b.i) for r in got] == [(1, (1, "a"), 9), (2, (3, "c"), 8), (3, None, 7)]
    assert numbering.numbered(a.limit(0), f"file://{tmp_path}/none", "i").count() == 0

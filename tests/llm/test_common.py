"""Intermediate tables: what stays, what goes."""

import glob

from pyspark.sql import functions as F

from loomstead.llm.common import Workspace


def files(work):
    return sorted({p.rsplit("/", 2)[1] for p in glob.glob(f"{work.root.removeprefix('file://')}/*/*.parquet")})


def test_tables_go_when_they_are_no_longer_read(spark):
    work = Workspace(spark, "t")
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    df = spark.range(100).withColumn("k", F.col("id") % 7)
    a = work.save(df.groupBy("k").count(), "a")
    b = work.save(df, "b", by="k")
    assert a.count() == 7 and b.where("k = 3").count() == 14 and set(b.columns) == {"id", "k"}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before
    c = work.save_bucketed(df, "c", "k")
    assert "Exchange" not in c.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert c.count() == 100 and any("loomstead_c_" in t.name for t in spark.catalog.listTables())
    work.keep("a")
    assert files(work) == ["a"] and not any("loomstead_c_" in t.name for t in spark.catalog.listTables())
    out = work.finish(a.where("k > 2"), "last")
    assert out.count() == 4 and files(work) == ["last"]
    work.close()
    assert files(work) == []

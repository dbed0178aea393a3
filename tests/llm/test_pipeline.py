"""Every stage of the pipeline against a plain version of its decision."""

import os
import sys
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from loomstead.llm import decontaminate, quality, toxicity
from loomstead.llm.common import Workspace

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_decontaminate import brute as contamination  # noqa: E402
from test_jaccard import brute as near  # noqa: E402
from test_native import counts  # noqa: E402


def test_stages(spark, data):
    sf = data
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.limit(3).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    docs = Workspace(spark, "t").save(docs.unionByName(more).withColumn("n_hit", F.lit("x")).withColumn("row", F.lit(1)).withColumn("score", F.lit(2)), "docs")
    seen = [docs]
    for i, (_, stage) in enumerate(cp.STAGES):
        seen.append(Workspace(spark, "t").save(stage(spark, seen[-1], sf), f"s{i}"))
    for a, b in zip(seen[:4], seen[1:5], strict=True):
        assert a.columns == b.columns and 0 < b.count() <= a.count()
        assert b.exceptAll(a).count() == 0  # rows come through as they are
    rows = [[(r.doc_id, r.text) for r in x.select("doc_id", "text").collect()] for x in seen[:5]]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert Counter(i for i, _ in rows[1]) == Counter(i for i, _ in rows[0] if scored[i] < 0.5)
    # too few labels here for a cutoff, so the fixed rules alone decide
    fine = lambda c: c[0] >= 50 and 100 * c[4] <= 50 * c[0]
    assert Counter(rows[2]) == Counter(r for r in rows[1] if fine(counts(r[1])))
    heads = {i: c for i, _, c in near(rows[2])}
    want = Counter({r: 1 for r in rows[2] if r[0] is not None and heads[r[0]] == r[0]}) + Counter(r for r in rows[2] if r[0] is None)
    assert Counter(rows[3]) == want
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.hits(decontaminate.find_contamination(seen[3], spark.read.parquet(f"{sf}/benchmark.parquet"))).collect()}
    for i, t in rows[3][:25]:
        assert found[i] == contamination(t, bench)[:2]
    assert Counter(rows[4]) == Counter(r for r in rows[3] if not (found[r[0]][1] and 20 * found[r[0]][1] >= found[r[0]][0]))
    assert {r.doc_id for r in seen[5].select("doc_id").collect()} == {i for i, _ in rows[4]}


def test_quality_carries_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 5, 6)], "doc_id long, text string, lang string, n_words int, row int")
    assert quality.measure(docs, carry=True).select("row.*").columns == docs.columns

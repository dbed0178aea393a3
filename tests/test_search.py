"""The stored word index against plain BM25."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomstead.operators import search


def plain(rows, queries, k, k1=1.5, b=0.75):
    docs = [(i, Counter(re.findall("[a-z0-9]+", (t or "").lower()))) for i, t in rows]
    mean = sum(c.total() for _, c in docs) / max(len(docs), 1)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for q, terms in queries.items():
        scored = []
        for i, c in docs:
            held = [t for t in terms if c[t]]
            if held:
                score = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * c.total() / mean)) for t in held)
                scored.append((-round(score, 6), i))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k,probe,block", [(3, 1, 4), (10, 2, 128), (1, 3, 2), (50, 1, 4)])
def test_against_plain(spark, tmp_path, monkeypatch, k, probe, block):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "PARTS", 4)
    rng = random.Random(k)
    words = [f"w{i}" for i in range(60)] + ["The", "É"]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([5, 20, 62])]) for _ in range(rng.randint(0, 40))) if i % 17 else None) for i in range(200)]
    rows += [(500, "rare words alone"), (501, "w1 " * 300), (501, "w1 w2 rare")]
    queries = {q: {rng.choice(words).lower() for _ in range(rng.randint(1, 8))} for q in range(12)} | {90: {"rare"}, 91: {"nowhere"}, 92: {""}}
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, part string, row int").repartition(3)
    search.write_index(docs, "doc_id", "text", f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query int, term string")
    got = search.search(spark, f"file://{tmp_path}/index", asked.union(asked), f"file://{tmp_path}/work", k, probe).collect()
    assert sorted((r.query, r["rank"], r.doc, round(r.score, 5)) for r in got) == [(q, n, d, round(s, 5)) for q, n, d, s in plain(rows, queries, k)]


def test_blocks_that_cannot_win_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 8)
    rows = [(i, "common " * 3 + ("special " * 5 if i == 77 else "") + f"x{i}") for i in range(400)]
    at = f"file://{tmp_path}/index"
    search.write_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "doc_id", "text", at)
    got = search.search(spark, at, spark.createDataFrame([(1, "common"), (1, "special")], "query int, term string"), f"file://{tmp_path}/work", 1)
    assert [(r.doc, r["rank"]) for r in got.collect()] == [(77, 1)]
    bounds = spark.read.parquet(f"{tmp_path}/work/bounds").orderBy(F.desc("bound")).collect()
    assert len(bounds) == 50 and bounds[1].bound < bounds[0].bound / 5


def test_nothing(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    search.write_index(spark.createDataFrame([], "doc_id string, text string"), "doc_id", "text", at)
    assert search.search(spark, at, spark.createDataFrame([(1, "a")], "query int, term string"), f"file://{tmp_path}/work").collect() == []


def test_the_index_is_not_shuffled(spark, tmp_path):
    """Tasks write their own blocks; a search moves the rows of the words asked for alone."""
    rows = [(i, " ".join(f"w{i * 7 + j}" for j in range(200)) + (" asked" if i % 9 == 0 else "")) for i in range(600)]
    sc, at = spark.sparkContext, f"file://{tmp_path}/index"
    sc.setJobGroup(at, "index")
    search.write_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), "doc_id", "text", at)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(at)]
    sc.setJobGroup("", "")
    assert jobs and all(len(j.stageIds) == 1 for j in jobs)
    got = search.search(spark, at, spark.createDataFrame([(1, "asked")], "query int, term string"), f"file://{tmp_path}/work", 3).collect()
    assert [r.doc for r in got] == [0, 9, 18]
    wanted = spark.read.parquet(f"{tmp_path}/work/wanted")
    assert {r.term for r in wanted.collect()} == {"asked"} and wanted.count() < 10 < search.open_index(spark, at).count()

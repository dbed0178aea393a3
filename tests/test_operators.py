"""Hand-written rows for the table operators."""

import numpy as np
from pyspark.sql import functions as F

from loomstead.operators import derive, evaluate, fuse, profile, retrieve, windows


def test_evaluation_invariants(spark):
    rows = [("a", "f", "x", "X"), ("b", "f", "y", None), ("c", "f", None, "z"), ("d", "f", "n/a", " NR "), ("e", "f", "p, q", "q;p"), ("f", "g", None, None)]
    long = spark.createDataFrame(rows, "key string, field string, gold string, pred string")
    f, g = sorted(evaluate.two_stage(long, tokens=True).collect(), key=lambda r: r.field)
    assert (f.total_rows, f.available_gold, f.pred_present, f.tp, f.fp, f.fn, f.correct) == (5, 3, 3, 2, 1, 1, 2)
    assert f.tp + f.fn == f.available_gold
    assert (g.precision, g.recall, g.f1, g.coverage_ceiling) == (0.0, 0.0, 0.0, 0.0)
    assert evaluate.two_stage(long).where("field = 'f'").first().correct == 0  # exact: case and order count
    scores = {r.field: r for r in evaluate.set_scores(long).collect()}
    assert (scores["g"].precision, scores["g"].recall) == (1.0, 1.0)
    assert scores["__MICRO__"].tp == scores["f"].tp == 2
    v = evaluate.compare_versions(long).where("field = 'f'").first()
    assert v.improved - v.degraded == v.missing_before - v.missing_after


def test_pairs_fan_out_and_last_wins(spark):
    a = spark.createDataFrame([("k", "1", 0), ("k", "2", 1)], "key string, v string, n int")
    assert evaluate.pairs(a, a, "key", ["v"]).count() == 4
    assert [r.v for r in evaluate.last_wins(a, F.col("key"), "n").collect()] == ["2"]


def test_fusion(spark):
    df = spark.createDataFrame([("k", v, i) for i, v in enumerate(["b", "a", "a", "b", " N/A ", None])] + [("e", "", 9)], "key string, v string, i int")
    assert [tuple(r) for r in fuse.vote(df, "key", "v", "i").collect()] == [("k", "b", 2)]  # tie: first seen
    one = spark.createDataFrame([("k", "x, y", 0)], "key string, v string, i int")
    r = fuse.fuse_table(one, "key", [], ["v"], "i").first()
    assert (r.v, r["v__strength"]) == ("x, y", 1)
    best = fuse.best_row(df, F.col("key"), [F.lit(1)], "i").where("key = 'k'").first()
    assert best.i == 0
    table = [("old", "new", True), ("old", "new", False), ("", "new", False), ("old", "", True), (None, None, None)]
    t = spark.createDataFrame(table, "p string, n string, s boolean")
    strict, hybrid = ([r[0] for r in t.select(fuse.choose_fill(F.col("p"), F.col("n"), F.col("s"), s)).collect()] for s in (True, False))
    assert strict == ["new", "old", "new", "old", None] and hybrid == ["new", "new", "new", "old", None]


def test_windows(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 60, 70), (1, 121, 130), (1, 5, 8), (2, 3, 4)], "doc_id int, st int, en int")
    assert sorted((r.doc_id, r.st, r.en) for r in windows.merge_spans(spans).collect()) == [(1, 0, 70), (1, 121, 130), (2, 3, 4)]
    d = spark.createDataFrame([(1, "x" * 1700), (2, ""), (3, "Cue" + "." * 80 + "end"), (4, "an end" + "." * 70 + "cue"), (5, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.start, len(r.chunk)) for r in windows.chunks(d, "doc_id", "text").where("doc_id = 1").collect()) == [(1, 0, 1600), (1, 800, 900), (1, 1600, 100)]
    assert windows.chunks(d, "doc_id", "text").where("doc_id = 2").count() == 0
    hits = {r.doc_id: r.labels for r in windows.anchored(d, "doc_id", "text", {"c": "cue"}, "end").collect()}
    assert hits[3] == [] and hits[4] == ["c"] and hits[5] == []  # the anchor must fit into the window
    parts = spark.createDataFrame([(1, i, t) for i, t in enumerate(["aaaa", "", "bbbb", "cccc"])], "k int, i int, t string")
    assert [r.t for r in windows.budget(parts, "k", "i", "t", 8).orderBy("i").collect()] == ["aaaa", "", "bbbb"]
    assert [r.t for r in windows.budget(parts, "k", "i", "t", 7, cut_last=True).orderBy("i").collect()] == ["aaaa", "", "bbb"]


def test_record_rules(spark):
    cols = "vlm vision language fusion objectives train eval_ model family rag klass".split()
    rows = [
        ("", "ViT", "BERT", "", "", "A", "", "", "", "", ""),
        ("", "ViT", "", "", "x", "", "", "M", "", "", ""),
        ("", "", "BERT", "Not reported", "", "", "B", "", "", "yes", ""),
        ("", "", "", "", "", "", "", "", "BLIP-2", "", ""),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    a, b, c, d = derive.clean_record(df, [("m", "Fam")], ["blip"]).collect()
    assert (a.klass, a.fusion, a.objectives, a.eval_, a.model) == ("VLM", "cross-attention", "contrastive, ITM", "A", "BERT, ViT")
    assert (b.klass, b.fusion, b.family) == ("Vision-only", "", "Fam")
    assert (c.klass, c.fusion, c.objectives, c.train, c.rag) == ("Text-only", "Not applicable", "Not applicable", "B", "Yes")
    assert (d.klass, d.model) == ("VLM", "BLIP-2")


def test_record_rules_by_family(spark):
    cols = "vlm vision language fusion objectives train eval_ model family rag klass title".split()
    rows = [
        ("", "", "", "", "", "", "", "Transformer", "LLaVA", "", "", "report retrieval"),
        ("", "", "", "", "n/a", "", "", "", "Flamingo", "", "", "retrieval of reports"),
        ("", "CLIP", "", "", "", "", "", "lstm + Transformer", "", "", "", "no learned retrieval, a retriever"),
        ("yes", "", "", "", "", "", "", "MiniGPT-4, GPT-2", "", "", "", None),
        ("", "", "", "", "", "", "", "CXR-IRGen", "", "", "", ""),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    lexicon = [(r"\bllava\b", "LLaVA"), (r"\bflamingo\b", "Flamingo"), (r"\bminigpt-4\b", "MiniGPT-4"), (r"\bclip\b", "CLIP")]
    a, b, c, d, e = derive.clean_record(df, lexicon, ["llava", "flamingo", "minigpt-4"]).collect()
    assert (a.model, a.objectives, a.rag, a.klass) == ("LLaVA, Transformer", "contrastive", "Yes", "VLM")
    assert (b.model, b.objectives, b.rag) == ("Flamingo", "ITM", "")
    assert (c.model, c.objectives, c.rag) == ("CLIP, lstm, Transformer", "", "")  # a denial leaves the cell empty
    assert (d.model, d.objectives, d.family) == ("MiniGPT-4, GPT-2", "contrastive", "MiniGPT-4")
    assert (e.klass, e.objectives) == ("", "contrastive, ITM")  # not a VLM by its cells


def test_retrieval(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 8)).round(3)
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "vec_id long, embedding array<double>").repartition(4)
    q = df.where("vec_id in (3, 50)")
    got = {(r.query, r["rank"]): r.key for r in retrieve.top_k(q, df, "vec_id", "embedding", 5, block=1).collect()}
    for i in (3, 50):
        s = v @ v[i]
        want = sorted((j for j in range(120) if j != i), key=lambda j: (-round(s[j], 9), j))[:5]
        assert [got[i, r] for r in range(1, 6)] == want
    near = [r.key for r in retrieve.mmr(q, df, "vec_id", "embedding", 3, 10, 1.0).where("query = 50").orderBy("rank").collect()]
    assert near == [got[50, r] for r in (1, 2, 3)]  # weight one is plain similarity
    spread = [r.key for r in retrieve.mmr(q, df, "vec_id", "embedding", 5, 60, 0.2).where("query = 50").orderBy("rank").collect()]
    assert spread[0] == near[0] and spread != [got[50, r] for r in range(1, 6)]


def test_profiles(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "x"), (3, "n/a")], "k int, v string")
    assert {r.part: r.n for r in profile.alignment({"a": a, "b": b}, "k").collect()} == {"a": 2, "b": 2, "a&b": 1}
    assert [r.k for r in profile.only_in(a, b, "k").collect()] == [1]
    assert profile.diversity(a, b, ["v"]).first()[1:] == (2, 1, -1)
    docs = spark.createDataFrame([("p", "has a license"), ("q", None)], "File string, text string")
    filled = spark.createDataFrame([("q", "v", ""), ("z", "-", "w")], "File string, lic string, other string")
    m = {r.key: (r.lic, r.other) for r in profile.availability_mask(docs, "File", "text", {"lic": "license", "other": "zzz"}, filled).collect()}
    assert m == {"p": (1, 0), "q": (1, 0), "z": (0, 1)}

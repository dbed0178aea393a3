"""Rules that SQL expresses badly, against small known texts."""

import pytest
from pyspark.sql import functions as F

from loomstead.functions import lexicon, stats
from loomstead.operators import context, mine, normalize, report
from loomstead.sources import readers, writers

PAPER = """Journal of Tests, University of X
A long title about chest reports that
goes on over a second line
Anna Maria Smith, Bob Jones and Carl-Peter Stone
Department of Things, City
Abstract
We propose CXR-IRGen, a model. Unlike ALBEF it trains with a contrastive loss term. BLIP came first.
"""


def one(spark, text, **columns):
    df = spark.createDataFrame([(1, text)], "id long, t string")
    return df.select(*[c.alias(n) for n, c in columns.items()]).first()


def test_title_and_authors(spark):
    t = mine.title(F.col("t"))
    r = one(spark, PAPER, title=t["title"], at=t["at"], authors=mine.authors(F.col("t"), t["at"] + 1))
    assert r.title == "A long title about chest reports that goes on over a second line Anna Maria Smith, Bob Jones and Carl-Peter Stone"
    assert r.at == 1
    assert r.authors == "Anna Maria Smith, Bob Jones, Carl-Peter Stone"
    r = one(spark, "nothing\nby John Little", title=t["title"], at=t["at"], authors=mine.authors(F.col("t"), t["at"]))
    assert (r.title, r.at) == (None, -1)
    assert one(spark, "", a=mine.authors(F.col("t"), F.lit(-1))).a == "Not reported"


def test_names_and_objectives(spark):
    r = one(spark, PAPER, models=mine.models_near(F.col("t"), width=0), far=mine.models_near(F.col("t")), objectives=mine.objectives_in(F.col("t")))
    assert r.models == r.far == "ALBEF, BLIP, CXR-IRGen"
    assert one(spark, "MRI and T5, and R2Gen", m=mine.models_near(F.col("t"), ("MRI", "R2Gen"))).m == "R2Gen"
    assert r.objectives == "contrastive"
    assert one(spark, "training loss near the BLEU metric", o=mine.objectives_in(F.col("t"), ())).o == "Not reported"


def test_windows_by_plain_search(spark):
    text = "xx ab yy AB zz ab" * 3
    got = one(spark, text, w=mine.windows(F.col("t"), "(?i)ab", 4)).w
    at, want = text.lower().find("ab"), []
    while at >= 0:
        want.append(text[max(0, at - 4) : at + 6])
        at = text.lower().find("ab", at + 2)
    assert got == want
    assert one(spark, "", w=mine.first_windows(F.col("t"), ["a"])).w == []


def test_recursive_split(spark):
    rows = [("a", "one two three\n\nfour five\nsix " + "x" * 50), ("b", ""), ("c", None), ("d", "short")]
    df = spark.createDataFrame(rows, "id string, t string")
    got = {}
    for r in context.split_recursively(df, "id", "t", 20, 8).collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert all(len(c) <= 20 for cs in got.values() for c in cs)
    assert got["d"] == ["short"] and set(got) == {"a", "d"}
    for word in "one two three four five six".split():
        assert any(word in c for c in got["a"])
    assert sum(c.count("x") for c in got["a"]) >= 50


def test_whole_items(spark):
    docs = spark.createDataFrame([(1, "The CAT sat on a mat"), (2, None), (3, "cat")], "id long, text string")
    items = spark.createDataFrame([(10, " cat "), (11, "sat on"), (12, ""), (13, None), (14, "Cat")], "item long, text string")
    got = {(r.doc_id, r.item_id) for r in lexicon.whole_items(docs, items, "id", "item").collect()}
    assert got == {(1, 10), (1, 11), (1, 14), (3, 10), (3, 14)}
    with pytest.raises(ValueError):
        lexicon.whole_items(docs, items, "id", "item", max_chars=2)


def test_cells(spark):
    cases = {
        normalize.vlm_cell: {"VLM  (a,b)": "VLM (a, b)", "yes": "Yes", "0": "No", None: "Not reported", "maybe": "maybe"},
        normalize.rag_cell: {"no retriever": "", "RAG": "Yes", "dense retrieval": "Yes", None: "", "n/a": "", "other": ""},
        normalize.family_cell: {"blip v2 and clip": "BLIP-2, CLIP", None: "", "not reported": ""},
        normalize.single_token: {"a b, c": "a b", "one two three four five six seven": "Not reported", None: "", "x and y": "x"},
        normalize.modality: {"X-ray": "X-Ray", " xray ": "X-Ray", "PET": "Not reported", None: "Not reported"},
    }
    for f, pairs in cases.items():
        df = spark.createDataFrame([(k,) for k in pairs], "c string")
        assert {r.c: r.out for r in df.select("c", f(F.col("c")).alias("out")).collect()} == pairs, f.__name__
    df = spark.createDataFrame([(["bleu4", " BLEU", "", "own"],), ([],), (None,)], "m array<string>")
    assert [r.m for r in normalize.normalize_lists(df.withColumnRenamed("m", "metrics")).withColumnRenamed("metrics", "m").collect()] == [["BLEU", "own"], ["Not reported"], ["Not reported"]]
    assert [r.x for r in df.limit(1).select(normalize.drop_placeholders(F.array(F.lit("list"), F.lit("k"), F.lit("string or null"))).alias("x")).collect()] == [["k"]]


def test_contexts(spark):
    parts = spark.createDataFrame([(1, 0, "aa", "body"), (1, 1, "bb", "related"), (2, 0, "cc", "references")], "k long, i int, t string, s string")
    assert {(r.k, r.i) for r in context.prefer_sections(parts, "k", "i", "s").collect()} == {(1, 0), (2, 0)}
    assert {r.k: r.context for r in context.compile_context(parts, "k", "i", "t", 5, "-").collect()} == {1: "aa-bb", 2: "cc"}
    a, b = parts.where("i = 1").withColumn("rank", F.lit(1)), parts.withColumn("rank", F.col("i") + 1)
    assert [(r.k, r.i, r["rank"]) for r in context.blend("k", "i", 2, a, b).orderBy("k", "rank").collect()] == [(1, 1, 1), (1, 0, 2), (2, 0, 1)]
    assert {(r.k, r.level) for r in context.fallback("k", a, b).collect()} == {(1, 0), (2, 1)}
    assert parts.select(context.char_budget(100, "dense").alias("n")).first().n == 350


def test_mcnemar_by_plain_sums(spark):
    import math

    pairs = [(0, 0), (1, 0), (3, 5), (40, 70), (63, 64), (64, 65), (500, 560), (100_000, 101_000), (2_000_000_000, 2_000_100_000)]
    for r in spark.createDataFrame(pairs, "b long, c long").withColumn("p", stats.mcnemar("b", "c")).collect():
        n, k = r.b + r.c, min(r.b, r.c)
        if n == 0:
            assert r.p is None
        elif n <= 2000:
            assert r.p == pytest.approx(min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n), rel=1e-9)
        else:  # the normal distribution is close here
            z = (k + 0.5 - n / 2) / (math.sqrt(n) / 2)
            assert r.p == pytest.approx(math.erfc(-z / math.sqrt(2)), rel=0.02)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"a": "what", "b": ["x"]}')
    assert readers.read_config(spark, str(tmp_path / "p.json")) == {"a": "what", "b": ["x"]}
    df = spark.createDataFrame([("d1", "one", [1.0]), ("d2", "two", [2.0]), ("d1", "three", [3.0])], "doc_id string, chunk string, v array<double>")
    writers.write_vectors(df, str(tmp_path / "store"), buckets=8)
    assert {r.chunk for r in readers.read_vectors(spark, str(tmp_path / "store"), "d1", buckets=8).collect()} == {"one", "three"}
    assert [r.doc_id for r in readers.document_ids(readers.read_vectors(spark, str(tmp_path / "store"))).collect()] == ["d1", "d2"]
    writers.write_json(df, str(tmp_path / "j"), "doc_id")
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    writers.dump(df, str(tmp_path / "dump"), ["chunk"], 2)
    assert {r.chunk for r in spark.read.json(str(tmp_path / "dump")).collect()} == {"on", "tw", "th"}
    ids = spark.createDataFrame([("d",), ("zz",)], "key string")
    got = {r.key: r.text for r in readers.match_documents(ids, df.withColumnRenamed("chunk", "text").where("text <> 'three'")).collect()}
    assert got == {"d": "one\ntwo", "zz": None}
    assert readers.optional_csv(spark, None, ["File", "x"]).count() == readers.optional_csv(spark, str(tmp_path / "no"), ["File", "x"]).count() == 0
    (tmp_path / "s.csv").write_text("File,x\na,1\na,2\n")
    assert [tuple(r) for r in readers.optional_csv(spark, str(tmp_path / "s.csv"), ["File", "x"]).collect()] == [("a", "2")]
    (tmp_path / "r" / ".git").mkdir(parents=True)
    for f in ("r/a.pdf", "r/.git/b.pdf", "r/c.txt"):
        (tmp_path / f).write_text("x")
    assert [r.name for r in readers.find_files(spark, str(tmp_path / "r")).collect()] == ["a.pdf"]
    paths = report.write_by_field(spark.createDataFrame([("a/b", 1), ("c d", 2)], "field string, n int"), str(tmp_path / "f"))
    assert {k: p.rpartition("/")[2] for k, p in paths.items()} == {"a/b": "a-b", "c d": "c_d"}
    assert spark.createDataFrame([("é",)], "t string").select(readers.normalized(F.col("t")).alias("n")).first().n == "é"

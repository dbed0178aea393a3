"""Very long texts, ids of other types, clashing columns, and thresholds that reject, for all operators."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from loomstead.llm import chat, decontaminate, jaccard, katz, packing, pages, quality, queries, tokens, toxicity, urls
from loomstead.llm.common import Workspace

WORDS = 120_000


def long_text(seed=0):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 50_000, WORDS))


def test_very_long_texts(spark):
    text = long_text()
    near = text.replace("w7 ", "changed ")
    docs = spark.createDataFrame([(1, text, "en"), (2, near, "en"), (3, "short", "en"), (4, None, None)], "doc_id long, text string, lang string")
    m = {r.doc_id: r for r in quality.measure(docs).collect()}
    words = text.split()
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = {w for w in windows if windows.count(w) > 1} if len(set(windows)) < len(windows) else set()
    hit = {j for i, w in enumerate(windows) if w in often for j in (i, i + 1, i + 2)}
    assert (m[1].n_words, m[1].n_repeat_words, m[4].n_words) == (WORDS, len(hit), 0)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, Workspace(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    item = " ".join(text.split()[WORDS // 2 : WORDS // 2 + 20])
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    found = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.hits(decontaminate.find_contamination(docs, bench, shard_words=50_000)).collect()}
    assert found[1] == (20, [9]) and found[3] == (0, [])
    pieces = packing.pack_documents(docs, Workspace(spark, "t"), tokens.default_path()).where("doc_id = 1").collect()
    assert sum(p.length for p in pieces) == pieces[0].doc_tokens > WORDS
    assert {r.doc_id: r.n_tokens for r in katz.score_documents(docs, Workspace(spark, "t"), order=3).collect()} == {1: WORDS + 1, 2: WORDS + 1, 3: 2, 4: 1}
    model = toxicity.fit(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).count() == 4
    page = spark.createDataFrame([(1, "http://a.org/" + "x" * 100_000, f"<article><p>{text}</p></article>" + "<p></p>" * 1000)], "page_id long, url string, html string")
    assert pages.extract(page).first().text == text
    seen = page.withColumn("fetched_at", F.expr("timestamp'2024-01-01 00:00:00'"))
    none = spark.createDataFrame([], "kind string, key string, category string, action string, listed_at timestamp")
    assert urls.filter_captures(seen, urls.validity(none)).first().host == "a.org"
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_conversations(turns)).first().loss_chars == len(text)


def test_ids_keep_their_type_and_columns_may_clash(spark):
    rows = [("a", "one two three", "en", 1), ("b", "one two three", "en", 2), (None, "x", None, 3), ("b", None, "en", 4)]
    clash = "part number h crc row rows items ranges key sig lead size path set own place length stratum words keys met bits block kind".split()
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, n_words int").withColumns({c: F.lit("clash") for c in clash})
    bench = spark.createDataFrame([("i", "two three")], "item_id string, text string")
    found = decontaminate.hits(decontaminate.find_contamination(docs, bench, carry=True)).collect()
    assert sorted((r.doc_id or "", r.n_hit, tuple(r["items"])) for r in found) == [("", 0, ()), ("a", 2, ("i",)), ("b", 0, ()), ("b", 2, ("i",))]
    assert decontaminate.keep_uncontaminated(docs, bench).columns == docs.columns
    packed = packing.pack_documents(docs, Workspace(spark, "t"), tokens.default_path()).collect()
    assert sorted(p.doc_id or "" for p in packed) == ["", "a", "b", "b"]
    assert sorted(r.doc_id or "" for r in katz.score_documents(docs, Workspace(spark, "t")).collect()) == ["", "a", "b", "b"]
    html = spark.createDataFrame([("p", "http://a.org", "<p>t</p>", 1, 2, 3)], "page_id string, url string, html string, host int, key int, mark int")
    assert [tuple(r) for r in pages.extract(html).select("page_id", "text").collect()] == [("p", "t")]
    kept = quality.keep_good(docs, spark.createDataFrame([], "doc_id string, quality int"), Workspace(spark, "t"))
    assert kept.columns == docs.columns and kept.count() == 0
    numbered = docs.withColumn("doc_id", F.when(F.col("doc_id") == "a", 1).when(F.col("doc_id") == "b", 2))
    assert jaccard.keep_one_of_each(numbered, Workspace(spark, "t")).columns == docs.columns
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(numbered, Workspace(spark, "t")).collect()} == {(1, 1), (2, 1), (None, None)}


def test_thresholds_that_reject_against_sql(spark, tmp_path):
    """A holdout large enough for cutoffs in one language and too small in another; the SQL must choose and reject the same."""
    rng = np.random.default_rng(5)
    rows, marks = [], []
    for i in range(5000):
        lang = "en" if i % 5 else "fr"
        good = i % 2 == 0
        noise = int(rng.integers(0, 30)) if not good or i % 400 == 0 else 0
        text = " ".join(f"w{i}x{j}" for j in range(60)) + " #" * noise + ("\nsame line" * int(rng.integers(0, 3)) if not good else "")
        rows.append((i, text, lang))
        if i % 3:
            marks.append((i, int(good)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: (r.base_failed, r.kept) for r in queries.QUERIES["op5_quality_rules"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(f"select doc_id, base_failed, kept from ({queries.ORACLE_SQL['op5_quality_rules']})").fetchall()
    assert got == {i: (b, k) for i, b, k in want}
    rejected = [i for i, (b, k) in got.items() if not b and not k]
    assert len(rejected) > 500 and all(i % 5 for i in rejected)
    assert sum(i % 2 == 0 for i in rejected) <= 0.05 * 2000
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.keep_good(docs, labels, Workspace(spark, "t")).collect()}
    assert kept == {i for i, (_, k) in got.items() if k}

"""Retrieval within documents that have no words."""

from loomstead.operators import context, retrieve


def test_documents_without_words(spark, tmp_path):
    rows = [("a", 0, "¡…! –"), ("a", 1, "é ß"), ("b", 0, "que license"), ("b", 1, "!"), ("c", 0, None), ("d", 0, "")]
    parts = spark.createDataFrame(rows, "doc_id string, chunk_id int, chunk string")
    best = context.bm25_within(parts, "doc_id", "chunk_id", "chunk", ["license", "que"])
    assert [(r.doc_id, r.chunk_id, r["rank"]) for r in best.collect()] == [("b", 0, 1)]
    padded = context.blend("doc_id", "chunk_id", 5, best, parts.withColumn("rank", parts.chunk_id + 1))
    assert sorted((r.doc_id, r["rank"], r.chunk_id) for r in padded.collect()) == [("a", 1, 0), ("a", 2, 1), ("b", 1, 0), ("b", 2, 1), ("c", 1, 0), ("d", 1, 0)]
    assert retrieve.bm25(parts.where("doc_id <> 'b'"), "doc_id", "chunk", ["license"], f"file://{tmp_path}/work").collect() == []

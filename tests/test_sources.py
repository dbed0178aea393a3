"""Files in and out, and incremental ingestion."""

import json

from pyspark.sql import functions as F

from loomstead.sources import readers, writers
from loomstead.streaming import ingest, windowed_counts


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('File,Model,Odd\nx,"a ""b"", c",1\ny\nz,"two\nlines",\n')
    out = readers.read_csv(spark, str(tmp_path / "a.csv"), ["File", "Model", "RAG"], fill=True).collect()
    assert [tuple(r) for r in out] == [("x", 'a "b", c', ""), ("y", "", ""), ("z", "two\nlines", "")]
    writers.write_csv(spark.createDataFrame([("f", 'q,"r"')], "File string, Model string"), str(tmp_path / "o"), ["File", "Model"])
    back = readers.read_csv(spark, str(tmp_path / "o"))
    assert back.columns == ["File", "Model", "RAG", "Metrics(primary)"] and back.first().Model == 'q,"r"'
    assert len(readers.extraction_schema()) == 16


def test_texts_and_manifest(spark, tmp_path):
    for name, text in {"a.txt": "A", "a.md": "M", "b.md": "B\nb", "c.pdf.txt": "C", "d.bin": "D"}.items():
        (tmp_path / name).write_text(text)
    assert {r.doc_id: r.text for r in readers.read_texts(spark, str(tmp_path)).collect()} == {"a": "A", "c.pdf": "C"}
    assert {r.doc_id: r.text for r in readers.read_texts_by_preference(spark, str(tmp_path)).collect()} == {"a": "A", "b": "B\nb", "c": "C"}
    (tmp_path / "m.csv").write_text("File,snippets\np,s/1.txt; s/2.txt\nq,\n")
    m = readers.read_manifest(spark, str(tmp_path / "m.csv"))
    assert [tuple(r) for r in m.orderBy("position").collect()] == [("p", 0, "s/1.txt"), ("p", 1, "s/2.txt")]


def test_json_records_and_answers(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"model": ["a", "b"], "task": "t"}))
    manifest = spark.createDataFrame([("p", 0), ("q", 1)], "File string, position int")
    out = readers.read_records(spark, str(tmp_path), manifest, ["model", "task"]).orderBy("position").collect()
    assert [(r.model, r.task) for r in out] == [("a, b", "t"), (None, None)]
    said = spark.createDataFrame([('so: {"vlm": True, "x": None, "y": "z",} done',), ("none",)], "a string")
    r = said.select(readers.parse_answer(F.col("a"), ["vlm", "y"]).alias("r")).collect()
    assert r[0].r.vlm == "true" and r[0].r.y == "z" and (r[1].r is None or r[1].r.y is None)


def test_markdown_and_texts(spark, tmp_path):
    df = spark.createDataFrame([("a|b", None), ("x" * 200, "`c`  d")], "a string, b string")
    writers.write_markdown(df.limit(1), str(tmp_path / "md"), ["a", "b"])
    assert [r.value for r in spark.read.text(str(tmp_path / "md")).collect()] == ["| a | b |", "|---|---|", "| a\\|b |  |"]
    cells = df.select(writers.clean_cell(F.col("a")), writers.clean_cell(F.col("b"))).collect()
    assert cells[0][0] == "a/b" and cells[0][1] == "Not reported" and len(cells[1][0]) == 140 and cells[1][1] == "c d"
    docs = spark.createDataFrame([("p", "x" * 600), ("q", "short")], "doc_id string, text string")
    assert [writers.write_new_texts(docs, str(tmp_path / "t")) for _ in range(2)] == [1, 0]


def test_streaming(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for batch in (first, first.withColumn("doc_id", F.col("doc_id") + 10)):
        batch.write.mode("append").parquet(src)
        ingest(spark, src, out, ck, first.schema, lambda d: d.where("text <> 'b'"))
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [1, 11]
    ev = spark.sql("select timestamp'2024-01-01 00:00:00' ts, 'k' kind union all select timestamp'2024-01-01 00:01:00', 'k'")
    assert windowed_counts(ev, "ts", "kind").first().n == 2

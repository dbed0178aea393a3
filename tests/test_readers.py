"""Blocks of braces and documents by name against plain Python."""

import random

from pyspark.sql import functions as F

from loomstead.sources import readers


def plain_block(t):
    depth, start, quoted, skip = 0, -1, False, False
    for i, c in enumerate(t or ""):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = depth > 0
        elif c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                return t[start : i + 1]
    return None


def test_blocks(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice('{}"\\ax\né') for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += [None, "", "{}", "a {b} {c}", '{"a": "}"}', '{"a": "\\"}"} x', '{"a": "\\\\"} x', "{ { }", '"{" {a}', "} {x}", "{" * 2000 + "}" * 2000 + "z", '{"' + "a\\\"" * 5000 + '"} more']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("b", readers.balanced_block(F.col("t")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        assert r.b == plain_block(r.t), r.t


def test_documents_by_name(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abAB é.") for _ in range(rng.randint(0, 9))) for _ in range(120)] + [None]
    keys = sorted({n[i : i + k] for n in names if n for i, k in ((0, 1), (1, 2), (0, 3), (2, 5))} - {""}) + ["zzz", "", None, "a", "a"]
    docs = spark.createDataFrame([(n, f"t{i}", "x") for i, n in enumerate(names)], "doc_id string, text string, part string")
    got = readers.match_documents(spark.createDataFrame([(k, 1) for k in keys], "key string, n int"), docs).collect()
    assert len(got) == len(keys)
    for r in got:
        held = sorted((n, f"t{i}") for i, n in enumerate(names) if r.key and n and r.key.lower() in n.lower())
        assert r.text == ("\n".join(t for _, t in held) if held else None), r.key


def test_documents_by_name_stay_off_the_driver(spark, tmp_path):
    """A table that compresses well counts as small, yet neither its texts nor the joined ones may be broadcast."""
    spark.range(20_000).selectExpr("concat('red ', id % 3) doc_id", "repeat('t', 200) text").write.parquet(f"{tmp_path}/docs")
    docs, keys = spark.read.parquet(f"{tmp_path}/docs"), spark.createDataFrame([("RED",), ("d 1",), ("blue",)], "key string")
    got = readers.match_documents(keys, docs)
    rows = {r.key: r.n for r in got.select("key", F.char_length("text").alias("n")).collect()}
    assert rows == {"RED": 20_000 * 201 - 1, "d 1": 6667 * 201 - 1, "blue": None}
    got.write.format("noop").mode("overwrite").save()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()

"""Rounds over a shrinking table."""

import pytest
from pyspark.sql import functions as F

from loomstead.operators.rounds import in_rounds


def test_rounds_ask_what_is_open(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def ask(df):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                asked.add(b.num_rows)
                said = [p.split(":")[1] if p and p.split(":")[1] in t else None for p, t in zip(b["prompt"].to_pylist(), b["text"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], [*b.schema.names, "answer"])

        return df.mapInArrow(run, "id long, text string, prompt string, answer string")

    df = spark.createDataFrame([(1, "a b"), (2, "b"), (3, "c"), (3, "zz"), (None, "a")], "id long, text string")
    prompts = [F.concat(F.lit(x), F.lit(""), F.when(F.col("text") == "never", "").otherwise("")) for x in ("is it:a", "is it:b", "is it:c")]
    got = in_rounds(df, prompts, ask, lambda a: F.char_length(a) > 0, f"file://{tmp_path}/w", F.lit("none"))
    assert sorted(((r.id or 0), r.text, r.answer, r["round"] or 0) for r in got.collect()) == [(0, "a", "a", 1), (1, "a b", "a", 1), (2, "b", "b", 2), (3, "c", "c", 3), (3, "zz", "none", 0)]
    assert asked.value == 5 + 3 + 2  # looking at the result asks nothing again


def test_no_rounds_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    rule = lambda d: d.withColumn("answer", F.col("prompt"))
    assert [r.answer for r in in_rounds(df, [], rule, lambda a: a == "x", f"file://{tmp_path}/a").collect()] == [None]
    assert in_rounds(df.limit(0), [F.lit("q")] * 3, rule, lambda a: a == "x", f"file://{tmp_path}/b").collect() == []
    with pytest.raises(ValueError):
        in_rounds(df.withColumn("Answer", F.lit(1)), [], rule, lambda a: a == "x", f"file://{tmp_path}/c")

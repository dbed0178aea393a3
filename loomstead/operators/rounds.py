"""Questions asked in rounds: who has an answer leaves, the rest meet the next prompt.

What answers is a batch function from rows with a prompt to the same rows with an
answer, so a model or a rule can take its place. Every round's rows are written
before they are looked at: a lost executor repeats its part of one round, no later
round asks again what an earlier one has answered, and a round costs what is open.

Rows: each row is asked on its own, also where keys repeat; a null answer is none;
rows that no round answers get the last resort's answer and no round; an empty table
gives none; columns named like the three new ones are refused.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEW = ("prompt", "answer", "round")


def in_rounds(rows: DataFrame, prompts: Sequence[Column], ask: Callable[[DataFrame], DataFrame], accepted: Callable[[Column], Column], work: str, last: Column | None = None) -> DataFrame:
    """The rows with their answer and the round (from 1) that gave it.

    ``prompts`` are the rounds' prompts; ``ask`` adds a text column ``answer`` to rows with a ``prompt``; ``accepted``
    tells whether an answer is one; ``last`` answers what is left. ``work`` is a new shared folder.
    """
    if clash := {c.lower() for c in rows.columns} & set(NEW):
        raise ValueError(f"the table has {sorted(clash)}")
    spark, columns = rows.sparkSession, [F.col(f"`{c}`") for c in rows.columns]
    good = F.coalesce(accepted(F.col("answer")), F.lit(False))
    schema = T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType())])
    done, left = [], rows
    for i, prompt in enumerate(prompts, 1):
        ask(left.withColumn("prompt", prompt)).select(*columns, F.col("answer").cast("string").alias("answer")).write.parquet(f"{work}/round{i}")
        asked = spark.read.schema(schema).parquet(f"{work}/round{i}")
        done.append(asked.where(good).withColumn("round", F.lit(i)))
        left = asked.where(~good).drop("answer")
        if left.isEmpty():
            break
    none = F.lit(None).cast("string") if last is None else last.cast("string")
    out = left.withColumn("answer", none).withColumn("round", F.lit(None).cast("int"))
    for d in done:
        out = out.unionByName(d)
    return out

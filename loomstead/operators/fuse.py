"""Fusing several versions of a table: votes, unions, best rows, seeds.

An explicit ordinal says which row came first; the order of rows never does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import is_filled, is_missing
from ..functions.names import fresh
from ..functions.tokens import vote_tokens


def vote(df: DataFrame, key: str, value: str, ordinal: str, policy: str = "fuse") -> DataFrame:
    """The most common value of each key, the first seen on ties; strength is its count."""
    v = df.where(is_filled(F.col(value), policy)).groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("strength"), F.min(ordinal).alias("first")
    )
    best = F.max(F.struct(F.col("strength"), (-F.col("first")).alias("first"), F.col("value"))).alias("b")
    return v.groupBy("key").agg(best).select("key", F.col("b.value").alias("value"), F.col("b.strength").alias("strength"))


def union(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """All distinct tokens of each key; strength is how many rows the most frequent one is in."""
    each = df.select(F.col(key).alias("key"), F.explode(F.array_distinct(tokens)).alias("token"))
    n = each.groupBy("key", "token").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("key").agg(F.array_sort(F.collect_set("token")).alias("tokens"), F.max("n").alias("strength"))


def fuse_table(df: DataFrame, key: str, voted: Sequence[str], united: Sequence[str], ordinal: str, policy: str = "fuse") -> DataFrame:
    """One row for each key: voted and united columns, as text, and the strength of each. Null keys are left out.

    All columns go through one long form, so the number of shuffles doesn't grow with them.
    """
    rows = df.where(F.col(key).isNotNull())
    cells = lambda names, value: F.explode(F.array(*[F.struct(F.lit(c).alias("field"), value(F.col(f"`{c}`")).alias("value")) for c in names])).alias("cell")
    parts = rows.select(F.col(key).alias("key"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("strength")).distinct()
    if voted:
        v = rows.select(F.col(key).alias("key"), F.col(ordinal).alias("ordinal"), cells(voted, lambda c: c.cast("string"))).select("key", "ordinal", "cell.*").where(is_filled(F.col("value"), policy))
        v = v.groupBy("key", "field", "value").agg(F.count(F.lit(1)).alias("strength"), F.min("ordinal").alias("first"))
        best = v.groupBy("key", "field").agg(F.max(F.struct(F.col("strength"), (-F.col("first")).alias("first"), F.col("value"))).alias("b"))
        parts = parts.unionByName(best.select("key", "field", "b.value", "b.strength"))
    if united:
        u = rows.select(F.col(key).alias("key"), cells(united, vote_tokens)).select("key", "cell.field", F.explode("cell.value").alias("token"))
        u = u.groupBy("key", "field", "token").agg(F.count(F.lit(1)).alias("n")).groupBy("key", "field").agg(F.array_join(F.array_sort(F.collect_list("token")), ", ").alias("value"), F.max("n").alias("strength"))
        parts = parts.unionByName(u)
    at = lambda c, x: F.max(F.when(F.col("field") == c, F.col(x)))
    return parts.groupBy("key").agg(*[e for c in [*voted, *united] for e in (at(c, "value").alias(c), at(c, "strength").alias(f"{c}__strength"))])


def best_row(df: DataFrame, key: Column, score: Sequence[Column], ordinal: str) -> DataFrame:
    """The row of each key with the highest scores, the first on ties."""
    order = F.struct(*[s.alias(f"s{i}") for i, s in enumerate(score)], (-F.col(ordinal)).alias("first"))
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("row")).select("row.*")


def answer_count(lists: Sequence[str], texts: Sequence[str], policy: str = "backfill") -> Column:
    """How much a record says: the elements of its lists and its texts that are filled."""
    from_lists = sum((F.coalesce(F.size(F.filter(c, lambda x: is_filled(x, policy))), F.lit(0)) for c in lists), F.lit(0))
    return from_lists + filled_count(texts, policy)


def filled_count(columns: Sequence[str], policy: str = "eval") -> Column:
    """How many of the columns are filled."""
    return sum((is_filled(F.col(f"`{c}`").cast("string"), policy).cast("int") for c in columns), F.lit(0))


def choose_fill(prior: Column, new: Column, strong: Column, strict: bool, policy: str = "eval") -> Column:
    """Evidence over a prior value: with ``strict`` it needs to be strong, unless there is no prior value."""
    has, had = is_filled(new, policy), is_filled(prior, policy)
    return F.when(has & (F.coalesce(strong, F.lit(False)) | ~had if strict else F.lit(True)), new).otherwise(prior)


def seed_merge(seed: DataFrame, evidence: DataFrame, key: str, value: str, strong: str, strict: bool) -> DataFrame:
    """Seed rows updated by evidence, and the rows that only one side has."""
    s = seed.select(F.col(key).alias("key"), F.col(value).cast("string").alias("prior"))
    e = evidence.select(F.col(key).alias("key"), F.col(value).cast("string").alias("new"), F.col(strong).alias("strong"))
    return s.join(e, "key", "full").select("key", choose_fill(F.col("prior"), F.col("new"), F.col("strong"), strict).alias("value"))


def backfill(df: DataFrame, other: DataFrame, key: str, column: str, value: Column, policy: str = "backfill") -> DataFrame:
    """``column`` where it's filled, else what ``value`` gives over the joined row."""
    fill = F.when(is_missing(F.col(column), policy), F.coalesce(value, F.col(column))).otherwise(F.col(column))
    return df.join(other, key, "left").withColumn(column, fill).select(*df.columns)


def first_answer(df: DataFrame, key: str, answer: str, page: str, policy: str = "eval") -> DataFrame:
    """The filled answer with the lowest page."""
    return df.where(is_filled(F.col(answer), policy)).groupBy(F.col(key).alias("key")).agg(F.min_by(answer, page).alias("answer"))


def prefer(df: DataFrame, key: str, rank: str, ordinal: str) -> DataFrame:
    """The row of each key with the lowest rank, then ordinal."""
    w = Window.partitionBy(key).orderBy(rank, ordinal)
    (nth,) = fresh(df, "nth")
    return df.withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).drop(nth)

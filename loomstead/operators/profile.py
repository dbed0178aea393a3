"""Profiles of tables: counts, shares, cross tables, diversity, provenance, key alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.missing import is_filled
from ..functions.vocabulary import MASK_CUES


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, percent)."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2))


def cross_table(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Counts of each pair of values; the columns are given, so the result's shape doesn't depend on the data."""
    return df.groupBy(F.col(rows).alias("value")).agg(*[F.count_if(F.col(columns) == v).alias(v) for v in values])


def diversity(before: DataFrame, after: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, before, after, delta): how many distinct values each version has."""

    def distinct(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*[F.countDistinct(F.when(is_filled(F.col(f).cast("string")), F.col(f).cast("string"))).alias(f) for f in fields])
        return one.unpivot([], list(fields), "field", name)

    return distinct(before, "before").join(distinct(after, "after"), "field").withColumn("delta", F.col("after") - F.col("before"))


def provenance(df: DataFrame, column: str) -> DataFrame:
    """(field, source, n) of a column with JSON maps from field to source."""
    return df.select(F.explode(F.from_json(column, "map<string,string>")).alias("field", "source")).groupBy("field", "source").agg(F.count(F.lit(1)).alias("n"))


def alignment(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(part, n): distinct keys of each table, of each pair in common, and of all."""
    keys = None
    for name, df in tables.items():
        own = df.select(F.col(key).alias("key")).where(F.col(key).isNotNull()).distinct().withColumn("at", F.lit(name))
        keys = own if keys is None else keys.unionByName(own)
    sets = keys.groupBy("key").agg(F.array_sort(F.collect_list("at")).alias("at"))
    names = sorted(tables)
    parts = [[a] for a in names] + [[a, b] for i, a in enumerate(names) for b in names[i + 1 :]] + ([names] if len(names) > 2 else [])
    counts = sets.agg(*[F.count_if(F.size(F.array_except(F.array(*map(F.lit, p)), F.col("at"))) == 0).alias("&".join(p)) for p in parts])
    return counts.unpivot([], ["&".join(p) for p in parts], "part", "n")


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys of a that b lacks."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def availability_mask(docs: DataFrame, doc_id: str, text: str, cues: dict[str, str] = MASK_CUES, filled: DataFrame | None = None) -> DataFrame:
    """A row for each document and a 0/1 column for each field: a cue in the text, or a filled cell in ``filled``."""
    m = docs.select(F.col(doc_id).alias("key"), *[F.coalesce(F.col(text).rlike(f"(?i){p}"), F.lit(False)).cast("int").alias(f) for f, p in cues.items()])
    if filled is None:
        return m
    have = [f for f in cues if f in filled.columns]
    other = filled.select(F.col(doc_id).alias("key"), *[is_filled(F.col(f).cast("string"), "mask").cast("int").alias(f"_{f}") for f in have])
    both = m.join(other, "key", "full")
    both = both.select("key", *[F.greatest(F.coalesce(f, F.lit(0)), F.coalesce(f"_{f}", F.lit(0)) if f in have else F.lit(0)).alias(f) for f in cues])
    return both

"""Places of rows in a total order, without a task that has them all.

Rows are dealt out by range and written; one pass counts each range, so that each
knows how many rows come before it, and rows are numbered within their range.

Rows: equal rows, also where very many are equal, go to several ranges and get
places of their own in any order; nulls come first in ascending order, last in
descending; an empty table stays empty; other columns stay.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh


def numbered(df: DataFrame, work: str, *order: str | Column, name: str = "place") -> DataFrame:
    """The rows with their place (from 1) in an order; ``work`` is a new shared folder for the ranges."""
    spark = df.sparkSession
    part, tie, before = fresh(df, "part", "tie", "before")
    keys = [F.col(f"`{o}`") if isinstance(o, str) else o for o in order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *keys, tie).withColumn(part, F.spark_partition_id())
    ranges.write.parquet(work)
    kept = spark.read.schema(ranges.schema).parquet(work)
    counts = sorted(kept.groupBy(part).count().collect())  # a number for each range
    starts = [(i, n) for (i, _), n in zip(counts, accumulate((c for _, c in counts), initial=0), strict=False)]
    offsets = spark.createDataFrame(starts, f"{part} int, {before} long")
    within = F.row_number().over(Window.partitionBy(part).orderBy(*keys, tie))
    return kept.join(F.broadcast(offsets), part).withColumn(name, F.col(before) + within).drop(part, tie, before)


def by_position(a: DataFrame, b: DataFrame, order_a: str | Column, order_b: str | Column, work: str) -> DataFrame:
    """Rows of two tables side by side by their place in an order, as structs a and b; the longer table's rest has a null beside it."""

    def placed(df: DataFrame, order: str | Column, name: str) -> DataFrame:
        (place,) = fresh(df, "place")
        return numbered(df, f"{work}/{name}", order, name=place).select(F.col(place).alias("place"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))

    return placed(a, order_a, "a").join(placed(b, order_b, "b"), "place", "full")

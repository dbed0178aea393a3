"""Incremental ingestion by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import ledger


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], per_trigger: int = 1000) -> None:
    """Process the files that came since the last run, each once, and append the results; returns when all are done."""
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(source)
    run = transform(new).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()


def ingest_once(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], key: str, name: str, per_trigger: int = 1000) -> None:
    """The same into a table in which every key is once: batches count once by their names, also if a run is cut off and repeats one, or others append at the same time."""
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(source)
    put = lambda batch, number: ledger.append(batch, sink, f"{name}-{number}", key)
    run = transform(new).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def windowed_counts(events: DataFrame, ts: str, kind: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by window and kind of a stream (or a table), with late rows up to a bound."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), F.col(kind)).agg(F.count(F.lit(1)).alias("n"))

"""Sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ledger


def clean_cell(c: Column, longest: int | None = 140, empty: str = "Not reported", fences: bool = False) -> Column:
    """A cell for a Markdown table: no bars or backticks, white space squeezed, cut with an ellipsis; ``fences`` drops fenced code and a full stop at the end."""
    if fences:
        c = F.regexp_replace(F.regexp_replace(c, r"(?s)```.*?```", " "), r"[ .]+$", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("/")), "`", ""), r"\s+", " "))
    if longest:
        out = F.when(F.char_length(out) > longest, F.concat(F.substring(out, 1, longest - 1), F.lit("…"))).otherwise(out)
    return F.when(out == "", empty).otherwise(out)


def escape_cell(c: Column) -> Column:
    """A cell with its bars escaped."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))


def markdown_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(line): the rows of a Markdown table."""
    cells = [escape_cell(F.col(f"`{c}`").cast("string")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def write_markdown(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """A Markdown table in one file; meant for reports."""
    head = df.sparkSession.createDataFrame([("| " + " | ".join(columns) + " |",), ("|" + "---|" * len(columns),)], "line string")
    head.coalesce(1).unionByName(markdown_rows(df, columns)).coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], defaults: Sequence[str] = ("RAG", "Metrics(primary)"), one_file: bool = True) -> None:
    """A CSV with a fixed header; columns that the table lacks are added empty, ``defaults`` at the end if not named."""
    names = [*columns, *[c for c in defaults if c not in columns]]
    out = df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in names])
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_new_texts(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", least: int = 500, batch: str | None = None) -> int:
    """Append documents of at least ``least`` characters that aren't there yet. Returns how many.

    A batch that has a name counts once; two writers at once add nothing twice (``sources.ledger``, which also reads the table).
    """
    return ledger.append(df.where(F.char_length(text) >= least).select(doc_id, text), path, batch or uuid.uuid4().hex, doc_id)


def write_json(df: DataFrame, path: str, key: str | None = None) -> None:
    """Rows as JSON lines; with ``key`` in a folder for each value of it (``key=value``), null fields written too."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(key) if key else writer).json(path)


def write_vectors(chunks: DataFrame, path: str, doc_id: str = "doc_id", buckets: int = 64) -> None:
    """A store of chunks and their vectors, partitioned by a hash of the document, so that a filter on one document reads one part."""
    part = F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")
    chunks.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def dump(df: DataFrame, path: str, columns: Sequence[str], longest: int = 400) -> None:
    """The beginning of chosen text columns as JSON lines, to look at."""
    df.select(*[F.left(F.col(f"`{c}`").cast("string"), F.lit(longest)).alias(c) for c in columns]).write.mode("overwrite").json(path)

"""A stored index of words, and the best documents for each query of a table.

The documents are cut into blocks as they are read. The index has a row for each
word of each block: which of the block's documents hold it how often, and the most
that it can add to a score there. Each task writes its own blocks' rows, in parts of
some blocks that are sorted by word, so the index is neither shuffled nor sorted as a
whole. A search takes the rows of the words asked for out of the index once, and
first scores each query's most promising blocks, which gives a score that its
k-th best document has at least; blocks whose words together can't reach it are
never read. All queries go through at once, by equi joins on word and block.

Rows: each row is a document of its own, also where ids repeat; null texts have no
words but count as documents; ids keep their type; an empty table or query gives
nothing; equal scores (rounded to 6 digits) go by id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents in a block, and blocks in a sorted part of the index.
BLOCK, PARTS = 256, 32
_WORD = re.compile("[a-z0-9]+")


def words(text: Column) -> Column:
    """The words of a text: runs of a-z and 0-9, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def _sorted(blocks: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = pa.Table.from_batches(blocks)
    yield from part.take(pc.sort_indices(part, [("term", "ascending"), ("block", "ascending")])).combine_chunks().to_batches(10_000)


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))


def _block(ids: pa.Array, rows: pa.Array, texts: list[str | None], schema: pa.Schema) -> pa.RecordBatch:
    """The rows of one block; the empty word's row has its documents and how many words each has."""
    counts = [Counter(_WORD.findall((t or "").lower())) for t in texts]
    n = np.array([c.total() for c in counts], np.int64)
    number: dict[str, int] = {}
    code = np.array([number.setdefault(w, len(number)) for c in counts for w in c], np.int64)
    at, tf = np.repeat(np.arange(len(counts)), [len(c) for c in counts]), np.array([x for c in counts for x in c.values()], np.int64)
    order = np.argsort(code, kind="stable")
    at, tf = at[order], tf[order]
    starts = np.r_[0, np.cumsum(np.bincount(code, minlength=len(number)))].astype(np.int64) if len(number) else np.zeros(1, np.int64)
    pieces = len(number) + 1
    reduced = lambda f, x: f.reduceat(x, starts[:-1]) if len(number) else np.zeros(0, np.int64)
    kinds = [
        pa.array(["", *number], pa.string()), pa.array([rows[0].as_py()] * pieces, pa.int64()), pa.array(np.r_[len(n), np.diff(starts)], pa.int64()), pa.array(np.r_[0, reduced(np.maximum, tf)], pa.int32()),
        pa.array(np.r_[n.min(), reduced(np.minimum, n[at])], pa.int32()), pa.array(np.r_[n.sum(), np.zeros(len(number), np.int64)], pa.int64()),
        _lists(np.r_[np.arange(len(n)), at], np.r_[0, len(n) + starts]), _lists(np.r_[n, tf], np.r_[0, len(n) + starts]),
        pa.ListArray.from_arrays(pa.array([0, *[len(ids)] * pieces], pa.int32()), ids),
    ]
    return pa.RecordBatch.from_arrays(kinds, schema=schema)


def write_index(docs: DataFrame, doc_id: str, text: str, path: str) -> None:
    """Write the index of all documents to a folder; what is there is replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = docs.schema[doc_id].dataType
    fields = [("term", T.StringType()), ("block", T.LongType()), ("documents", T.LongType()), ("tf", T.IntegerType()), ("n", T.IntegerType()), ("words", T.LongType()), ("at", T.ArrayType(T.IntegerType())), ("often", T.ArrayType(T.IntegerType())), ("ids", T.ArrayType(kind))]
    schema = T.StructType([T.StructField(*f) for f in fields])
    arrow = to_arrow_schema(schema)
    size, together = BLOCK, PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[pa.RecordBatch] = []
        for batch in batches:
            for begin in range(0, batch.num_rows, size):
                ids, rows, texts = (batch.column(i).slice(begin, size) for i in range(3))
                part.append(_block(ids, rows, texts.to_pylist(), arrow))
                if len(part) == together:
                    yield from _sorted(part)
                    part = []
        if part:
            yield from _sorted(part)

    own = docs.select(F.col(doc_id).alias("doc"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    own.mapInArrow(run, schema).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
    docs.sparkSession.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/columns")  # an empty index has no other file that tells them


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """An index's rows."""
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/postings")


def gain(idf: Column, tf: Column, n: Column, mean: float, k1: float, b: float) -> Column:
    """What a word adds to a document's score."""
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean))


def search(spark: SparkSession, path: str, queries: DataFrame, work: str, k: int = 10, probe: int = 2, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, rank, doc, score): the k best documents for each query, given as (query, term) rows.

    ``work`` is a new shared folder; what the search finds about blocks is written there.
    """
    index = open_index(spark, path)
    queries.select("query", "term").where("term <> ''").distinct().write.parquet(f"{work}/queries")
    asked = spark.read.parquet(f"{work}/queries")  # now Spark knows its size and, if it is small, leaves the index where it is
    held = index.where("term = ''")
    every = held.agg(F.sum("documents").alias("n"), F.sum("words").alias("words")).first()
    n, mean = every["n"] or 0, max((every["words"] or 0) / max(every["n"] or 0, 1), 1e-9)
    index.join(asked.select("term").distinct(), "term", "left_semi").select("term", "block", "documents", "tf", "n", "at", "often").write.parquet(f"{work}/wanted")
    wanted = spark.read.parquet(f"{work}/wanted")
    maxima = wanted.select("term", "block", "documents", "tf", "n")
    often = maxima.groupBy("term").agg(F.sum("documents").alias("df"))
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked.join(often, "term").select("query", "term", idf.alias("idf")).write.parquet(f"{work}/asked")
    asked = spark.read.parquet(f"{work}/asked")
    bound = F.sum(gain(F.col("idf"), F.col("tf"), F.col("n"), mean, k1, b)).alias("bound")
    maxima.join(asked, "term").groupBy("query", "block").agg(bound).write.parquet(f"{work}/bounds")
    bounds = spark.read.parquet(f"{work}/bounds")

    lengths = held.select("block", F.explode(F.arrays_zip("at", F.col("often").alias("n"), F.col("ids").alias("doc"))).alias("d")).select("block", "d.*")

    def scored(blocks: DataFrame) -> DataFrame:
        met = blocks.select("query", "block").join(asked, "query").join(wanted.select("term", "block", "at", "often"), ["term", "block"])
        each = met.select("query", "block", "idf", F.explode(F.arrays_zip("at", "often")).alias("p")).select("query", "block", "idf", "p.*")
        found = each.join(lengths, ["block", "at"])
        score = F.round(F.sum(gain(F.col("idf"), F.col("often"), F.col("n"), mean, k1, b)), 6)
        return found.groupBy("query", "block", "at", "doc").agg(score.alias("score"))

    best = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= probe)
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "doc", "block", "at")
    least = scored(first).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    open_ = bounds.join(least, "query", "left").where(F.col("least").isNull() | (F.col("bound") + 1e-5 >= F.col("least")))
    return scored(open_).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query", "rank", "doc", "score")

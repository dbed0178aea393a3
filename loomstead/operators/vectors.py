"""A store of vectors in coarse cells, searched for all queries of a table at once.

Cells come from k-means over a bounded sample of the rows (``sample``); every row is
stored in the cell of its nearest centre, with its distance from it. A search looks
into each query's best cells. That alone is the quick way; the exact way then uses
what the k-th best score so far and a cell's radius say: no row of a cell can score
more than its centre's score plus radius times the query's length, so all cells
that could still hold a better row are searched too. Scores are dot products of
whole vectors in both ways.

Rows and queries meet by cell, in blocks of vectors, as matrices. Cells of any size
are many blocks, and so are queries; the driver holds the sample and the centres.

Rows: null vectors are left out; vectors of another length are refused; rows that
repeat a key are rows of their own; keys keep their type; an empty store or query
table gives nothing; equal scores (rounded to 9 digits) go by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and queries in a block.
ROWS, QUERIES = 8192, 1024


def fit_cells(rows: DataFrame, key: str, vector: str, cells: int = 64, sample: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Centres of at most ``cells`` cells from the ``sample`` rows whose keys hash lowest."""
    some = rows.where(F.col(vector).isNotNull()).select(F.xxhash64(F.col(key)).alias("h"), F.col(vector).cast("array<double>").alias("v")).orderBy("h", "v").limit(sample).toPandas()
    points = np.array(some["v"].tolist(), float)
    if not len(points):
        return np.zeros((0, 0))
    centres = points[np.linspace(0, len(points) - 1, min(cells, max(1, len(points) // 8))).astype(int)]
    for _ in range(rounds):
        near = _distances(points, centres).argmin(axis=1)
        used = np.unique(near)
        centres = np.array([points[near == c].mean(axis=0) for c in used])
    return centres


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1), 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix."""
    if any(n != width for n in set(np.diff(column.offsets.to_numpy()).tolist())):
        raise ValueError(f"vectors must have {width} numbers")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _in_cells(rows: DataFrame, key: str, vector: str, centres: np.ndarray) -> DataFrame:
    """The rows with the number of their cell and their distance from its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column(1), centres.shape[1])
            squares = _distances(points, centres)
            cell = squares.argmin(axis=1)
            off = np.linalg.norm(points - centres[cell], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(off)], ["key", "vector", "cell", "off"])

    schema = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType()), T.StructField("off", T.DoubleType())])
    return rows.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>")).mapInArrow(run, schema)


def write_store(rows: DataFrame, key: str, vector: str, path: str, cells: int = 64, sample: int = 20_000) -> None:
    """Fit the cells and write all rows; what is in the folder is replaced."""
    spark, centres = rows.sparkSession, fit_cells(rows, key, vector, cells, sample)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    rows.select(F.col(key).alias("key")).limit(0).write.mode("overwrite").parquet(f"{path}/columns")
    _write(rows, key, vector, path, centres, "overwrite")


def append(rows: DataFrame, key: str, vector: str, path: str) -> None:
    """Add rows to a store; its cells stay."""
    centres = _centres(rows.sparkSession, path)
    if not len(centres) and not rows.where(F.col(vector).isNotNull()).isEmpty():
        raise ValueError("the store has no cells; write it with some rows first")
    _write(rows, key, vector, path, centres, "append")


def _write(rows: DataFrame, key: str, vector: str, path: str, centres: np.ndarray, mode: str) -> None:
    placed = _in_cells(rows, key, vector, centres)
    # a cell's rows go to several tasks, so that no cell is one task's
    placed = placed.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(4)))
    placed.sortWithinPartitions("cell").write.mode(mode).partitionBy("cell").parquet(f"{path}/rows")


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    found = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return np.array([r["centre"] for r in found], float)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """A store's rows: key, vector, off (the distance from the cell's centre), cell."""
    kind = spark.read.parquet(f"{path}/columns").schema["key"].dataType
    fields = [T.StructField("key", kind), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("off", T.DoubleType()), T.StructField("cell", T.IntegerType())]
    return spark.read.schema(T.StructType(fields)).parquet(f"{path}/rows")


def in_blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(cell, keys, matrix) of (key, vector, cell) rows: those of a cell that a task has, some at a time."""
    kind = rows.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(2).to_numpy()
            order = np.argsort(cells, kind="stable")
            width = len(batch.column(1)[0]) if batch.num_rows else 0
            matrix = _matrix(batch.column(1), width)
            edges = np.flatnonzero(np.r_[True, np.diff(cells[order]) != 0, True]) if len(order) else np.zeros(1, int)
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                for at in range(begin, end, size):
                    own = order[at : min(at + size, end)]
                    keys = batch.column(0).take(pa.array(own))
                    lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), keys)
                    yield pa.RecordBatch.from_arrays([pa.array(cells[own[:1]], pa.int32()), lists, pa.array([matrix[own].tobytes()], pa.binary())], ["cell", f"{name}_keys", f"{name}_matrix"])

    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField(f"{name}_keys", T.ArrayType(kind)), T.StructField(f"{name}_matrix", T.BinaryType())])
    return rows.select("key", "vector", "cell").mapInArrow(run, schema)


def best_pairs(pairs: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """(query, key, score): for each pair of blocks each query's best k rows, by key on ties."""
    import pyarrow.compute as pc

    kinds = [pairs.schema[f"{n}_keys"].dataType.elementType for n in ("query", "row")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, keys = batch.column(0)[i].values, batch.column(2)[i].values
                queries = np.frombuffer(batch.column(1)[i].as_buffer(), float).reshape(len(asked), -1)
                rows = np.frombuffer(batch.column(3)[i].as_buffer(), float).reshape(len(keys), -1)
                score = np.round(queries @ rows.T, 9)
                if exclude_self:
                    same = {}
                    for at, x in enumerate(keys.to_pylist()):
                        same.setdefault(x, []).append(at)
                    for at, x in enumerate(asked.to_pylist()):
                        score[at, same.get(x, [])] = -np.inf
                n = min(k, score.shape[1])
                least = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
                row, column = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                place = np.empty(len(keys), np.int64)
                place[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
                order = np.lexsort((place[column], -score[row, column], row))
                row, column = row[order], column[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, column = row[kept], column[kept]
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(row)), keys.take(pa.array(column)), pa.array(score[row, column])], ["query", "key", "score"])

    schema = T.StructType([T.StructField("query", kinds[0]), T.StructField("key", kinds[1]), T.StructField("score", T.DoubleType())])
    return pairs.select("query_keys", "query_matrix", "row_keys", "row_matrix").mapInArrow(run, schema)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(queries: DataFrame, key: str, vector: str, path: str, work: str, k: int = 10, probe: int = 8, exact: bool = True, exclude_self: bool = True, where: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query, key, score, rank): the k rows of a store with the highest dot product.

    ``where`` may filter the rows. ``work`` is a new shared folder for what the first cells give.
    """
    spark = queries.sparkSession
    centres, rows = _centres(spark, path), open_store(spark, path)
    rows = where(rows) if where else rows
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    far = dict(rows.groupBy("cell").agg(F.max("off")).collect())  # a number for each cell
    radius = np.array([far.get(c, -1.0) for c in range(len(centres))])
    blocks = in_blocks(rows, ROWS, "row")

    def met(wanted: DataFrame) -> DataFrame:
        asking = in_blocks(wanted.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(4))), QUERIES, "query")
        return best_pairs(blocks.join(asking, "cell"), k, exclude_self)

    ranked(met(_cells_of(asked, centres, radius, probe)), k).drop("rank").write.parquet(f"{work}/first")
    first = spark.read.parquet(f"{work}/first")
    if not exact:
        return ranked(first, k)
    least = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    more = asked.join(least.withColumnRenamed("query", "key"), "key", "left")
    rest = met(_cells_of(more, centres, radius, probe, others=True))
    return ranked(first.unionByName(rest), k)


def _cells_of(asked: DataFrame, centres: np.ndarray, radius: np.ndarray, probe: int, others: bool = False) -> DataFrame:
    """(key, vector, cell): each query with its ``probe`` best cells, or with those ``others`` that can hold a row as good as ``least``."""
    columns = [*asked.columns, *(() if others else ("least",))]
    asked = asked if others else asked.withColumn("least", F.lit(None).cast("double"))
    kind = asked.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(centres):
                continue
            points = _matrix(batch.column(1), centres.shape[1])
            bound = points @ centres.T + np.linalg.norm(points, axis=1)[:, None] * radius + 1e-6
            bound[:, radius < 0] = -np.inf  # nothing is there
            score = np.where(radius < 0, -np.inf, points @ centres.T)
            order = np.argsort(-score, axis=1, kind="stable")
            taken = np.zeros(score.shape, bool)
            np.put_along_axis(taken, order[:, :probe], True, axis=1)
            taken &= bound > -np.inf
            if others:
                least = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                taken = ~taken & (bound > -np.inf) & ~(bound < least[:, None])
            row, cell = np.nonzero(taken)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(cell.astype(np.int32))], ["key", "vector", "cell"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])
    return asked.select(*columns).mapInArrow(run, schema)

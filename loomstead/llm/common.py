"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in most operators: ASCII white space and nothing else.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and
    Spark runs on this machine alone, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='loomstead-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base


@contextlib.contextmanager
def _own_setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Workspace:
    """Tables that an operator writes between its steps, in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        self.tables: dict[str, str] = {}
        atexit.register(self.close)

    def close(self) -> None:
        """Delete all that is left, results too; done by itself when the driver ends."""
        atexit.unregister(self.close)
        with contextlib.suppress(Exception):  # the session may be gone
            self.drop("")
        self.names = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
        """Write ``df`` and read it again: its lineage ends here, and its shuffle files go when it is written."""
        with _own_setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.mode("overwrite").option("compression", codec).parquet(self.path(name), partitionBy=by)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def save_bucketed(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """Write ``df`` in buckets of a column and read it again: what groups by that column moves only the other side.

        There are as many buckets as shuffle partitions. Buckets need a table's name; it goes with the table.
        """
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables[name] = f"loomstead_{name}_{uuid.uuid4().hex}"
        with _own_setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            writer = df.repartition(n, column).write.format("parquet").option("compression", "zstd").option("path", self.path(name))
            writer.bucketBy(n, column).sortBy(column).saveAsTable(self.tables[name])
        self.names.add(name)
        return self.spark.table(self.tables[name])

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads, on whatever file system it is."""
        for own in [name] if name else list(self.tables):
            if own in self.tables:
                self.spark.sql(f"drop table if exists {self.tables.pop(own)}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        """Write the result and delete all that led to it."""
        out = self.save(df, name)
        self.keep(name)
        return out

    def keep(self, *names: str) -> None:
        """Delete all tables but these."""
        for other in self.names - {*names}:
            self.drop(other)
        self.names = {*names}


def text_of(name: str) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text: runs of anything but ASCII white space."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))

"""Tables that grow by batches, each of which counts once, whoever writes it and however often.

A batch's rows go to a folder of their own; they are part of the table once an
entry with the next number stands in the ledger. An entry is renamed into place and
never over another, so of two writers at once one comes second: it looks again at
what is there by then and tries the next number. A batch that is repeated is known
by its name; one that was cut off before its entry left a folder that nobody reads.

Rows: of rows with one key (null is a key too) the first by the other columns is
taken, and none whose key is there already; an empty batch makes an entry without
rows; other columns stay. A rename that doesn't replace is what the file system
must offer; object stores without it need a single writer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _path(spark: SparkSession, path: str):
    """A path with its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(at), fs


def entries(spark: SparkSession, path: str) -> list[dict]:
    """The batches of a table, in order: batch, folder, rows, schema."""
    at, fs = _path(spark, f"{path}/ledger")
    if not fs.exists(at):
        return []
    found = [json.loads(r["value"]) for r in spark.read.text(f"{path}/ledger").collect()]  # a line for each batch
    return sorted(found, key=lambda e: e["number"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches that count."""
    known = entries(spark, path)
    if not known:
        raise ValueError(f"nothing was appended to {path}")
    schema = StructType.fromJson(known[0]["schema"])
    return spark.read.schema(schema).parquet(*[f"{path}/data/{e['folder']}" for e in known])


def _claim(spark: SparkSession, path: str, entry: dict) -> bool:
    """Put an entry into its place in the ledger; False if another is there."""
    jvm = spark.sparkContext._jvm
    at, fs = _path(spark, f"{path}/ledger")
    draft, place = (jvm.org.apache.hadoop.fs.Path(at, n) for n in (f".{uuid.uuid4().hex}", f"{entry['number']:012d}"))
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    how = jvm.java.lang.reflect.Array.newInstance(kind, 1)
    jvm.java.lang.reflect.Array.set(how, 0, jvm.java.lang.Enum.valueOf(kind, "NONE"))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, place, how)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error.java_exception):
            raise
        fs.delete(draft, False)
        return False


def append(df: DataFrame, path: str, batch: str, key: str, before_entry: Callable[[], None] | None = None) -> int:
    """Append a batch's rows whose keys aren't there yet; returns how many the batch has brought, now or when it first came.

    ``before_entry`` is called when the rows are written and the entry isn't, for tests.
    """
    spark, columns = df.sparkSession, df.columns
    while True:
        known = entries(spark, path)
        for e in known:
            if e["batch"] == batch:
                return e["rows"]
        rest = [F.col(f"`{c}`") for c in columns if c != key]
        new = df.groupBy(key).agg(F.min(F.struct(F.lit(0).alias("_"), *rest)).alias("_first")).select(*[F.col(f"`{c}`") if c == key else F.col(f"_first.`{c}`") for c in columns])
        if known:
            there = read(spark, path).select(F.col(key).alias("_there")).distinct()
            new = new.join(there, new[key].eqNullSafe(there["_there"]), "left_anti")
        folder = uuid.uuid4().hex
        new.write.parquet(f"{path}/data/{folder}")
        n = spark.read.schema(df.schema).parquet(f"{path}/data/{folder}").count()
        if before_entry:
            before_entry()
        if _claim(spark, path, {"number": len(known), "batch": batch, "folder": folder, "rows": n, "schema": df.schema.jsonValue()}):
            return n
        at, fs = _path(spark, f"{path}/data/{folder}")  # another batch came first: look again
        fs.delete(at, True)

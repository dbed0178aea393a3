"""Sources. CSV is read as strings only: inferred types turn blanks and labels into numbers."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.missing import collapse
from ..functions.names import let
from ..operators.fuse import prefer

#: The columns of an extraction table, in order.
COLUMNS = (
    "File", "Modality", "Datasets (train)", "Datasets (eval)", "Paired", "VLM?", "Model", "Class", "Task", "Vision Enc", "Lang Dec", "Fusion", "Objectives", "Family", "RAG", "Metrics(primary)",
)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, fill: bool = False) -> DataFrame:
    """A CSV with a header, all strings; with ``columns`` those, in that order, empty where the file lacks them.

    ``fill`` pads rows that are too short with empty strings.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
    df = reader.csv(path, inferSchema=False)
    if columns is not None:
        df = df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in columns])
    return df.fillna("") if fill else df


def read_keyed(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A ragged CSV: empty rows left out, short ones padded, the key column (by name, or the first) in front as "key"."""
    df = read_csv(spark, path, fill=True)
    name = key if key in df.columns else df.columns[0]
    some = F.concat_ws("", *[F.col(f"`{c}`") for c in df.columns])
    return df.where(F.trim(some) != "").select(F.col(f"`{name}`").alias("key"), *[F.col(f"`{c}`") for c in df.columns if c != name])


def common_columns(base: DataFrame, *others: DataFrame) -> list[str]:
    """The columns that all tables have, in the first one's order."""
    return [c for c in base.columns if all(c in o.columns for o in others)]


def to_list(c: Column) -> Column:
    """A cell as a list: a JSON array's elements, or the text alone; nothing is not reported."""
    items = F.when(F.startswith(F.trim(c), F.lit("[")), F.from_json(c, "array<string>")).when(F.trim(c) != "", F.array(F.trim(c)))
    items = F.filter(items, lambda x: F.trim(x) != "")
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, items).otherwise(F.array(F.lit("Not reported")))


def first_scalar(c: Column) -> Column:
    """A cell as one text: the first of a JSON array, or itself."""
    return F.element_at(to_list(c), 1)


def balanced_block(answer: Column) -> Column:
    """The first block of balanced braces in an answer, strings taken into account; null without one.

    The answer is cut behind every brace, quote and backslash, and one fold over these pieces keeps depth and
    whether a string is open; other characters are never looked at one by one.
    """
    state = lambda at, depth, quoted, skip, end: F.struct(at.alias("at"), depth.alias("depth"), quoted.alias("quoted"), skip.alias("skip"), end.alias("end"))

    def step(s: Column, piece: Column) -> Column:
        n, c = F.char_length(piece), F.right(piece, F.lit(1))
        escaped = s["skip"] & (n == 1)  # what stands behind a backslash is this very character
        plain = ~s["quoted"] & ~escaped
        depth = s["depth"] + F.when(plain & (c == "{"), 1).when(plain & (c == "}"), -1).otherwise(0)
        quoted = F.when(~escaped & (c == '"'), ~s["quoted"]).otherwise(s["quoted"])
        after = state(s["at"] + n, depth, quoted, s["quoted"] & ~escaped & (c == "\\"), F.when(plain & (c == "}") & (depth == 0), s["at"] + n))
        return F.when(s["end"].isNotNull(), s).otherwise(after)

    begun = state(F.lit(0), F.lit(0), F.lit(False), F.lit(False), F.lit(None).cast("int"))
    inside = F.when(F.contains(answer, F.lit("{")), F.substring(answer, F.instr(answer, "{"), F.char_length(answer)))

    def block(t: Column) -> Column:
        end = F.aggregate(F.regexp_extract_all(t, F.lit(r'(?s)[^"\\{}]*["\\{}]'), 0), begun, step, lambda s: s["end"])
        return let(end, lambda e: F.when(e.isNotNull(), F.substring(t, F.lit(1), e)))

    return let(inside, block)


def extraction_schema() -> StructType:
    return StructType([StructField(c, StringType()) for c in COLUMNS])


def stem(path: Column) -> Column:
    """The file name without its folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt", nested: bool = False) -> DataFrame:
    """(doc_id, text): a whole file for each row."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", nested)
    return reader.text(path, wholetext=True).select(stem(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))


def read_texts_by_preference(spark: SparkSession, path: str, extensions: Sequence[str] = (".txt", ".md", ".pdf.txt")) -> DataFrame:
    """(doc_id, text): of files that differ in their extension alone, the one whose extension comes first."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"))
    rank, doc = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, e in sorted(enumerate(extensions), key=lambda x: len(x[1])):  # longer extensions decide first
        hit = F.endswith("name", F.lit(e))
        rank, doc = F.when(hit, i).otherwise(rank), F.when(hit, F.expr(f"left(name, length(name) - {len(e)})")).otherwise(doc)
    found = raw.select(doc.alias("doc_id"), rank.alias("rank"), "name", "text").where("rank is not null")
    return prefer(found, "doc_id", "rank", "name").select("doc_id", "text")


def read_manifest(spark: SparkSession, path: str, key: str = "File", column: str = "snippets", separator: str = ";") -> DataFrame:
    """(key, position, path): the list cells of a manifest, taken apart."""
    df = read_csv(spark, path)
    each = df.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(column), separator)).alias("position", "path"))
    return each.withColumn("path", F.trim("path")).where("path <> ''")


def read_records(spark: SparkSession, path: str, manifest: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(File, position, fields...) in the manifest's order: one JSON file for each document, nulls where it's missing.

    Lists become strings joined by commas.
    """
    schema = StructType([StructField(f, StringType()) for f in fields])
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    parsed = raw.select(stem(F.input_file_name()).alias("File"), F.from_json("value", schema).alias("r"))
    listed = F.from_json  # a list arrives as its JSON text
    parsed = parsed.select("File", *[F.when(F.startswith(F.col(f"r.`{f}`"), F.lit("[")), F.array_join(listed(F.col(f"r.`{f}`"), "array<string>"), ", ")).otherwise(F.col(f"r.`{f}`")).alias(f) for f in fields])
    return manifest.join(parsed, "File", "left")


def parse_answer(answer: Column, fields: Sequence[str]) -> Column:
    """The outermost braces of an answer as a struct of strings; Python's constants and trailing commas are mended."""
    block = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    for a, b in ((r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r"\bNone\b", "null"), (r",(\s*[}\]])", "$1")):
        block = F.regexp_replace(block, a, b)
    return F.from_json(block, StructType([StructField(f, StringType()) for f in fields]))


def prompt_sections(text: Column) -> Column:
    """Of a prompt file with ``### name`` headings and fenced text: an array of (name, body)."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)###\s*([^\n]+)\n(?:(?!###).)*?```text\n(?:(?!```).)*"), 0)
    return F.transform(
        parts, lambda p: F.struct(collapse(F.regexp_extract(p, r"###\s*([^\n]+)", 1)).alias("name"), F.regexp_extract(p, r"(?s)```text\n(.*)$", 1).alias("body"))
    )


def clean_text(text: Column) -> Column:
    """Without control characters, words broken at line ends joined, blank lines and blanks squeezed."""
    for a, b in ((r"[\x00-\x08\x0B-\x1F]", ""), (r"(\w)-\n(\w)", "$1$2"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"^\s+|\s+$", "")):
        text = F.regexp_replace(text, a, b)
    return text


def normalized(text: Column) -> Column:
    """Unicode's composed form (NFC), which has no built-in; Arrow batches."""
    def compose(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    return F.pandas_udf(compose, "string")(text)


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON object, such as prompts by field, read by Spark; small by nature."""
    import json

    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_vectors(spark: SparkSession, path: str, doc_id: object | None = None, column: str = "doc_id", buckets: int = 64) -> DataFrame:
    """A store of chunks; of one document only its part is read."""
    df = spark.read.parquet(path)
    if doc_id is None:
        return df.drop("part")
    at = df.schema[column].dataType.simpleString()
    part = spark.range(1).select(F.pmod(F.xxhash64(F.lit(doc_id).cast(at)), F.lit(buckets)).cast("int")).first()[0]
    return df.where((F.col("part") == part) & (F.col(column) == F.lit(doc_id))).drop("part")


def document_ids(store: DataFrame, column: str = "doc_id") -> DataFrame:
    """The distinct documents of a store, in order."""
    return store.select(column).distinct().orderBy(column)


def match_documents(ids: DataFrame, docs: DataFrame, key: str = "key", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): all documents whose name holds the key, whatever its case, joined in order of their names; none is null.

    Names are cut into all their parts of one to three characters. A key meets the names that have the part of it that
    the fewest names have, and is then looked for itself, so there may be any number of keys. A key without documents,
    an empty or a null one gets nothing; repeated keys each get a row. Tables that compress well look small enough for
    a broadcast, which goes through the driver: what has a row for each name or a text joins by sorting.
    """
    parts = lambda c, n: F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)
    low = F.lower(F.col(doc_id).cast("string"))
    each = F.array_distinct(F.concat(*[parts(F.col("low"), n) for n in (1, 2, 3)]))
    named = docs.select(low.alias("low")).distinct().select("low", F.explode(each).alias("part"))
    asked = ids.select(F.col(key).alias("key")).where("key <> ''").distinct().withColumn("low", F.lower("key"))
    cut = F.when(F.char_length("low") >= 3, parts(F.col("low"), 3)).otherwise(F.array("low"))
    asked = asked.select("key", F.col("low").alias("wanted"), F.explode(cut).alias("part"))
    often = named.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.hint("merge").join(often, "part", "left").groupBy("key", "wanted").agg(F.min_by("part", F.struct("n", "part")).alias("part"), F.bool_and(F.col("n").isNotNull()).alias("there"))
    met = named.hint("merge").join(rarest.where("there"), "part").where(F.contains("low", F.col("wanted"))).select("key", "low")
    own = docs.select(low.alias("low"), F.col(doc_id).alias("name"), F.col(text).alias("own"))
    joined = met.hint("merge").join(own, "low").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("name", "own"))).alias("parts"))
    found = joined.select(F.col("key").alias(key), F.array_join(F.transform("parts", lambda x: x["own"]), "\n").alias("text"))
    return ids.hint("merge").join(found, key, "left")


def optional_csv(spark: SparkSession, path: str | None, columns: Sequence[str], key: str = "File") -> DataFrame:
    """A CSV by its key, the last row of a key; without a path, or where nothing is there, an empty table."""
    empty = spark.createDataFrame([], StructType([StructField(c, StringType()) for c in columns]))
    if not path:
        return empty
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return empty
    df = read_csv(spark, path, columns, fill=True).withColumn("ordinal", F.monotonically_increasing_id())
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), "ordinal").alias("last")).select("last.*")


def find_files(spark: SparkSession, path: str, pattern: str = "*.pdf", skip: Sequence[str] = (".git", "node_modules", "__pycache__", ".venv")) -> DataFrame:
    """(path, name): files below a folder by pattern, without those in the folders to skip; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path")
    junk = "|".join(f"\\Q{s}\\E" for s in skip)
    return found.where(~F.col("path").rlike(f"/({junk})/")).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))

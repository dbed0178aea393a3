"""Positions in texts: chunks, keyword windows, anchored cues, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from .places import KEY, keys, nearby


def chunks(docs: DataFrame, doc_id: str, text: str, size: int = 1600, stride: int = 800) -> DataFrame:
    """(doc_id, chunk_id, start, chunk): windows at every multiple of the stride within the text; short ones stay."""
    n = F.char_length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride)))
    each = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.posexplode(starts).alias("chunk_id", "start"))
    return each.select("doc_id", "chunk_id", "start", F.substring(F.col("_text"), F.col("start") + 1, F.lit(size)).alias("chunk"))


def section_of(chunk: Column, sections: list[tuple[str, str]], default: str = "body") -> Column:
    """The first section whose pattern occurs in a chunk."""
    out = F.lit(default)
    for pattern, name in reversed(sections):
        out = F.when(chunk.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def keyword_spans(docs: DataFrame, doc_id: str, text: str, keyword: str, width: int = 240) -> DataFrame:
    """(doc_id, st, en): the surroundings of each occurrence of a plain keyword, in characters from 0."""
    parts = F.split(F.lower(F.col(text)), F.lit("\\Q" + keyword.lower() + "\\E"))
    lengths = F.transform(parts, lambda p: F.char_length(p))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.char_length(text).alias("n"), F.slice(lengths, F.lit(1), F.size(lengths) - 1).alias("gaps"))
    each = d.select("doc_id", "n", F.posexplode("gaps").alias("i", "gap"))
    w = Window.partitionBy("doc_id").orderBy("i")
    at = F.sum("gap").over(w) + F.col("i") * len(keyword)
    return each.withColumn("at", at).select("doc_id", F.greatest(F.lit(0), F.col("at") - width).cast("int").alias("st"), F.least("n", F.col("at") + len(keyword) + width).cast("int").alias("en"))


def merge_spans(spans: DataFrame, key: str = "doc_id", gap: int = 50) -> DataFrame:
    """Spans joined where they overlap or nearly touch: (key, grp, st, en)."""
    before = Window.partitionBy(key).orderBy("st", "en").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy("st", "en").rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col("st") <= F.max("en").over(before) + gap, 0).otherwise(1)
    grouped = spans.withColumn("new", new).withColumn("grp", F.sum("new").over(upto))
    return grouped.groupBy(key, "grp").agg(F.min("st").alias("st"), F.max("en").alias("en"))


def anchored(docs: DataFrame, doc_id: str, text: str, cues: dict[str, str], anchors: str, width: int = 80) -> DataFrame:
    """(doc_id, labels): labels of which some cue begins with an anchor wholly within ``width`` characters on either side.

    Labels come in the order of ``cues``. Places of cues and anchors are rows that meet in a sweep over them.
    """
    near = nearby(docs, doc_id, text, {"": {k: [p] for k, p in cues.items()}}, {"": {"": [anchors]}}, width)
    found = near.where(F.size("kinds") > 0).groupBy(*KEY).agg(F.collect_set("label").alias("found"))
    labels = F.filter(F.array(*map(F.lit, cues)), lambda x: F.array_contains("found", x))
    own = docs.select(F.col(doc_id).alias("doc_id"), *keys(doc_id, text))
    return own.join(found, KEY, "left").select("doc_id", F.coalesce(labels, F.array().cast("array<string>")).alias("labels"))


def within(docs: DataFrame, doc_id: str, text: str, cue: str, anchor: str, width: int = 80) -> DataFrame:
    """The same for one plain cue and anchor, in expressions: (doc_id, hit)."""
    low = F.lower(F.col(text))
    gap = f"[\\s\\S]{{0,{width}}}"
    hit = low.rlike(f"\\Q{anchor}\\E{gap}\\Q{cue}\\E|\\Q{cue}\\E{gap}\\Q{anchor}\\E")
    return docs.select(F.col(doc_id).alias("doc_id"), hit.alias("hit"))


def budget(parts: DataFrame, key: str, order: str, text: str, limit: int, cut_last: bool = False) -> DataFrame:
    """The first parts of each key that fit a budget of characters; with ``cut_last`` the next one is cut to fit."""
    w = Window.partitionBy(key).orderBy(order)
    n = F.char_length(text)
    (upto,) = fresh(parts, "upto")
    d = parts.withColumn(upto, F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if not cut_last:
        return d.where(F.col(upto) <= limit).drop(upto)
    left = (F.lit(limit) - F.col(upto) + n).cast("int")
    return d.where(left > 0).withColumn(text, F.substring(F.col(text), F.lit(1), left)).drop(upto)


def distinct_parts(parts: DataFrame, key: str, order: str, identity: Column) -> DataFrame:
    """The first of the parts of a key that are the same."""
    same, nth = fresh(parts, "same", "nth")
    w = Window.partitionBy(key, F.col(same)).orderBy(order)
    return parts.withColumn(same, identity).withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).drop(nth, same)


def ranked_sections(docs: DataFrame, doc_id: str, text: str, separator: str, preferred: list[str], least: int = 200) -> DataFrame:
    """(doc_id, rank, section): sections longer than ``least``, those with more preferred patterns and then the longer ones first."""
    each = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), separator)).alias("i", "section")).where(F.char_length("section") > least)
    score = sum((F.col("section").rlike(f"(?i){p}").cast("int") for p in preferred), F.lit(0))
    w = Window.partitionBy("doc_id").orderBy(score.desc(), F.char_length("section").desc(), "i")
    return each.select("doc_id", F.row_number().over(w).alias("rank"), "section")


def title_line(docs: DataFrame, doc_id: str, text: str, first: int = 40) -> DataFrame:
    """(doc_id, title): the best of the first lines by length, commas and place; the later on ties."""
    lines = F.slice(F.split(F.col(text), "\n"), 1, first)
    each = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(lines).alias("i", "line")).withColumn("line", F.trim("line"))
    n, commas = F.char_length("line"), F.char_length("line") - F.char_length(F.replace("line", F.lit(","), F.lit("")))
    each = each.where((n >= 8) & (n <= 180) & (commas <= 3) & (F.size(F.split("line", " +")) >= 4))
    score = F.round(0.55 * F.least(n, F.lit(160)) / 160 + 0.25 / (1 + commas) + 0.20 / (1 + F.col("i")), 9)
    return each.groupBy("doc_id").agg(F.max_by("line", F.struct(score, "i")).alias("title"))

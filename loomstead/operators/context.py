"""Contexts for questions about a document: splitting, filtered retrieval, fallbacks, blending, compiling.

A document's own key is always a condition here, so no text of another document
gets into a context.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from .retrieve import word_counts
from .search import words


def split_recursively(docs: DataFrame, doc_id: str, text: str, size: int = 1600, overlap: int = 800, separators: Sequence[str] = ("\n\n", "\n", " ", "")) -> DataFrame:
    """(doc_id, chunk_id, chunk): pieces of at most ``size`` characters, cut at the coarsest separator that does, joined with up to ``overlap`` shared.

    Greedy choices along a text need a loop, so texts pass through Arrow batches; nothing is shuffled.
    """
    import pyarrow as pa

    def merge(parts: list[str], sep: str) -> list[str]:
        out, window, n = [], [], 0
        for p in parts:
            if window and n + len(p) + len(sep) * len(window) > size:
                out.append(sep.join(window))
                while window and (n + len(sep) * (len(window) - 1) > overlap or n + len(p) + len(sep) * len(window) > size):
                    n -= len(window.pop(0))
            window.append(p)
            n += len(p)
        return [*out, sep.join(window)] if window else out

    def cut(t: str, seps: Sequence[str]) -> list[str]:
        sep = next((s for s in seps if s == "" or s in t), "")
        rest = seps[list(seps).index(sep) + 1 :] if sep in seps else ()
        parts = [p for p in (t.split(sep) if sep else list(t)) if p]
        out: list[str] = []
        small: list[str] = []
        for p in parts:
            if len(p) <= size:
                small.append(p)
                continue
            out += merge(small, sep)
            small = []
            out += cut(p, rest) if rest else [p]
        return out + merge(small, sep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = [[c.strip() for c in cut(t.as_py() or "", separators) if c.strip()] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chunks, pa.list_(pa.string()))], ["doc_id", "chunks"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    cut_up = own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, chunks array<string>")
    return cut_up.select("doc_id", F.posexplode("chunks").alias("chunk_id", "chunk"))


def dot(a: Column, b: Column) -> Column:
    """The dot product of two vectors, as an expression."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def top_k_within(queries: DataFrame, rows: DataFrame, key: str, vector: str, group: str, k: int = 8) -> DataFrame:
    """(query, key, score, rank): the k nearest rows among those of the query's own group.

    An equi join on the group, so each row meets the queries of its document
    alone; the window keeps the best k of a partition before rows are moved.
    """
    q = queries.select(F.col(key).alias("query"), F.col(group).alias("g"), F.col(vector).alias("qv"))
    r = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(group).alias("g"), F.col(vector).alias("rv"))
    scored = q.join(r, "g").where("query <> key").select("query", "key", F.round(dot(F.col("qv"), F.col("rv")), 9).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fallback(key: str, *levels: DataFrame) -> DataFrame:
    """For each key the rows of the first level that has some."""
    out = None
    for i, level in enumerate(levels):
        each = level.withColumn("level", F.lit(i))
        out = each if out is None else out.unionByName(each, allowMissingColumns=True)
    least = F.min("level").over(Window.partitionBy(key))
    return out.withColumn("least", least).where("level = least").drop("least")


def prefer_sections(parts: DataFrame, key: str, order: str, section: str, avoided: Sequence[str] = ("related", "references", "acknowledgements"), most: int = 6) -> DataFrame:
    """The first parts outside the avoided sections, or of all where nothing else is there."""
    good = ~F.coalesce(F.col(section).isin(*avoided), F.lit(False))
    some = F.max(good).over(Window.partitionBy(key))
    w = Window.partitionBy(key).orderBy(order)
    (seen,) = fresh(parts, "some")
    d = parts.withColumn(seen, some).where(good | ~F.col(seen)).withColumn("nth", F.row_number().over(w))
    return d.where(F.col("nth") <= most).drop(seen)


def blend(key: str, item: str, k: int, *ranked: DataFrame) -> DataFrame:
    """(key, item, rank): the items of several ranked lists, one list after the other, each item once, k at most. Give all items last, to pad."""
    out = None
    for i, r in enumerate(ranked):
        each = r.select(F.col(key).alias(key), F.col(item).alias(item), F.struct(F.lit(i).alias("list"), F.col("rank").cast("long").alias("rank")).alias("at"))
        out = each if out is None else out.unionByName(each)
    once = out.groupBy(key, item).agg(F.min("at").alias("at"))
    w = Window.partitionBy(key).orderBy("at", item)
    return once.select(key, item, F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def bm25_within(parts: DataFrame, key: str, order: str, text: str, terms: Sequence[str], k: int = 12, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(key, order, score, rank): the parts of each document that match best, min(6, max(3, k / 4)) at most; statistics are each document's own."""
    (own,) = fresh(parts, "words")
    n, counts = word_counts(F.col(own), list(terms))
    d = parts.select(key, order, words(F.col(text)).alias(own)).select(key, order, n.alias("n"), *[c.alias(f"tf{i}") for i, c in enumerate(counts)])
    own = Window.partitionBy(key)
    mean = F.coalesce(F.nullif(F.avg("n").over(own), F.lit(0.0)), F.lit(1.0))  # a document without words has no score, whatever it is divided by
    d = d.withColumns({"parts": F.count(F.lit(1)).over(own), "mean": mean, **{f"df{i}": F.count_if(F.col(f"tf{i}") > 0).over(own) for i in range(len(terms))}})
    score = F.lit(0.0)
    for i in range(len(terms)):
        t, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.ln(1 + (F.col("parts") - df + 0.5) / (df + 0.5)) * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    d = d.select(key, order, F.round(score, 6).alias("score")).where("score > 0")
    w = Window.partitionBy(key).orderBy(F.desc("score"), order)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= min(6, max(3, k // 4)))


#: Characters that a token of a budget stands for.
CHARS_PER_TOKEN = {"plain": 4.0, "dense": 3.5, "loose": 5.0}


def char_budget(tokens: int | Column, kind: str = "plain") -> Column:
    """Characters for a budget of tokens."""
    return F.floor((tokens if isinstance(tokens, Column) else F.lit(tokens)) * CHARS_PER_TOKEN[kind]).cast("long")


def compile_context(parts: DataFrame, key: str, order: str, text: str, limit: int = 6000, joiner: str = "\n\n") -> DataFrame:
    """(key, context): a key's parts in order, joined and cut at ``limit``.

    Only parts that can be within the limit are gathered: a key's list is bounded by it.
    """
    n = F.char_length(text) + len(joiner)
    before = F.coalesce(F.sum(n).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = parts.select(key, F.col(order).alias("at"), F.col(text).alias("part"), before.alias("before")).where(F.col("before") < limit + len(joiner))
    joined = near.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    return joined.select(key, F.left(F.array_join(F.transform("parts", lambda x: x["part"]), joiner), F.lit(limit)).alias("context"))


def prompt(question: Column, context: Column, fields: Mapping[str, str], preamble: str = "Answer from the context alone.") -> Column:
    """A prompt: preamble, the fields and what they mean, the context between fences, and the question."""
    schema = "\n".join(f"- {name}: {what}" for name, what in fields.items())
    return F.concat(F.lit(f"{preamble}\n\nFields:\n{schema}\n\nContext:\n\"\"\"\n"), context, F.lit("\n\"\"\"\n\n"), question, F.lit("\n\nReturn JSON only."))


def answered(*tries: Column, policy_missing: Sequence[str] = ("", "not reported")) -> Column:
    """The first try that gave something: answers in the order they were asked for, rules last."""
    return F.coalesce(*[F.when(~F.lower(F.trim(t)).isin(*policy_missing), t) for t in tries])

"""Retrieval: exact similarity, maximal marginal relevance, BM25.

Searches hold a stated query set against all rows, in blocks; each pair of blocks
keeps its best k for each query before anything else is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import words
from .vectors import QUERIES, ROWS, best_pairs, in_blocks, ranked


def top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 10, block: int = QUERIES, exclude_self: bool = True) -> DataFrame:
    """(query, key, score, rank): the k rows with the highest dot product, by key on ties; scores are rounded to 9 digits first.

    Blocks of ``block`` queries meet blocks of rows as matrices, and each pair keeps the best k for each query;
    neither side is gathered on the driver. Null vectors are left out. A store with cells is ``operators.vectors``.
    """
    of = lambda d: d.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), F.lit(0).alias("cell"))
    asked, held = in_blocks(of(queries), block, "query").drop("cell"), in_blocks(of(rows), ROWS, "row").drop("cell")
    return ranked(best_pairs(held.crossJoin(asked), k, exclude_self), k)


def mmr(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 5, fetch_k: int = 24, weight: float = 0.5) -> DataFrame:
    """(query, key, rank): maximal marginal relevance among each query's ``fetch_k`` nearest rows."""
    import numpy as np
    import pandas as pd

    near = top_k(queries, rows, key, vector, fetch_k)
    near = near.join(rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")), "key")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        v, score = np.array(group["v"].tolist()), group["score"].to_numpy()
        picked: list[int] = []
        while len(picked) < min(k, len(group)):
            again = (v @ v[picked].T).max(axis=1) if picked else np.zeros(len(group))
            value = weight * score - (1 - weight) * again
            value[picked] = -np.inf
            picked.append(int(np.argmax(np.round(value, 9))))
        return pd.DataFrame({"query": group["query"].iloc[0], "key": group["key"].to_numpy()[picked], "rank": range(1, len(picked) + 1)})

    kind = rows.schema[key].dataType.simpleString()
    return near.groupBy("query").applyInPandas(choose, f"query {kind}, key {kind}, rank int")


def word_counts(text: Column, terms: list[str]) -> tuple[Column, list[Column]]:
    """How many words a text has, runs of a-z and 0-9 in lower case, and how often each term is one; put the words into a column first."""
    return F.size(text), [F.size(text) - F.size(F.array_remove(text, t)) for t in terms]


def bm25(docs: DataFrame, doc_id: str, text: str, terms: list[str], work: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(doc_id, score): BM25 of the documents that hold one of the terms; scores rounded to 6 digits.

    Texts are read once: what is counted in them is written to ``work``, a new shared folder.
    """
    n, counts = word_counts(F.col("words"), terms)
    d = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("words"))
    d.select("doc_id", n.alias("n"), *[c.alias(f"tf{i}") for i, c in enumerate(counts)]).write.parquet(work)
    d = docs.sparkSession.read.parquet(work)
    total = d.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.nullif(F.avg("n"), F.lit(0.0)), F.lit(1.0)).alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    d = d.join(F.broadcast(total))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        t, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.ln(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        score = score + idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return d.where(" + ".join(f"tf{i}" for i in range(len(terms))) + " > 0").select("doc_id", F.round(score, 6).alias("score"))

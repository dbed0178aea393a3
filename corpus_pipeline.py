"""A training-corpus pipeline: five stages, each over all that the one before kept.

The stages drop toxic documents, drop documents that break a quality rule, keep
one document of each group of near copies, drop documents contaminated by the
benchmark, and pack the rest into token sequences. Every stage but the last
returns the columns of ``documents``. SQL can't express the classifier and the
tokenizer, so ORACLE_SQL is None; tests hold the stages against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstead.llm import decontaminate, jaccard, packing, quality, tokens, toxicity
from loomstead.llm.common import Workspace, table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows whose toxicity score is below one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows that the quality rules keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), Workspace(spark, "quality"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of near copies."""
    return jaccard.keep_one_of_each(docs, Workspace(spark, "jaccard"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows that the benchmark doesn't contaminate."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs, Workspace(spark, "packing"), tokens.default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_bad),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written and read again."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"stage{i}")
    return docs

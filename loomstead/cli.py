"""Whole runs over CSV files and folders of texts: ``python -m loomstead COMMAND --help``.

Paths are whatever Spark reads. Results are written as CSV folders with a header.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.missing import norm_key
from .operators import evaluate, extract, fuse, normalize, report
from .sources import readers

#: The columns of an extraction table and the names that operators use.
NAMES = {
    "Modality": "modality", "Datasets (train)": "train", "Datasets (eval)": "eval_", "Paired": "paired", "VLM?": "vlm", "Model": "model", "Class": "klass", "Task": "task", "Vision Enc": "vision",
    "Lang Dec": "language", "Fusion": "fusion", "Objectives": "objectives", "Family": "family", "RAG": "rag", "Metrics(primary)": "metrics",
}
#: Columns that are fused by union; all others by vote.
UNITED = ("Datasets (train)", "Datasets (eval)", "Vision Enc", "Lang Dec", "Fusion", "Objectives", "Metrics(primary)")


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _fields(a: argparse.Namespace, *tables: DataFrame) -> list[str]:
    """The fields asked for, or all that the tables share."""
    common = [c for c in readers.common_columns(*tables) if c not in (a.key, "ordinal")]
    return [c for c in a.fields if c in common] if a.fields else common


def _keyed(spark: SparkSession, path: str, a: argparse.Namespace) -> DataFrame:
    """A table by its key in one spelling; the last row of a key counts."""
    df = readers.read_csv(spark, path, fill=True).withColumn("ordinal", F.monotonically_increasing_id())
    df = df.withColumn(a.key, norm_key(F.col(f"`{a.key}`"), a.key_variant))
    return evaluate.last_wins(df, F.col(f"`{a.key}`"), "ordinal").drop("ordinal")


def run_extract(spark: SparkSession, a: argparse.Namespace) -> None:
    _write(extract.extract(readers.read_texts_by_preference(spark, a.texts), "doc_id", "text", a.mode), a.out)


def run_clean(spark: SparkSession, a: argparse.Namespace) -> None:
    df = readers.read_csv(spark, a.table, fill=True)
    d = df.select(F.col(f"`{a.key}`").alias("key"), F.monotonically_increasing_id().alias("ordinal"), *[(F.col(f"`{c}`") if c in df.columns else F.lit("")).alias(n) for c, n in NAMES.items()])
    out = normalize.clean(d, "key", coarse=a.coarse, primary_only=a.primary_model_only)
    if a.mask:
        mask = readers.read_keyed(spark, a.mask).select("key", F.col("RAG").alias("mask"))
        out = fuse.backfill(out, mask, "key", "rag", F.when(F.col("mask").isin("1", "1.0", "true", "True", "yes", "Yes", "Y", "y"), "Yes"))
    if a.best:
        filled = fuse.filled_count(list(NAMES.values()))
        out = fuse.best_row(out, norm_key(F.col("key"), "lower"), [filled, (F.col("family") != "").cast("int")], "ordinal")
    _write(out.select(F.col("key").alias(a.key), *[F.col(n).alias(c) for c, n in NAMES.items()]), a.out)


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    gold, pred = (readers.read_csv(spark, p) for p in (a.gold, a.pred))
    long = evaluate.pairs(gold, pred, a.key, _fields(a, gold, pred))
    _write(evaluate.two_stage(long, tokens=a.tokens), f"{a.out}/summary")
    report.write_by_field(evaluate.mismatches(long, tokens=a.tokens), f"{a.out}/mismatches")
    report.write_by_field(evaluate.missing_predictions(long), f"{a.out}/missing")


def run_gold(spark: SparkSession, a: argparse.Namespace) -> None:
    gold, pred = (readers.read_csv(spark, p) for p in (a.gold, a.pred))
    _write(evaluate.set_scores(evaluate.pairs(gold, pred, a.key, _fields(a, gold, pred), how="inner")), a.out)


def run_coverage(spark: SparkSession, a: argparse.Namespace) -> None:
    df = readers.read_csv(spark, a.table)
    fields = _fields(a, df)
    _write(evaluate.coverage(df, a.key, fields), f"{a.out}/columns")
    _write(evaluate.coverage_of_rows(df, a.key, fields), f"{a.out}/rows")


def run_compare(spark: SparkSession, a: argparse.Namespace) -> None:
    base, target = (readers.read_csv(spark, p) for p in (a.base, a.target))
    _write(report.side_by_side("metric", report.table_figures(base, "base"), report.table_figures(target, "target")), f"{a.out}/figures")
    _write(evaluate.compare_versions(evaluate.pairs(base, target, a.key, _fields(a, base, target))), f"{a.out}/fields")


def run_availability(spark: SparkSession, a: argparse.Namespace) -> None:
    base, target, mask = (_keyed(spark, p, a) for p in (a.base, a.target, a.mask))
    fields = _fields(a, base, target, mask)
    long = evaluate.to_long(base, a.key, fields, "base").join(evaluate.to_long(target, a.key, fields, "target"), ["key", "field"]).join(evaluate.to_long(mask, a.key, fields, "mask"), ["key", "field"])
    _write(evaluate.availability_comparison(long, applicable=a.apply, listed=a.listed or ()), a.out)


def run_misses(spark: SparkSession, a: argparse.Namespace) -> None:
    mask, pred = (_keyed(spark, p, a) for p in (a.mask, a.pred))
    fields = _fields(a, mask, pred)
    long = evaluate.to_long(mask, a.key, fields, "mask").join(evaluate.to_long(pred, a.key, fields, "pred"), ["key", "field"])
    _write(evaluate.misses(long).select("key", "field"), a.out)


def run_fuse(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = None
    for i, path in enumerate(a.tables):
        each = readers.read_csv(spark, path).withColumn("ordinal", F.lit(i * 2**40) + F.monotonically_increasing_id())
        rows = each if rows is None else rows.unionByName(each, allowMissingColumns=True)
    fields = [c for c in rows.columns if c not in (a.key, "ordinal")]
    _write(fuse.fuse_table(rows, a.key, [c for c in fields if c not in UNITED], [c for c in fields if c in UNITED], "ordinal"), a.out)


def parser() -> argparse.ArgumentParser:
    """All commands; every one writes to ``--out``."""
    top = argparse.ArgumentParser(prog="loomstead", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *paths: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for x in paths:
            p.add_argument(f"--{x}", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--key", default="File")
        p.add_argument("--key-variant", default="lower", choices=["raw", "one_txt", "lower", "cased", "any_txt"])
        p.add_argument("--fields", nargs="*")
        p.set_defaults(run=run)
        return p

    add("extract", run_extract, "texts").add_argument("--mode", default="strict", choices=["strict", "hybrid"])
    p = add("clean", run_clean, "table")
    p.add_argument("--primary-model-only", action="store_true", help="the named family alone, or else the first token, as the model")
    p.add_argument("--mask")
    p.add_argument("--coarse", action="store_true")
    p.add_argument("--best", action="store_true")
    add("evaluate", run_evaluate, "gold", "pred").add_argument("--tokens", action="store_true")
    add("gold", run_gold, "gold", "pred")
    add("coverage", run_coverage, "table")
    add("compare", run_compare, "base", "target")
    p = add("availability", run_availability, "base", "target", "mask")
    p.add_argument("--apply", default="mask", choices=["mask", "all", "list"])
    p.add_argument("--listed", nargs="*")
    add("misses", run_misses, "mask", "pred")
    add("fuse", run_fuse).add_argument("--tables", nargs="+", required=True)
    return top


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    a.run(spark or SparkSession.builder.appName("loomstead").getOrCreate(), a)

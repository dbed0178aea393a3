"""Reports over versions of a table: whole-table figures, folds of summaries, fixed orders, provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import is_missing, truthy


def table_figures(df: DataFrame, label: str, fields: Sequence[str] | None = None, policy: str = "compare", extra: tuple[str, ...] = ()) -> DataFrame:
    """(metric, label): rows, cols, total_fields, missing_fields, filled_fields and coverage_% of a whole table, its key column too."""
    fields = list(fields or df.columns)
    missing = sum((is_missing(F.col(f"`{c}`").cast("string"), policy, extra).cast("long") for c in fields), F.lit(0))
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing"))
    n, total = len(fields), F.col("rows") * len(fields)
    share = F.round(F.coalesce(F.try_divide(100.0 * (total - F.col("missing")), total), F.lit(0.0)), 2)
    each = {"rows": F.col("rows"), "cols": F.lit(n), "total_fields": total, "missing_fields": F.col("missing"), "filled_fields": total - F.col("missing"), "coverage_%": share}
    return one.select(*[x.cast("double").alias(k) for k, x in each.items()]).unpivot([], list(each), "metric", label)


def column_figures(df: DataFrame, label: str, policy: str = "compare", extra: tuple[str, ...] = ()) -> DataFrame:
    """(field, missing_label, unique_label): missing cells and distinct values of every column."""
    cells = [F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns]
    each = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    return each.groupBy("field").agg(F.count_if(is_missing(F.col("value"), policy, extra)).alias(f"missing_{label}"), F.countDistinct("value").alias(f"unique_{label}"))


def side_by_side(key: str, *summaries: DataFrame) -> DataFrame:
    """Several summaries on one key, side by side; a full outer fold, so no key of any of them is lost."""
    return reduce(lambda a, b: a.join(b, key, "full"), summaries)


def in_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Rows by the place of a value in a fixed list; values that aren't in it come last."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.orderBy(F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(len(order) + 1), column)


def place_in(c: Column, order: Sequence[str]) -> Column:
    """The place of a value in a fixed list, from 1; 0 if it isn't in it."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), c), F.lit(0))


def not_reported(df: DataFrame, fields: Sequence[str], label: str, policy: str = "backfill") -> DataFrame:
    """(field, label): missing cells of each field."""
    one = df.agg(*[F.count_if(is_missing(F.col(f"`{c}`").cast("string"), policy)).alias(c) for c in fields])
    return one.unpivot([], list(fields), "field", label)


def provenance_wide(df: DataFrame, key: str, column: str, fields: Sequence[str], default: str = "missing") -> DataFrame:
    """A row for each key and a column for each field: the source that a JSON map names for it."""
    sources = F.from_json(column, "map<string,string>")
    return df.select(key, *[F.coalesce(F.try_element_at(sources, F.lit(f)), F.lit(default)).alias(f) for f in fields])


def applicable(mask: Column, field: Column, policy: str = "mask", always: Sequence[str] = ()) -> Column:
    """Whether a field counts for a row: by its mask, for all rows, or by a list of fields that always do."""
    return {"mask": truthy(mask, "positive"), "all": F.lit(True), "list": F.when(field.isin(*always), True).otherwise(truthy(mask, "positive"))}[policy]


def keys_present(df: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """The rows whose key occurs in one of the other tables."""
    known = reduce(DataFrame.unionByName, [o.select(key) for o in others])
    return df.join(known, key, "left_semi")


def miss_summary(counts: DataFrame, total: int, title: str = "Misses") -> DataFrame:
    """(line): a short Markdown report of misses by field, most first; a line for each field."""
    head = counts.sparkSession.createDataFrame([(0, f"# {title}"), (1, ""), (2, f"{total} rows"), (3, "")], "i long, line string")
    rows = counts.orderBy(F.desc("n"), "field").select(F.concat(F.lit("- "), F.col("field"), F.lit(": "), F.col("n").cast("string")).alias("line"))
    numbered = rows.withColumn("i", F.monotonically_increasing_id() + 4)
    return head.unionByName(numbered.select("i", "line")).orderBy("i").select("line")


def safe_name(field: str) -> str:
    """A field as part of a file name."""
    return field.replace(" ", "_").replace("/", "-")


def write_by_field(long: DataFrame, path: str, field: str = "field") -> dict[str, str]:
    """A CSV folder for each field; returns their paths. Fields are few: they are a table's columns."""
    names: Mapping[str, str] = {r[0]: f"{path}/{safe_name(r[0])}" for r in long.select(field).distinct().collect()}
    for value, at in names.items():
        long.where(F.col(field) == value).write.mode("overwrite").option("header", True).csv(at)
    return dict(names)

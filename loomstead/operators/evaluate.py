"""Scoring a predicted table against a gold one, on one long form (key, field, gold, pred).

All fields are scored in one aggregation, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import is_filled, is_missing, truthy
from ..functions.stats import f1, mcnemar, ratio, wilson
from ..functions.tokens import label_set, token_set


def to_long(df: DataFrame, key: str, fields: Sequence[str], value: str = "value") -> DataFrame:
    """(key, field, value) with nulls kept."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias(value)) for f in fields])
    return df.select(F.col(key).alias("key"), F.explode(cells).alias("cell")).select("key", "cell.*")


def pairs(gold: DataFrame, pred: DataFrame, key: str, fields: Sequence[str], how: str = "left") -> DataFrame:
    """(key, field, gold, pred); keys that repeat fan out, as in any join."""
    g = gold.select(F.col(key).alias("key"), F.array(*[F.col(f"`{f}`").cast("string") for f in fields]).alias("g"))
    p = pred.select(F.col(key).alias("key"), F.array(*[F.col(f"`{f}`").cast("string") for f in fields]).alias("p"))
    both = g.join(p, "key", how)
    names = F.array(*[F.lit(f) for f in fields])
    each = both.select("key", "g", "p", F.posexplode(names).alias("i", "field"))
    return each.select("key", "field", F.col("g")[F.col("i")].alias("gold"), F.col("p")[F.col("i")].alias("pred"))


def last_wins(df: DataFrame, key: Column, ordinal: str) -> DataFrame:
    """One row for each key: the one with the highest ordinal."""
    row = F.max_by(F.struct(*df.columns), F.col(ordinal)).alias("row")
    return df.groupBy(key).agg(row).select("row.*")


def two_stage(long: DataFrame, tokens: bool = False, policy: str = "eval", extra: tuple[str, ...] = ()) -> DataFrame:
    """Availability first, correctness second, for each field. Ratios over nothing are 0."""
    a, p = is_filled(F.col("gold"), policy, extra), is_filled(F.col("pred"), policy, extra)
    same = token_set(F.col("gold")) == token_set(F.col("pred")) if tokens else F.col("gold") == F.col("pred")
    n = long.select("field", a.alias("a"), p.alias("p"), (a & p & F.coalesce(same, F.lit(False))).alias("c")).groupBy("field").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if("a").alias("available_gold"),
        F.count_if("p").alias("pred_present"),
        F.count_if(F.col("a") & F.col("p")).alias("tp"),
        F.count_if(~F.col("a") & F.col("p")).alias("fp"),
        F.count_if(F.col("a") & ~F.col("p")).alias("fn"),
        F.count_if("c").alias("correct"),
    )
    c = F.col
    n = n.withColumn("precision", ratio(c("tp"), c("tp") + c("fp"))).withColumn("recall", ratio(c("tp"), c("tp") + c("fn")))
    return n.withColumns(
        {
            "f1": F.round(f1(c("precision"), c("recall")), 6),
            "coverage_ceiling": F.round(ratio(c("correct"), c("available_gold")), 6),
            "yield_end_to_end": F.round(ratio(c("correct"), c("total_rows")), 6),
        }
    ).withColumns({x: F.round(x, 6) for x in ("precision", "recall")})


def mismatches(long: DataFrame, tokens: bool = False, policy: str = "eval", extra: tuple[str, ...] = (), with_missing: bool = False) -> DataFrame:
    """Available values that are predicted wrongly; ``with_missing`` adds those not predicted."""
    a, p = is_filled(F.col("gold"), policy, extra), is_filled(F.col("pred"), policy, extra)
    same = token_set(F.col("gold")) == token_set(F.col("pred")) if tokens else F.col("gold") == F.col("pred")
    return long.where(a & (F.lit(True) if with_missing else p) & ~F.coalesce(same, F.lit(False)))


def missing_predictions(long: DataFrame, policy: str = "eval", extra: tuple[str, ...] = ()) -> DataFrame:
    """Available values without a prediction."""
    return long.where(is_filled(F.col("gold"), policy, extra) & is_missing(F.col("pred"), policy, extra))


def set_scores(long: DataFrame, total: str = "__MICRO__") -> DataFrame:
    """Precision, recall and F1 of exact label sets, with a row over all fields.

    A wrong set counts as a false positive and as a false negative; where both
    are empty nothing counts; ratios over nothing are 1.
    """
    g, p = label_set(F.col("gold")), label_set(F.col("pred"))
    d = long.select("field", (F.size(g) > 0).alias("g"), (F.size(p) > 0).alias("p"), (g == p).alias("same"))
    c = F.col
    n = d.groupBy("field").agg(
        F.count_if(c("g") & c("same")).alias("tp"), F.count_if(c("p") & ~c("same")).alias("fp"), F.count_if(c("g") & ~c("same")).alias("fn")
    )
    n = n.unionByName(n.agg(F.lit(total).alias("field"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")]))
    n = n.withColumn("precision", ratio(c("tp"), c("tp") + c("fp"), 1.0)).withColumn("recall", ratio(c("tp"), c("tp") + c("fn"), 1.0))
    return n.withColumn("f1", F.round(f1(c("precision"), c("recall")), 6)).withColumns({x: F.round(x, 6) for x in ("precision", "recall")})


def coverage(df: DataFrame, key: str, fields: Sequence[str], policy: str = "coverage", extra: tuple[str, ...] = ()) -> DataFrame:
    """Filled share of each field, and over all of them as field "overall"."""
    c = to_long(df, key, fields).withColumn("filled", is_filled(F.col("value"), policy, extra)).groupBy("field").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if("filled").alias("filled")
    )
    every = c.agg(F.lit("overall").alias("field"), F.sum("cells").alias("cells"), F.sum("filled").alias("filled"))
    return c.unionByName(every).withColumn("coverage", F.round(ratio(F.col("filled"), F.col("cells")), 6))


def coverage_of_rows(df: DataFrame, key: str, fields: Sequence[str], policy: str = "coverage", extra: tuple[str, ...] = ()) -> DataFrame:
    """Filled share of each row."""
    filled = sum((is_filled(F.col(f"`{f}`").cast("string"), policy, extra).cast("int") for f in fields), F.lit(0))
    return df.select(F.col(key).alias("key"), filled.cast("long").alias("filled"), F.round(filled / len(fields), 6).alias("coverage"))


def coverage_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """The change of coverage between two results of ``coverage``."""
    x, y = (d.select("field", F.col("coverage").alias(n)) for d, n in ((a, "before"), (b, "after")))
    return x.join(y, "field", "full").withColumn("delta", F.round(F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)), 6))


def compare_versions(long: DataFrame, policy: str = "compare", extra: tuple[str, ...] = ()) -> DataFrame:
    """Of two versions (gold: the older, pred: the newer): missing cells, distinct values, improved and degraded cells by field."""
    a, b = is_missing(F.col("gold"), policy, extra), is_missing(F.col("pred"), policy, extra)
    return long.groupBy("field").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(a).alias("missing_before"),
        F.count_if(b).alias("missing_after"),
        F.countDistinct("gold").alias("distinct_before"),
        F.countDistinct("pred").alias("distinct_after"),
        F.count_if(a & ~b).alias("improved"),
        F.count_if(~a & b).alias("degraded"),
    )


def availability_comparison(long: DataFrame, policy: str = "long_dashes", extra: tuple[str, ...] = (), applicable: str = "mask", listed: Sequence[str] = ()) -> DataFrame:
    """Coverage of two predictions, apparent and over what is available, with intervals and a paired test.

    ``long`` has field, mask, base and target. applicable: "mask" (the mask
    says), "all", or "list" (fields in ``listed`` always, all others by mask).
    """
    mask = truthy(F.col("mask"), "positive")
    avail = {"mask": mask, "all": F.lit(True), "list": F.when(F.col("field").isin(*listed), True).otherwise(mask)}[applicable]
    x, y = is_filled(F.col("base"), policy, extra), is_filled(F.col("target"), policy, extra)
    d = long.select("field", avail.alias("a"), x.alias("x"), y.alias("y"))
    c = F.col
    n = d.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("a").alias("avail_n"),
        F.count_if("x").alias("base_filled"),
        F.count_if("y").alias("target_filled"),
        F.count_if(c("a") & c("x")).alias("base_hit"),
        F.count_if(c("a") & c("y")).alias("target_hit"),
        F.count_if(c("a") & c("x") & ~c("y")).alias("lost"),
        F.count_if(c("a") & ~c("x") & c("y")).alias("won"),
    )
    low, high = wilson(c("target_hit"), c("avail_n"))
    return n.withColumns(
        {
            "apparent_delta": F.round(ratio(c("target_filled"), c("n")) - ratio(c("base_filled"), c("n")), 6),
            "adjusted_base": F.round(ratio(c("base_hit"), c("avail_n")), 6),
            "adjusted_target": F.round(ratio(c("target_hit"), c("avail_n")), 6),
            "miss_rate": F.round(ratio(c("avail_n") - c("target_hit"), c("avail_n")), 6),
            "ci_low": F.round(low, 6),
            "ci_high": F.round(high, 6),
            "p_value": F.round(mcnemar("lost", "won"), 6),
        }
    )


def misses(long: DataFrame, policy: str = "eval", extra: tuple[str, ...] = ()) -> DataFrame:
    """Cells that the mask says exist and the prediction lacks. ``long`` has key, field, mask and pred."""
    return long.where(truthy(F.col("mask")) & is_missing(F.col("pred"), policy, extra))


def error_taxonomy(wrong: DataFrame, several: str = r"[,+]|\band\b") -> DataFrame:
    """Of mismatches: how many have several items on a side."""
    many = F.col("gold").rlike(several) | F.col("pred").rlike(several)
    return wrong.groupBy("field").agg(F.count(F.lit(1)).alias("wrong"), F.count_if(many).alias("several_items"))


def accuracy(expected: DataFrame, answers: DataFrame, key: str, value: str, same: Callable[[Column, Column], Column] = lambda a, b: a == b) -> DataFrame:
    """The share of all expected rows that are answered exactly."""
    d = expected.select(key, F.col(value).alias("e")).join(answers.select(key, F.col(value).alias("a")), key, "left")
    return d.agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.coalesce(same(F.col("e"), F.col("a")), F.lit(False))).alias("right")).withColumn(
        "accuracy", F.round(ratio(F.col("right"), F.col("expected")), 6)
    )

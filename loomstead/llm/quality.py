"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

``measure`` counts what the rules look at. ``fixed_rules`` is the base: too few
words, or over half of them in repeated three-word windows. On top of it,
``calibrate`` chooses for each stratum and rule the strictest cutoff for which a
labelled holdout shows, by an exact binomial test, that at most a share
``risk`` of the good documents is rejected:

* the null hypothesis of a cutoff is "it rejects more than risk / (number of
  rules) of the good documents of this stratum". With k of n good labelled
  documents rejected its p-value is P(Bin(n, risk / rules) <= k), computed in
  logarithms without approximation;
* all strata, rules and cutoffs are tested together with Bonferroni's
  correction, so with probability 1 - delta no chosen cutoff breaks its bound,
  and by the union over the rules no stratum loses more than ``risk``;
* a stratum with too few labels passes no test and gets no cutoff: then its
  documents are judged by the fixed rules alone.

Words within a text that repeat are found by sorting 64-bit hashes of its
three-word windows with the positions in the low bits; should two different
windows of a text ever meet in the high bits, that text's windows are sorted by
their words instead, so counts are exact.

Texts are measured once: ``quality_rules`` writes the measures, ``keep_good`` the
rows with their measures, and calibration reads the measures' columns alone. No
text is shuffled.

Defined cases: a null text has no words; null ids and null strata are kept (null
strata share one stratum); repeated rows each get a row; labels that are null
don't count, and a document labelled more than once counts as good if its
highest label is good; empty tables work; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Workspace, table, text_of

#: (rule, measure, cutoffs from strict to loose): a document is rejected if the measure is above the cutoff.
RULES: tuple[tuple[str, str, tuple[float, ...]], ...] = (
    ("symbols", "n_symbols / n_words", (0.05, 0.1, 0.2, 0.4, 0.8)),
    ("duplicate_lines", "n_dup_lines / n_words", (0.005, 0.01, 0.02, 0.04, 0.08)),
    ("repeats", "n_repeat_words / n_words", (0.1, 0.2, 0.3, 0.4)),
    ("long_words", "word_chars / n_words", (8.0, 10.0, 14.0, 20.0)),
    ("capitals", "n_capitals / word_chars", (0.1, 0.2, 0.3, 0.5)),
)
RISK, DELTA = 0.05, 0.05
WINDOW_HASH = "xxhash64(words[i - 1], words[i], words[i + 1])"


def measure(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    window_hash: str = WINDOW_HASH,
    carry: bool = False,
) -> DataFrame:
    """doc_id, stratum and the counts of each row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals.

    With ``carry`` the whole input row comes along as the struct ``row``. Write
    the result before filtering it by the counts: else Spark moves conditions, with all
    that the counts are made of, below the steps that make them.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rest = ["row"] if carry else []
    count = lambda other: F.char_length(F.regexp_replace("text", other, "")).cast("long")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        text_of(text).alias("text"),
        *row,
    ).select(
        "doc_id",
        "stratum",
        F.filter(F.split("text", SPACES), lambda w: w != "").alias("words"),
        count(SPACES).alias("word_chars"),
        count(r"[^#*$%&|<>]+").alias("n_symbols"),
        count("[^A-Z]+").alias("n_capitals"),
        lines.alias("lines"),
        *rest,
    )
    d = d.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "bits": F.length(F.conv(F.size("words").cast("string"), 10, 2)),
        }
    ).drop("lines")
    # high bits: the window's hash; low bits: its position, from 1, in as many bits as this text needs
    d = d.withColumn(
        "keys",
        F.expr(
            "if(n_words < 3, cast(array() as array<bigint>), sort_array(transform(sequence(1, cast(n_words as int) - 2),"
            f" i -> shiftleft(shiftright({window_hash}, bits), bits) | cast(i as bigint))))"
        ),
    )
    same = "shiftright(keys[{0}], bits) = shiftright(x, bits)"
    place = "cast({0} & (shiftleft(1L, bits) - 1) as int)"
    d = d.withColumns(
        {
            "met": F.expr(
                "exists(sequence(1, size(keys)), j -> j < size(keys) and shiftright(keys[j], bits) = shiftright(keys[j - 1], bits)"
                f" and slice(words, {place.format('keys[j]')}, 3) <> slice(words, {place.format('keys[j - 1]')}, 3))"
            ),
            "places": F.expr(
                f"transform(filter(keys, (x, j) -> (j > 0 and {same.format('j - 1')}) or (j + 1 < size(keys) and {same.format('j + 1')})), x -> {place.format('x')})"
            ),
        }
    )
    # by the words themselves: n log n steps, too
    ordered = "sort_array(transform(sequence(1, cast(n_words as int) - 2), i -> named_struct('w', slice(words, i, 3), 'i', i)))"
    slow = f"element_at(transform(array({ordered}), k -> transform(filter(k, (x, j) -> (j > 0 and k[j - 1].w = x.w) or (j + 1 < size(k) and k[j + 1].w = x.w)), x -> x.i)), 1)"
    repeats = F.expr(
        f"aggregate(sort_array(if(met, {slow}, places)), named_struct('end', 0, 'n', 0L),"
        " (s, p) -> named_struct('end', p + 3, 'n', s.n + 3 - greatest(0, s.end - p)), s -> s.n)"
    )
    return d.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"), "n_capitals", *rest)


def fixed_rules() -> Column:
    """True for a document that fails the base rules."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(n: str, k: str, p: float) -> str:
    """SQL for P(Bin(n, p) <= k); 1 where k > n p, which no test passes. Takes of the order of k steps."""
    top = (
        f"aggregate(sequence(0, {k}), 0D, (s, i) -> s + if(i = 0, 0D, ln(({n} - i + 1) / cast(i as double))))"
        f" + {k} * ln({p}D) + ({n} - {k}) * ln(1D - {p}D)"
    )
    rest = (
        f"aggregate(sequence(0, {k}), named_struct('t', 1D, 's', 0D), (a, i) -> named_struct("
        f"'t', a.t * ({k} - i) / ({n} - {k} + i + 1) * ((1D - {p}D) / {p}D), 's', a.s + a.t), a -> a.s)"
    )
    return f"if({k} > {n} * {p}D, 1D, least(1D, exp({top} + ln({rest}))))"


def calibrate(features: DataFrame, labels: DataFrame, rules=RULES, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Every test: stratum, rule, cutoff, n (good labelled documents), k (rejected ones), p_value, passed."""
    good = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .where("quality = 1")
        .select("doc_id")
    )
    held = features.where(~fixed_rules()).join(good, "doc_id", "left_semi")
    tests = [(rule, cut, f"{m} > {cut}D") for rule, m, cuts in rules for cut in cuts]
    counted = held.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(what)).alias(f"k{i}") for i, (_, _, what) in enumerate(tests)]
    )
    stack = ", ".join(f"'{rule}', {cut}D, k{i}" for i, (rule, cut, _) in enumerate(tests))
    out = counted.selectExpr("stratum", "n", f"stack({len(tests)}, {stack}) as (rule, cutoff, k)")
    share = risk / len(rules)
    every = counted.agg((F.count(F.lit(1)) * len(tests)).alias("tests"))
    return (
        out.withColumn("p_value", F.expr(binomial_tail("n", "k", share)))
        .join(F.broadcast(every))  # one row
        .withColumn("passed", F.col("p_value") <= F.lit(delta) / F.col("tests"))
        .drop("tests")
    )


def judge(features: DataFrame, tests: DataFrame, rules=RULES) -> DataFrame:
    """``features`` with base_failed, rejected_by (the rules that reject, as an array) and kept."""
    cutoffs = tests.where("passed").groupBy("stratum").agg(
        *[F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule, _, _ in rules]
    )
    d = features.join(cutoffs, "stratum", "left").withColumn("base_failed", fixed_rules())
    against = [F.when(F.expr(f"if(n_words > 0, {m}, 0D)") > F.col(f"cut_{rule}"), F.lit(rule)) for rule, m, _ in rules]
    d = d.withColumn("rejected_by", F.array_compact(F.array(*against)))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
    return d.select(*features.columns, "base_failed", "rejected_by", "kept")


def quality_rules(docs: DataFrame, labels: DataFrame, work: Workspace, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Measure, calibrate and judge. The measures are written once, since both other steps read them."""
    features = work.save(measure(docs, stratum=stratum), "features")
    return judge(features, calibrate(features, labels, risk=risk, delta=delta))


def keep_good(docs: DataFrame, labels: DataFrame, work: Workspace) -> DataFrame:
    """The rows of ``docs``, as they are, that the rules keep. They are written with their measures, for calibration and verdict."""
    measured = work.save(measure(docs, carry=True), "measured")
    tests = work.save(calibrate(measured.drop("row"), labels), "tests")
    return judge(measured, tests).where("kept").select("row.*")


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality verdict of every document."""
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark, "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

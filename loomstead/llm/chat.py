"""Chat formatting by prefix-target expansion, in DataFrame expressions only.

A conversation with k assistant turns becomes k training examples. Example j
holds every turn up to the j-th assistant turn, and only that reply is
trainable. Turns that follow the last assistant turn (or a conversation that
has none) give one more example without a target, so no turn is lost.

The template marks a turn as ``<s>[TURN]role[/TURN]text</s>``. Inside roles and
texts a backslash is put after the first character of every control string, and
one more is put into strings that already look escaped, so ``unescape`` gives
back exactly what went in.

A conversation is gathered in one row, and every example repeats its context, as
the method has it: k assistant turns of m characters give about m k (k + 1)
characters, so 100 of 1,000 characters each ten million. What has to fit into a
task is one conversation and its examples; other conversations don't add to it.

Defined cases: null text and null role are empty; null turn numbers sort first;
rows of one conversation that share a turn number are kept, ordered by role and
then text; a null conversation id is a conversation of its own; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"(/?s>|/?TURN\])"
OPEN, MIDDLE, CLOSE = "<s>[TURN]", "[/TURN]", "</s>"


def escape(text: Column) -> Column:
    """Make control strings inside a text inert."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def format_conversations(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    target: str = "assistant",
) -> DataFrame:
    """One row for each training example.

    Returns conv_id, example (from 0), n_turns (in this example), formatted,
    loss_start and loss_end (code points of the trainable text within
    ``formatted``; both null in an example without a target).
    """
    turns = rows.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).cast("long").alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    convs = convs.withColumn(
        "parts",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == target).alias("hit"),
                F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        ),
    )
    ends = F.filter(
        F.sequence(F.lit(1), F.size("parts")),
        lambda i: F.element_at("parts", i)["hit"] | (i == F.size("parts")),
    )
    out = convs.select("conv_id", "parts", F.posexplode(ends).alias("example", "n_turns"))
    last = F.element_at("parts", F.col("n_turns"))
    text_before = F.array_join(
        F.transform(
            F.slice("parts", F.lit(1), F.col("n_turns") - 1),
            lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE)),
        ),
        "",
    )
    out = out.select(
        "conv_id",
        "example",
        "n_turns",
        F.concat(text_before, last["head"]).alias("before"),
        last["body"].alias("body"),
        last["hit"].alias("hit"),
    )
    start = F.when(F.col("hit"), F.char_length("before").cast("long"))
    return out.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.col("n_turns").cast("long").alias("n_turns"),
        F.concat("before", "body", F.lit(CLOSE)).alias("formatted"),
        start.alias("loss_start"),
        (start + F.char_length("body")).alias("loss_end"),
    )


def read_back(formatted: Column) -> Column:
    """The turns in a formatted text, as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, r"(?s)^<s>\[TURN\](.*?)\[/TURN\]", 1)).alias("role"),
            unescape(F.regexp_replace(p, r"(?s)^<s>\[TURN\].*?\[/TURN\]", "")).alias("text"),
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say, read back from their formatted text."""
    loss = unescape(
        F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    )
    own = examples.select(
        "conv_id",
        "n_turns",
        F.char_length("formatted").cast("long").alias("chars"),
        F.struct("example", F.coalesce(loss, F.lit("")).alias("loss")).alias("part"),
        "formatted",
    )
    by_conv = own.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("part")).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
        F.max_by("formatted", "n_turns").alias("whole"),
    )
    by_conv = by_conv.select(
        "conv_id",
        "formatted_chars",
        read_back(F.col("whole")).alias("turns"),
        F.array_join(F.transform("parts", lambda p: p["loss"]), "").alias("loss"),
    )
    told = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return by_conv.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )

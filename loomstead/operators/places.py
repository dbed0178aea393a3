"""Where patterns stand in texts, as rows, and which of them stand near each other.

One pass gives (document, kind, label, place) by expressions; only texts with a
plain part of a pattern are searched for it. What is near what comes from one sweep
over each document's places from its end: of all anchors that begin no earlier than
a cue's surroundings, the one that ends first tells whether any lies within them. So
cues and anchors meet by sorting, whatever their number, and no text is moved.

Surroundings are text cut out on both sides of a place; an anchor counts if a
search in that cut would find it, so one counts at every place where one begins, also
inside another. Anchors that only the cut makes whole words are found at the
surroundings' two ends.

Rows: null texts have no places; repeated rows give the same rows again; a pattern
must not match the empty text; ids may be null and keep their type.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import BOUND, Lexicons, trie_of
from ..functions.names import fresh, let

#: Numbers of an array that are summed at once, and characters of a text's parts.
RUN, PART = 256, 1024
KEY = ["key1", "key2"]
EVERYWHERE = "(?=("


def sums_before(numbers: Column) -> Column:
    """For each number of an array the sum of those before it; the work is linear but for a small factor."""

    def running(x: Column, start: Column) -> Column:
        begun = F.struct(start.alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, begun, lambda s, v: F.struct((s["sum"] + v).alias("sum"), F.array_append(s["out"], s["sum"]).alias("out")), lambda s: s["out"])

    zero = F.lit(0)

    def apart(x: Column) -> Column:
        runs = F.transform(F.sequence(zero, F.floor((F.size(x) - 1) / RUN).cast("int")), lambda b: F.slice(x, b * RUN + 1, F.lit(RUN)))
        sums = lambda r: running(F.transform(r, lambda y: F.aggregate(y, zero, lambda s, v: s + v)), zero)
        return let(runs, lambda r: F.flatten(F.zip_with(r, sums(r), running)))

    return let(numbers, lambda x: F.when(F.size(x) <= RUN, running(x, zero)).otherwise(apart(x)))


def places(text: Column, pattern: Column) -> Column:
    """Array of (st, en), in characters from 0: all matches of a pattern, one after the other.

    If the pattern is ``everywhere(p)``, those of p at every place where one begins, also where they overlap.
    """
    gaps, own = F.transform(F.split(text, pattern), F.char_length), F.transform(F.regexp_extract_all(text, F.concat(F.lit("("), pattern, F.lit(")")), F.when(F.startswith(pattern, F.lit(EVERYWHERE)), 2).otherwise(1)), F.char_length)
    steps = F.filter(F.zip_with(gaps, own, lambda g, o: F.struct(g.alias("gap"), o.alias("own"))), lambda x: x["own"].isNotNull())
    taken = lambda x: F.when(F.startswith(pattern, F.lit(EVERYWHERE)), 1).otherwise(x["own"])
    put = lambda s: F.zip_with(s, sums_before(F.transform(s, lambda x: x["gap"] + taken(x))), lambda x, at: F.struct((at + x["gap"]).alias("st"), (at + x["gap"] + x["own"]).alias("en")))
    return let(steps, lambda s: F.when(F.size(s) > 0, put(s)))


def everywhere(pattern: str) -> str:
    """A pattern for one character, that looks ahead for another pattern; its first group is what that one matches."""
    return f"{EVERYWHERE}{pattern}))(?s:.)"


#: Letters of no word with which a match may begin, and the plain ones that they stand for.
NO_WORDS = "\u017f\u212a", "sk"


def up_to_words(text: Column, patterns: Sequence[str]) -> Column:
    """A blank and the text, in pieces: each but the first begins where one of some patterns for words does.

    A word that none of them begins with is passed in one step.
    """
    spaced, each = F.concat(F.lit(" "), text), trie_of(patterns)
    words = F.regexp_extract_all(spaced, F.lit(rf"\G\w*+(?:\W++(?!{each})\w++)*+\W*+"), 0)
    letters = F.regexp_extract_all(spaced, F.lit(rf"(?s)\G.(?:(?!{BOUND}{each}).)*+"), 0)
    return F.filter(F.when(F.rlike(text, F.lit(f"[{NO_WORDS[0]}]")), letters).otherwise(words), lambda p: p != "")


def around(parts: Column, start: Column, n: Column, most: int) -> Column:
    """n characters, ``most`` at most, from ``start`` on of a text given in parts; it isn't read from its beginning."""
    first = F.floor(start / PART).cast("int")
    near = F.concat(*[F.coalesce(F.get(parts, first + i), F.lit("")) for i in range(2 + most // PART)])
    return F.substring(near, start - first * PART + 1, n)


def in_parts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), 0)


def _longest(patterns: Sequence[str], width: int) -> int:
    """The most characters that a match has, one more to tell, and no more than the surroundings."""
    return min(max(re._parser.parse(p).getwidth()[1] for p in patterns) + 1, 2 * width)


def _either(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def nearby(docs: DataFrame, doc_id: str, text: str, cues: Mapping[str, Mapping[str, Sequence[str]]], anchors: Mapping[str, Mapping[str, Sequence[str]]], width: int) -> DataFrame:
    """(key1, key2, field, label, st, kinds): every match of a cue, and the kinds of anchors that its surroundings hold.

    ``cues`` has labels with their patterns by field, ``anchors`` kinds of anchors with theirs by field. The two
    keys are hashes of id and text.
    """
    own = Lexicons({field: [(p, label) for label, ps in labels.items() for p in ps] for field, labels in cues.items()})
    found, looked = fresh(docs, "found", "looked")
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(*keys(doc_id, text), t.alias("text"), own.terms_in(t).alias(found)).withColumn(looked, own.entries(F.col(found)))
    kinds = [
        {"field": f, "kind": k, "pattern": f"(?iu){_either(ps)}", "each": [everywhere(f"(?iu){p}") for p in ps], "n": _longest(ps, width)} for f, of in anchors.items() for k, ps in of.items()
    ]
    table = F.from_json(F.lit(json.dumps(kinds)), "array<struct<field:string,kind:string,pattern:string,each:array<string>,n:int>>")
    fields = F.array_distinct(F.transform(looked, lambda r: r["field"]))
    anchored = F.flatten(F.transform(F.filter(table, lambda r: F.array_contains(fields, r["field"])), lambda r: F.transform(r["each"], lambda p: F.struct(r["field"].alias("field"), r["kind"].alias("kind"), F.lit(None).cast("string").alias("label"), p.alias("pattern")))))
    asked = F.concat(F.transform(looked, lambda r: F.struct(r["field"].alias("field"), F.lit(None).cast("string").alias("kind"), r["label"].alias("label"), r["pattern"].alias("pattern"))), anchored)
    each = d.select(*KEY, "text", in_parts(F.col("text")).alias("parts"), asked.alias("asked")).select(*KEY, "text", "parts", F.explode("asked").alias("a")).select(*KEY, "text", "parts", "a.*")

    def put(p: Column) -> Column:
        # a cue is asked for each kind of its field, and whether one stands at an end of its surroundings
        own = F.filter(table, lambda r: r["field"] == F.col("field"))
        cue = F.transform(own, lambda r: F.struct(r["kind"].alias("kind"), _at_the_ends(F.col("parts"), p["st"], F.char_length("text"), r, width).alias("edge")))
        asking = F.when(F.col("label").isNotNull(), cue).otherwise(F.array(F.struct(F.col("kind").alias("kind"), F.lit(False).alias("edge"))))
        return F.transform(asking, lambda k: F.struct(p["st"].alias("st"), p["en"].alias("en"), k["kind"].alias("kind"), k["edge"].alias("edge")))

    rows = F.flatten(F.transform(places(F.col("text"), F.col("pattern")), put))
    return meet(each.select(*KEY, "field", "label", F.explode(rows).alias("p")).select(*KEY, "field", "label", "p.*"), width)


def _at_the_ends(parts: Column, st: Column, size: Column, kind: Column, width: int) -> Column:
    """Whether an anchor begins where the surroundings of a place begin, or ends where they end."""
    begin, end = F.greatest(F.lit(0), st - width), F.least(size, st + width)
    last = F.greatest(begin, end - kind["n"])
    head, tail = around(parts, begin, F.least(kind["n"], end - begin), 2 * width), around(parts, last, end - last, 2 * width)
    return F.rlike(head, F.concat(F.lit("^(?:"), kind["pattern"], F.lit(")"))) | F.rlike(tail, F.concat(F.lit("(?:"), kind["pattern"], F.lit(")\\z")))


def keys(doc_id: str, text: str) -> list[Column]:
    """Two hashes that tell a row's id and text."""
    own = [F.col(doc_id).cast("string"), F.col(text)]
    return [F.xxhash64(*own).alias("key1"), F.xxhash64(*reversed(own), F.lit(1)).alias("key2")]


def meet(each: DataFrame, width: int) -> DataFrame:
    """Cues (with a label) and anchors (without) of documents, as (field, kind, label, st, en, edge): the kinds near each cue."""
    cue = F.col("label").isNotNull()
    at = each.withColumn("at", F.when(cue, F.col("st") - width).otherwise(F.col("st")))
    sweep = Window.partitionBy(*KEY, "field", "kind").orderBy(F.desc("at"), cue).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = at.withColumn("ends", F.min(F.when(~cue, F.col("en"))).over(sweep)).where(cue)
    near = F.col("edge") | F.coalesce(F.col("ends") <= F.col("st") + width, F.lit(False))
    return ends.groupBy(*KEY, "field", "label", "st").agg(F.collect_set(F.when(near, F.col("kind"))).alias("kinds"))

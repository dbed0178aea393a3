"""Texts against a lexicon table of any size.

Every pattern needs some plain parts (``literals``). While those of the whole table
fit into one expression, each text is read once for all of them, and a pattern
looks at the text itself where all that it needs is there; nothing is moved.

Beyond that size every part brings its three-character grams, of which the rarest
in the texts goes into an index table. Texts meet patterns by an equi join on such
grams, and then a pattern looks at the texts that hold its gram. Patterns without a
part of three characters, which no index can find, are held against all texts in
blocks. Both ways give the same rows.

Rows: a null text or pattern meets nothing; repeated rows of either side meet
each; an empty table gives none; other columns stay, those of the lexicon win no
name from the texts' (a name that both have is refused).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import fold, found_terms, required, required_each
from ..functions.names import fresh, let

GRAM = 3
#: Patterns that go into one expression, and those that each row goes through one by one.
AT_ONCE, IN_A_ROW = 10_000, 1000
#: Characters of a further part that are worth looking for.
TELLING = 5


def parts_of(patterns: DataFrame) -> DataFrame:
    """(pattern, part): the plain parts of which a match holds one; a null part where none is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p in batch.column(0).to_pylist():
                try:
                    parts = required(p)
                except (re.error, OverflowError):  # not an expression for Python: the index can't tell
                    parts = frozenset()
                rows += [(p, part) for part in sorted(parts)] if parts and min(map(len, parts)) >= GRAM else [(p, None)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["pattern", "part"])

    return patterns.where("pattern is not null").select("pattern").distinct().mapInArrow(run, "pattern string, part string")


def grams(text: Column) -> Column:
    """All different grams of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(fold(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), 1))


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]


def index(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """(gram, pattern): for each part the gram that the fewest texts hold; a part of which a gram is nowhere is left out.

    ``texts`` is (h1, h2, gram).
    """
    each = parts.where("part is not null").select("pattern", "part", F.explode(grams(F.col("part"))).alias("gram"))
    often = texts.join(each.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(often, "gram", "left").groupBy("pattern", "part").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("there"))
    return rarest.where("there").select("gram", "pattern").distinct()


def join_lexicon(docs: DataFrame, lexicon: DataFrame, text: str, block: int = 500, at_once: int = AT_ONCE) -> DataFrame:
    """Each document with each row of the lexicon (``pattern`` and other columns) whose pattern occurs in its text.

    ``at_once`` patterns at most go into one expression.
    """
    if clash := {c.lower() for c in docs.columns} & {c.lower() for c in lexicon.columns}:
        raise ValueError(f"both tables have {sorted(clash)}")
    patterns = lexicon.where("pattern is not null").select("pattern").distinct()
    some = [r["pattern"] for r in patterns.limit(at_once + 1).collect()]
    if len(some) <= at_once:
        return _in_one_pass(docs, lexicon, text, sorted(some))
    h1, h2 = fresh(docs.join(lexicon.limit(0), F.lit(True)), "h1", "h2")
    own = docs.where(F.col(text).isNotNull()).withColumns(dict(zip((h1, h2), _hashes(F.col(text)), strict=True)))
    parts = parts_of(lexicon)
    held = own.select(F.col(h1).alias("h1"), F.col(h2).alias("h2"), F.explode(grams(F.col(text))).alias("gram"))
    met = held.join(index(parts, held), "gram").select("h1", "h2", "pattern").distinct()
    found = own.join(met.select(F.col("h1").alias(h1), F.col("h2").alias(h2), "pattern"), [h1, h2]).where(F.rlike(F.col(text), F.col("pattern")))
    found = found.join(lexicon, "pattern").select(*docs.columns, *lexicon.columns)
    return found.unionByName(_in_blocks(docs, lexicon, parts.where("part is null").select("pattern"), text, block))


def _sets(pattern: str) -> list[list[str]]:
    """The sets of plain parts that a pattern needs, those that tell most first."""
    try:
        return sorted((sorted(s) for s in required_each(pattern)), key=lambda s: -min(map(len, s)))
    except (re.error, OverflowError):
        return []


def _in_rows(docs: DataFrame, lexicon: DataFrame, text: str, patterns: list[str]) -> DataFrame:
    """A few patterns: each row goes through those whose parts it has."""
    needs = [{"pattern": p, "needs": [s for i, s in enumerate(_sets(p)[:3]) if i == 0 or min(map(len, s)) >= TELLING]} for p in patterns]
    rows = F.from_json(F.lit(json.dumps(needs)), "array<struct<pattern:string,needs:array<array<string>>>>")
    found = found_terms(F.col(text), sorted({t for r in needs for s in r["needs"] for t in s}))
    ready = let(found, lambda own: F.filter(rows, lambda r: F.forall(r["needs"], lambda s: F.arrays_overlap(s, own)) & F.rlike(F.col(text), r["pattern"])))
    own = docs.where(F.col(text).isNotNull()).select(*docs.columns, F.explode(F.transform(ready, lambda r: r["pattern"])).alias("pattern"))
    return own.join(lexicon, "pattern").select(*docs.columns, *lexicon.columns)


def _in_one_pass(docs: DataFrame, lexicon: DataFrame, text: str, patterns: list[str]) -> DataFrame:
    """A lexicon of bounded size: the texts' plain parts by one expression, then the patterns that have all they need.

    A pattern waits at its rarest-looking part, the longest; only texts with that part ask for its others.
    """
    if len(patterns) <= IN_A_ROW:
        return _in_rows(docs, lexicon, text, patterns)
    waiting: dict[str, list] = {}
    for p in patterns:
        sets = _sets(p)
        either = sets[0] if sets else [""]
        for part in either:
            waiting.setdefault(part, []).append({"pattern": p, "either": either, "needs": [s for s in sets[1:3] if min(map(len, s)) >= TELLING]})
    terms = {t for rows in waiting.values() for r in rows for s in r["needs"] for t in s} | waiting.keys() - {""}
    rows = [(part, json.dumps(some)) for part, some in waiting.items()]
    table = docs.sparkSession.createDataFrame(rows, "part string, some string")
    table = F.broadcast(table.select("part", F.from_json("some", "array<struct<pattern:string,either:array<string>,needs:array<array<string>>>>").alias("some")))  # of checked size
    found, part, ask = fresh(docs.join(lexicon.limit(0), F.lit(True)), "found", "part", "ask")
    own = docs.where(F.col(text).isNotNull()).withColumn(found, found_terms(F.col(text), sorted(terms)))
    each = own.withColumn(part, F.explode(F.concat(F.array(F.lit("")), F.col(found)))).join(table.withColumnRenamed("part", part), part)
    # where several parts would do, the first that is there asks
    first = lambda r: (F.size(r["either"]) == 1) | (F.get(F.filter(r["either"], lambda x: F.array_contains(F.col(found), x)), F.lit(0)) == F.col(part))
    ready = F.filter("some", lambda r: F.forall(r["needs"], lambda s: F.arrays_overlap(s, F.col(found))) & first(r) & F.rlike(F.col(text), r["pattern"]))
    asked = each.select(*docs.columns, F.explode(F.transform(ready, lambda r: r["pattern"])).alias(ask))
    return asked.withColumnRenamed(ask, "pattern").join(lexicon, "pattern").select(*docs.columns, *lexicon.columns)


def _in_blocks(docs: DataFrame, lexicon: DataFrame, loose: DataFrame, text: str, block: int) -> DataFrame:
    """Patterns that no index finds: each text against a block of them at a time."""
    out = docs.limit(0).join(lexicon.limit(0), F.lit(True)).select(*docs.columns, *lexicon.columns)
    rows, more = loose.distinct().sort("pattern").toLocalIterator(), True
    while more:
        some = [r["pattern"] for _, r in zip(range(block), rows, strict=False)]
        more = len(some) == block
        if some:
            patterns = F.array(*[F.lit(p) for p in some])
            met = docs.select(*docs.columns, F.explode(F.filter(patterns, lambda p: F.rlike(F.col(text), p))).alias("pattern"))
            out = out.unionByName(met.join(lexicon, "pattern").select(*docs.columns, *lexicon.columns))
    return out

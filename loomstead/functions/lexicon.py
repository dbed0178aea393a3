"""Matching texts against ordered lists of (pattern, label).

Patterns are literals in the plan, so each is compiled once. Many of them at once
are ``functions.literals``, lexicons in tables ``operators.lexicons``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Lexicon = Sequence[tuple[str, str]]


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?iu){pattern}"), F.lit(False))


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    """Whether one pattern occurs."""
    out = F.lit(False)
    for p in patterns:
        out = out | matches(text, p)
    return out


def all_labels(text: Column, lexicon: Lexicon) -> Column:
    """The labels of all patterns that occur, in the lexicon's order."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(matches(text, p), F.lit(label)) for p, label in lexicon])))


def first_label(text: Column, lexicon: Lexicon, default: str | None = None) -> Column:
    """The label of the first pattern that occurs."""
    return F.coalesce(*[F.when(matches(text, p), F.lit(label)) for p, label in lexicon], F.lit(default))


def terms_by_position(text: Column, terms: Sequence[str]) -> Column:
    """The plain terms that occur, by the place of their first occurrence."""
    low = F.lower(text)
    found = F.array(*[F.struct(F.instr(low, t.lower()).alias("at"), F.lit(t).alias("term")) for t in terms])
    return F.transform(F.array_sort(F.filter(found, lambda x: x["at"] > 0)), lambda x: x["term"])


def find_all(text: Column, pattern: str, names: Mapping[str, str] | None = None) -> Column:
    """All distinct matches, lower-cased and sorted; with ``names`` by the label of their spelling."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.lower)
    if names:
        labels = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        found = F.transform(found, lambda x: F.coalesce(F.try_element_at(labels, x), x))
    return F.array_sort(F.array_distinct(found))


def in_context(answer: Column, context: Column) -> Column:
    """Whether an answer occurs in its context, as written or with hyphens and spaces folded."""
    fold = lambda c: F.regexp_replace(F.lower(c), r"[\s_-]+", "")
    return F.coalesce((F.length(answer) > 0) & ((F.instr(F.lower(context), F.lower(answer)) > 0) | (F.instr(fold(context), fold(answer)) > 0)), F.lit(False))


def gate(cell: Column, context: Column, separator: str = ",") -> Column:
    """The tokens of a cell for which the context has evidence."""
    tokens = F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), separator), lambda t: F.trim(t)), lambda t: t != "")
    return F.filter(tokens, lambda t: in_context(t, context))


def whole_items(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text", item_text: str = "text", max_chars: int = 50_000_000) -> DataFrame:
    """(doc_id, item_id): the documents that hold the whole text of an item, whatever its case.

    The items, whose total length is checked, go to every worker as one automaton; each text is read
    once, however many items there are, and nothing is shuffled. Items without text occur nowhere.
    """
    import pyarrow as pa

    own = items.select(F.col(item_id).alias("item_id"), F.lower(F.trim(item_text)).alias("item")).where("item <> '' and item_id is not null")
    chars = own.agg(F.sum(F.char_length("item"))).first()[0] or 0
    if chars > max_chars:
        raise ValueError(f"the items have more than {max_chars} characters")
    of: dict[str, list] = {}
    for r in own.collect():
        of.setdefault(r["item"], []).append(r["item_id"])
    low = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    kinds = [low.schema["doc_id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()]

    def run(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for item, ids in of.items():
            machine.add_word(item, ids)
        if of:
            machine.make_automaton()
        for batch in batches:
            found = [sorted({i for _, ids in machine.iter(t.as_py()) for i in ids}) if of else [] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item_type))], ["doc_id", "items"])

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(items.schema[item_id].dataType)
    hits = low.mapInArrow(run, f"doc_id {kinds[0]}, items array<{kinds[1]}>")
    return hits.select("doc_id", F.explode("items").alias("item_id"))

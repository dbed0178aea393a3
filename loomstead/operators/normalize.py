"""One spelling for each kind of cell, as expressions; ``clean`` runs the whole chain over a record.

Lexicons are parameters, with the fixed values of ``functions.vocabulary`` as
defaults. Null cells count as blank.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.lexicon import Lexicon, any_match, first_label
from ..functions.missing import NOT_REPORTED, collapse, is_missing, norm, strip, tri_state
from ..functions.tokens import canonical, split_multi
from . import derive
from .derive import rag_cell as rag_cell


def text(c: Column) -> Column:
    """Trimmed; null becomes empty."""
    return strip(F.coalesce(c, F.lit("")))


def respaced(c: Column) -> Column:
    """White space collapsed, one space after commas and around plus signs."""
    out = F.regexp_replace(collapse(c), r"\s*,\s*", ", ")
    return strip(F.regexp_replace(out, r"\s*\+\s*", " + "))


def vlm_cell(c: Column) -> Column:
    """As it is with an explanation in brackets, else yes or no; other texts stay."""
    low = norm(c)
    return F.when(F.contains(low, F.lit("vlm")) & F.contains(low, F.lit("(")), respaced(c)).otherwise(tri_state(c, keep_unknown=True))


def model_cell(c: Column, lexicon: Lexicon = v.CLEAN_MODELS) -> Column:
    return canonical(c, lexicon)


def vision_cell(c: Column, lexicon: Lexicon = v.CLEAN_VISION) -> Column:
    return canonical(c, lexicon)


def language_cell(c: Column, lexicon: Lexicon = v.CLEAN_LANGUAGE) -> Column:
    return canonical(c, lexicon)


def objectives_cell(c: Column, lexicon: Lexicon = v.CLEAN_OBJECTIVES) -> Column:
    return canonical(c, lexicon)


def fusion_cell(c: Column, lexicon: Lexicon = v.CLEAN_FUSION) -> Column:
    """As the others, without the mere modifier "conditioned"."""
    return canonical(c, lexicon, drop=("not reported", "conditioned"))


def family_cell(c: Column, lexicon: Lexicon = v.CLEAN_FAMILIES, coarse: bool = False) -> Column:
    """Named families, or with ``coarse`` "Transformer" for any."""
    out = canonical(c, lexicon)
    return F.when(out != "", "Transformer").otherwise(out) if coarse else out


def metrics_cell(c: Column) -> Column:
    """Distinct tokens in order, respaced."""
    return F.array_join(F.array_distinct(F.transform(split_multi(c), respaced)), ", ")


#: The usual columns of a record and what makes their cells alike.
FIELDS = {
    "modality": text, "train": text, "eval_": text, "paired": lambda c: tri_state(c, keep_unknown=True), "vlm": vlm_cell, "model": model_cell, "klass": text, "task": text,
    "vision": vision_cell, "language": language_cell, "fusion": fusion_cell, "objectives": objectives_cell, "family": family_cell, "metrics": metrics_cell,
}


def normalize_fields(df: DataFrame, fields: Mapping = FIELDS) -> DataFrame:
    """All columns of ``fields`` that the table has."""
    return df.withColumns({c: f(F.col(c)) for c, f in fields.items() if c in df.columns})


def clean(df: DataFrame, key: str, families: Lexicon = v.CLEAN_FAMILIES, vlm_families: Sequence[str] = v.VLM_FAMILY_KEYS, coarse: bool = False, primary_only: bool = False) -> DataFrame:
    """The whole chain: every cell alike, the derivations in their order, and every text cell respaced."""
    d = derive.clean_record(normalize_fields(df), families, vlm_families, primary_only=primary_only)
    if coarse:  # a record that looks like a VLM has a family of one kind
        d = d.withColumn("family", F.when((F.col("klass") == "VLM") | ~derive.blank(F.col("family")), "Transformer").otherwise(F.col("family")))
    return d.select(*[respaced(F.col(c)).alias(c) if t == "string" and c != key else F.col(c) for c, t in d.dtypes])


def family_from_columns(family: Column, others: Sequence[Column], families: Lexicon = v.CLEAN_FAMILIES) -> Column:
    """The family, or the first one that the other columns name."""
    return F.when(derive.blank(family), first_label(F.concat_ws(" | ", *others), families, "")).otherwise(family)


def single_token(c: Column, most: int = 6) -> Column:
    """What stands before the first comma, semicolon or "and"; a sentence counts as not reported."""
    head = strip(F.element_at(F.split(F.coalesce(c, F.lit("")), r"(?i),|;|\band\b", 2), 1))
    return F.when(F.size(F.filter(F.split(head, r"\s+"), lambda w: w != "")) > most, NOT_REPORTED).otherwise(head)


def _first_part(low: Column, parts: Sequence[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(label)) for k, label in parts], F.lit(NOT_REPORTED))


def single_value(c: Column, field: str, context: Column | None = None) -> Column:
    """One canonical value for a field: vision, language, fusion, model, modality, dataset, or any other as it is."""
    token = single_token(c)
    low = F.lower(token)
    if field in ("vision", "language", "fusion"):
        out = _first_part(low, {"vision": v.SINGLE_VISION, "language": v.SINGLE_LANGUAGE, "fusion": v.SINGLE_FUSION}[field])
    elif field == "model":
        out = _first_part(F.replace(low, F.lit("-"), F.lit("")), [(m.lower().replace("-", ""), m) for m in v.SINGLE_MODELS])
    elif field == "modality":
        out = F.coalesce(first_label(token, v.SINGLE_MODALITY), token)
    elif field == "dataset":
        known = F.lower(token).rlike("mimic|iu|open-?i|chexpert|padchest|vindr|nih")
        there = F.lit(False) if context is None else F.contains(F.lower(context), low)
        out = F.when(known | there, token).otherwise(NOT_REPORTED)
    else:
        out = token
    return F.when(c == NOT_REPORTED, c).otherwise(out)


def by_name(c: Column, names: Mapping[str, str]) -> Column:
    """The label of an exact spelling, whatever its case, or the trimmed cell."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, norm(c)), text(c))


def list_by_name(cells: Column, names: Mapping[str, str]) -> Column:
    """Each element of a list by its exact spelling, distinct in order; nothing left is not reported."""
    out = F.array_distinct(F.transform(F.filter(cells, lambda x: text(x) != ""), lambda x: by_name(x, names)))
    return F.when(F.coalesce(F.size(out), F.lit(0)) > 0, out).otherwise(F.array(F.lit(NOT_REPORTED)))


def said(c: Column, allowed: Mapping[str, str]) -> Column:
    """One of the allowed answers, else not reported."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in allowed.items() for x in pair]), norm(c)), F.lit(NOT_REPORTED))


def normalize_lists(df: DataFrame) -> DataFrame:
    """A record with list cells: yes or no, data sets and metrics by name, models by name (columns that the table has)."""
    yes_no = {"yes": "Yes", "no": "No"}
    how = {
        "vlm": lambda c: said(c, yes_no), "paired": lambda c: said(c, yes_no | {"not reported": NOT_REPORTED}), "train": lambda c: list_by_name(c, v.DATASET_NAMES), "eval_": lambda c: list_by_name(c, v.DATASET_NAMES),
        "metrics": lambda c: list_by_name(c, v.METRIC_NAMES), **{x: lambda c: by_name(c, v.MODEL_NAMES) for x in ("model", "vision", "language", "family")},
    }
    return df.withColumns({c: f(F.col(c)) for c, f in how.items() if c in df.columns})


def modality(c: Column, names: Mapping[str, str] = v.MODALITY_NAMES) -> Column:
    """A modality by its exact spelling, with hyphens or without."""
    table, low = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), norm(c)
    return F.coalesce(F.try_element_at(table, low), F.try_element_at(table, F.replace(low, F.lit("-"), F.lit(" "))), F.lit(NOT_REPORTED))


def named(c: Column, tokens: Sequence[str]) -> Column:
    """The first of the tokens that stands in the cell as a word; the longer ones go first, so the order is fixed."""
    ordered = sorted(tokens, key=lambda t: (-len(t), t))
    return F.when(text(c) == "", NOT_REPORTED).otherwise(F.coalesce(first_label(c, [(rf"\b\Q{t}\E\b", t) for t in ordered]), text(c)))


def model_in(c: Column, context: Column, lexicon: Lexicon = v.CLEAN_MODELS) -> Column:
    """The first model whose pattern occurs in the cell or its context, or the cell; a blank cell is not reported."""
    both = F.coalesce(*[F.when(F.coalesce(c.rlike(f"(?iu){p}"), F.lit(False)) | F.coalesce(context.rlike(f"(?iu){p}"), F.lit(False)), F.lit(m)) for p, m in lexicon])
    return F.when(text(c) == "", NOT_REPORTED).otherwise(F.coalesce(both, text(c)))


#: Where an answer's first phrase ends, and the labels that may stand before it.
CUTS = ("\n", "#", "```", "---", "Answer:", "Output:")
LABELS = r"(?i)^(title|authors|modality|datasets|model name|vision encoder|language decoder|fusion strategy)\s*:\s*"


def first_phrase(c: Column, bad: Sequence[str] = (), most: int = 80, plain: bool = False) -> Column:
    """The first phrase of an answer: cut at line ends, fences and sentence ends, without labels and quotes; ``plain`` keeps simple characters only."""
    out = text(c)
    for cut in CUTS:
        out = strip(F.element_at(F.split(out, F.lit("\\Q" + cut + "\\E"), 2), 1))
    out = strip(F.regexp_replace(out, r"(?s)^([^.!?]+)[.!?].*$", "$1"))
    out = F.regexp_replace(F.regexp_replace(out, r"\s+", " "), LABELS, "")
    marked = F.lit(False)
    for b in bad:
        marked = marked | F.contains(F.lower(out), F.lit(b.lower()))
    out = F.when(marked, NOT_REPORTED).otherwise(strip(F.left(F.regexp_replace(out, r"^[ `*_'\"]+|[ `*_'\"]+$", ""), F.lit(most))))
    nothing = (out == "") | (F.lower(out) == "answer") | F.startswith(F.lower(out), F.lit("from the context"))
    if plain:
        out = strip(F.regexp_replace(out, r"[^A-Za-z0-9+/\-&,; ]", ""))
    return F.when(nothing | (out == ""), NOT_REPORTED).otherwise(out)


PLACEHOLDER = r"(?i)^(string|list)(\s+or.*)?$"


def drop_placeholder(c: Column) -> Column:
    """A cell that repeats the schema's type, or says not applicable, is not reported."""
    return F.when(strip(c).rlike(PLACEHOLDER) | F.contains(c, F.lit("Not applicable")), NOT_REPORTED).otherwise(strip(c))


def drop_placeholders(cells: Column) -> Column:
    """A list without such elements."""
    out = F.filter(cells, lambda x: ~strip(x).rlike(PLACEHOLDER))
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit(NOT_REPORTED)))

"""Row-wise derivations of a metadata record: cross-column rules in a fixed order.

Each step reads what the steps before it wrote, so each is its own projection.
Column names are parameters with the usual names as defaults.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.lexicon import Lexicon, any_match, first_label
from ..functions.literals import trie
from ..functions.missing import is_missing, norm
from ..functions.names import fresh
from ..functions.tokens import split_multi

NOT_APPLICABLE = "Not applicable"
PRIMARY, OBJECTIVES = v.PRIMARY_FAMILIES, v.FAMILY_OBJECTIVES
#: Tokens as they may stand in a list of models.
GENERIC = (*v.GENERIC_MODELS, "Transformer")


def blank(c: Column) -> Column:
    """Null or nothing but white space: what the derivations test for."""
    return F.coalesce(F.trim(c) == "", F.lit(True))


def looks_like_vlm(flag: Column, vision: Column, language: Column, model: Column, family: Column, keys: Sequence[str] = v.VLM_FAMILY_KEYS) -> Column:
    """The flag says so, or both encoders are given, or the model or family has a VLM's name in it."""
    named = F.lower(F.concat_ws(" ", F.coalesce(model, F.lit("")), F.coalesce(family, F.lit("")))).rlike(trie(keys))
    return F.coalesce(F.lower(flag).isin("yes", "true", "1", "y"), F.lit(False)) | (~blank(vision) & ~blank(language)) | named


def derive_class(vlm: Column, vision: Column, language: Column) -> Column:
    """VLM, Vision-only, Text-only or nothing."""
    return F.when(vlm, "VLM").when(~blank(vision) & blank(language), "Vision-only").when(blank(vision) & ~blank(language), "Text-only").otherwise(F.lit(""))


def model_if_empty(model: Column, family: Column, language: Column, vision: Column) -> Column:
    """The model, else the family, else the encoders."""
    both = F.array_join(F.array_distinct(F.filter(F.array(F.trim(language), F.trim(vision)), lambda x: x != "")), ", ")
    return F.when(~blank(model), model).when(~blank(family), F.trim(family)).otherwise(both)


def mirror(a: Column, b: Column) -> tuple[Column, Column]:
    """Each of two cells, or the other where it's blank."""
    return F.when(blank(a), b).otherwise(a), F.when(blank(b), a).otherwise(b)


def refine_model(model: Column, family: Column, vision: Column, families: Lexicon, primary_only: bool = False) -> Column:
    """A named family in front of a model without one: of the model's own tokens, the family and CLIP as encoder, by ``PRIMARY`` or the first.

    With ``primary_only`` that family alone, or else the model's first token.
    """
    named = lambda t: F.coalesce(first_label(t, families), t)
    own = F.array_distinct(split_multi(model))
    from_model = F.filter(F.transform(own, named), lambda t: ~t.isin(*GENERIC))
    from_family = F.filter(F.transform(split_multi(family), named), lambda t: ~t.isin("Transformer") & (F.lower(t) != "not reported"))
    clip = F.filter(F.array_distinct(F.transform(split_multi(vision), lambda t: first_label(t, v.CLEAN_VISION, ""))), lambda t: t == "CLIP")
    candidates = F.array_distinct(F.concat(from_model, from_family, clip))
    first = F.coalesce(*[F.when(F.array_contains(candidates, f), f) for f in PRIMARY], F.get(candidates, F.lit(0)))
    if primary_only:
        return F.coalesce(first, F.get(own, F.lit(0)), F.lit(""))
    out = F.when((F.size(candidates) == 0) | F.arrays_overlap(own, candidates), own).otherwise(F.concat(F.array(first), own))
    return F.array_join(F.array_distinct(out), ", ")


def objectives_of(model: Column, family: Column) -> Column:
    """The objectives of the first family in ``OBJECTIVES`` that the model or family names, or null."""
    blob = F.replace(F.lower(F.concat_ws(" ", model, family)), F.lit(" "), F.lit(""))
    return F.coalesce(*[F.when(F.contains(blob, F.lit(k)), v) for k, v in OBJECTIVES])


def rag_from_row(cell: Column, others: Sequence[Column], vetoing: Sequence[Column], positive: Sequence[str] = (*v.CLEAN_RAG, *v.RAG_STRONG_CUES), negative: Sequence[str] = v.RAG_NEG_CUES) -> Column:
    """Yes or nothing: what the cell says (``rag_cell``), or else a cue in the others, unless a vetoing cell denies it."""
    blob, veto = F.concat_ws(" | ", *[F.nullif(c, F.lit("")) for c in others]), F.concat_ws(" | ", *vetoing)
    return F.when(rag_cell(cell) == "Yes", "Yes").when(any_match(veto, negative), "").when(any_match(blob, positive), "Yes").otherwise(F.lit(""))


def rag_cell(c: Column, patterns: Sequence[str] = v.CLEAN_RAG) -> Column:
    """Yes or nothing: a plain yes or a cue of retrieval, but not a denial of it."""
    low = norm(c)
    denied = low.rlike(r"\bno\b") & low.rlike("rag|retriev")
    return F.when(is_missing(c, "eval"), "").when(low.isin("yes", "y", "true", "1", "present", "rag"), "Yes").when(denied, "").when(any_match(c, patterns), "Yes").otherwise("")


def clean_record(
    df: DataFrame,
    families: Lexicon,
    vlm_families: Sequence[str] = v.VLM_FAMILY_KEYS,
    default_objectives: str = "contrastive, ITM",
    default_fusion: str = "cross-attention",
    primary_only: bool = False,
) -> DataFrame:
    """The chain over model, family, klass, vision, language, fusion, objectives, vlm, rag, train, eval_.

    Order: retrieval, model, its named family in front, family, class, objectives
    and fusion, data sets, what doesn't apply. Denials of retrieval count in all
    columns, cues of it in the ``RAG_TELLING`` columns that ``df`` has.
    Cells are not normalised or tidied here: ``functions.tokens`` does that.
    """
    c = F.col
    d = df.withColumn("rag", rag_from_row(c("rag"), [c(f"`{x}`") for x in df.columns if x.lower() in v.RAG_TELLING], [c(f"`{x}`").cast("string") for x in df.columns]))
    d = d.withColumn("model", model_if_empty(c("model"), c("family"), c("language"), c("vision")))
    d = d.withColumn("model", refine_model(c("model"), c("family"), c("vision"), families, primary_only))
    d = d.withColumn("family", F.when(blank(c("family")), first_label(c("model"), families, "")).otherwise(c("family")))
    (vlm,) = fresh(df, "is_vlm")
    d = d.withColumn(vlm, looks_like_vlm(c("vlm"), c("vision"), c("language"), c("model"), c("family"), vlm_families))
    d = d.withColumn("klass", derive_class(c(vlm), c("vision"), c("language")))
    d = d.withColumn("objectives", F.when(is_missing(c("objectives")), F.coalesce(objectives_of(c("model"), c("family")), c("objectives"))).otherwise(c("objectives")))
    d = d.withColumns({x: F.when(c(vlm) & is_missing(c(x)), v).otherwise(c(x)) for x, v in (("objectives", default_objectives), ("fusion", default_fusion))})
    train, eval_ = mirror(c("train"), c("eval_"))
    d = d.withColumns({"train": train, "eval_": eval_})
    plain = ~c(vlm) & blank(c("vision"))
    d = d.withColumns({x: F.when(plain & is_missing(c(x)), NOT_APPLICABLE).otherwise(c(x)) for x in ("objectives", "fusion")})
    return d.drop(vlm)

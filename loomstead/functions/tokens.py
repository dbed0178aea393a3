"""Multi-valued cells as token arrays: splitting, sets, canonical labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import strip
from .vocabulary import TASK_TERMS


def _tokens(c: Column, separators: str) -> Column:
    parts = F.split(F.coalesce(c, F.lit("")), separators)
    return F.filter(F.transform(parts, strip), lambda t: t != "")


def split_multi(c: Column) -> Column:
    """Tokens in order, repeats included; separators are , ; | / + & (full-width too) and the word "and"."""
    return _tokens(c, r"(?iu)[,，;；|/+&]|\s+and\s+")


def token_set(c: Column) -> Column:
    """The lower-cased distinct tokens in order of the alphabet."""
    return F.array_sort(F.array_distinct(F.transform(split_multi(c), F.lower)))


def label_set(c: Column) -> Column:
    """As ``token_set``, but split at ; | / , only and empty for a missing label."""
    out = F.array_sort(F.array_distinct(F.transform(_tokens(c, r"[;|/,]"), F.lower)))
    return F.filter(out, lambda t: t != "not reported")


def vote_tokens(c: Column) -> Column:
    """Distinct tokens with their case, split at ; and , only."""
    return F.array_sort(F.array_distinct(_tokens(c, r"[;,]")))


def distinct_ci(tokens: Column) -> Column:
    """Distinct without regard to case; the first spelling stays, in order."""
    lowered = F.transform(tokens, F.lower)
    return F.filter(tokens, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1)


def same_set(a: Column, b: Column) -> Column:
    """Whether two cells hold the same token set."""
    return token_set(a) == token_set(b)


def alias(token: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The label of the first rule (pattern, label) found in the token, or the token itself."""
    out = token
    for pattern, label in reversed(rules):
        out = F.when(token.rlike(f"(?iu){pattern}"), F.lit(label)).otherwise(out)
    return out


def canonical(c: Column, rules: Sequence[tuple[str, str]], drop: Sequence[str] = ("not reported",), joiner: str = ", ") -> Column:
    """Split, alias, drop, keep distinct labels in order, and join."""
    kept = F.filter(F.transform(split_multi(c), lambda t: alias(t, rules)), lambda t: ~F.lower(t).isin(*drop))
    return F.array_join(F.array_distinct(kept), joiner)


def move_tokens(source: Column, target: Column, pattern: str = "|".join(TASK_TERMS)) -> tuple[Column, Column]:
    """Tokens of one cell that look like the other's go there; both come back as sorted sets."""
    s, t = token_set(source), token_set(target)
    moved = F.filter(s, lambda x: x.rlike(f"(?i){pattern}"))
    return F.array_except(s, moved), F.array_sort(F.array_union(t, moved))

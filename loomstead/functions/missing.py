"""Missing values, keys and truth values under named policies.

There is no single null in such tables: each consumer has its own spellings of
"missing", its own way of writing a key and of saying yes. All are parameters
here, never globals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as missing once trimmed and lower-cased, by policy.
POLICIES: dict[str, tuple[str, ...]] = {
    "eval": ("", "n/a", "na", "none", "null", "unk", "unknown", "not available", "not applicable", "not reported", "nr", "n/r"),
    "compare": ("", "not reported", "nan", "none", "null", "na", "n/a", "-"),
    "dashes": ("", "not reported", "n/a", "na", "none", "null", "-"),
    "long_dashes": ("", "not reported", "n/a", "na", "none", "null", "-", "—", "–"),
    "mask": ("", "not reported", "n/a", "na", "none", "null", "not applicable", "—", "-"),
    "gold": ("", "not reported"),
    "backfill": ("", "not reported"),
    "fuse": ("", "n/a", "na", "none"),
}
#: Policies that look at values as they are written, without trimming or case.
EXACT: dict[str, tuple[str, ...]] = {"coverage": ("", "Not reported")}
NOT_REPORTED = "Not reported"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm(c: Column) -> Column:
    """Trimmed and in lower case; null becomes empty."""
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def is_missing(c: Column, policy: str = "eval", extra: tuple[str, ...] = ()) -> Column:
    """True where a value is missing; null always is. ``extra`` adds spellings (lower case)."""
    if policy in EXACT:
        return F.coalesce(c.isin(*EXACT[policy], *extra), F.lit(True))
    value = F.lower(collapse(c)) if policy == "eval" else norm(c)
    return value.isin(*POLICIES[policy], *extra)


def is_filled(c: Column, policy: str = "eval", extra: tuple[str, ...] = ()) -> Column:
    return ~is_missing(c, policy, extra)


def norm_key(c: Column, variant: str = "lower") -> Column:
    """A key in one spelling: raw, one_txt, lower, cased or any_txt."""
    if variant == "raw":
        return c
    if variant == "one_txt":
        return F.regexp_replace(c, r"\.txt$", "")
    if variant == "any_txt":
        return F.replace(c, F.lit(".txt"), F.lit(""))
    out = collapse(F.regexp_replace(strip(c), r"(?i)\.(txt|pdf|md)$", ""))
    return F.lower(out) if variant == "lower" else out


def truthy(c: Column, variant: str = "words") -> Column:
    """Yes in one of four ways: words, listed, positive or one. Null is no."""
    if variant == "words":
        out = norm(c).isin("1", "true", "yes", "y", "t")
    elif variant == "listed":
        out = c.isin("1", "1.0", "true", "True", "yes", "Yes", "Y", "y")
    elif variant == "positive":
        out = c.try_cast("double") > 0
    else:
        out = c.try_cast("double").cast("int") == 1
    return F.coalesce(out, F.lit(False))


def tri_state(c: Column, keep_unknown: bool = False) -> Column:
    """Yes, No, or what an unknown text becomes: itself or "Not reported"."""
    n = norm(c)
    other = strip(c) if keep_unknown else F.lit(NOT_REPORTED)
    return (
        F.when(n.isin("yes", "y", "true", "1", "t"), "Yes")
        .when(n.isin("no", "n", "false", "0", "f"), "No")
        .when(is_missing(c, "eval"), NOT_REPORTED)
        .otherwise(other)
    )

"""Names for helper columns, and for parts of expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put in front until the table has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """An expression that reads another more than once, or from within a loop, and makes it once.

    A column of an earlier projection doesn't do: the optimizer may put its expression into the loop.
    """
    return F.element_at(F.transform(F.array(x), f), 1)

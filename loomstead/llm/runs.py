"""Periodic runs of words: stretches that repeat one phrase over and over.

A run is a stretch of words with smallest period q (words q apart are the same)
that is long enough and that no neighbouring word extends with the same period.
Each text's suffix automaton is built over its word numbers; every state's end
positions are an ordered set, and a state's set joins its suffix link's set, the
smaller always into the larger. A new neighbour pair whose distance doesn't exceed
the state's length ends two copies side by side, a square; what exponent a run
must have tightens that bound. Squares are extended to both sides to whole runs.

Only stretches that can hold a run meet the automaton: in a run of exponent k each
three words in a row come back at least k - 1 times (more for period one), so words
that no such repeated triple covers lie in no run. The test is by hashes that can
only keep too much; it never parts a run.

Rows: a null or empty text has no words and no runs; very long texts are taken
whole; repeated rows each give a row; an empty table gives none; only the named
columns are read, so other columns can't clash; ids keep their type.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_crc, text_of, words_of

#: Elements in a block of an ordered set; blocks of twice as many are cut.
BLOCK = 1024
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


class Ends:
    """An ordered set of positions, in blocks."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, first: int):
        self.blocks, self.firsts, self.size = [[first]], [first], 1

    def add(self, x: int) -> tuple[int, int]:
        """Take in a position; the ones next to it on either side, -1 where there is none."""
        at = bisect_left(self.firsts, x)
        i = at - 1 if at else 0
        block = self.blocks[i]
        j = bisect_left(block, x)
        before = block[j - 1] if j else -1
        after = block[j] if j < len(block) else self.firsts[i + 1] if i + 1 < len(self.firsts) else -1
        block.insert(j, x)
        self.firsts[i] = block[0]
        self.size += 1
        if len(block) >= 2 * BLOCK:
            self.blocks[i : i + 1] = [block[:BLOCK], block[BLOCK:]]
            insort(self.firsts, block[BLOCK])
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def automaton(codes: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton: each state's link and length, and the state of each prefix."""
    link, size, steps, last, prefix = [-1], [0], [{}], 0, []
    for c in codes:
        new = len(size)
        size.append(size[last] + 1)
        link.append(0)
        steps.append({})
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(size)
                size.append(size[p] + 1)
                link.append(link[q])
                steps.append(steps[q].copy())
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
        prefix.append(new)
    return link, size, prefix


def squares(codes: Sequence[int], exponent: int) -> set[tuple[int, int]]:
    """(period, last position) of repetitions that runs of at least this exponent hold, one for each run at least."""
    link, size, prefix = automaton(codes)
    sets: list[Ends | None] = [None] * len(size)
    for end, state in enumerate(prefix):
        sets[state] = Ends(end)
    found = set()
    longest = np.argsort(-np.array(size), kind="stable").tolist()
    for state in longest:
        up, own = link[state], sets[state]
        sets[state] = None
        if up < 0 or size[up] < exponent - 1 or own is None:
            continue
        other = sets[up]
        if other is None:
            sets[up] = own
            continue
        if own.size > other.size:
            own, other = other, own
        most = size[up] // (exponent - 1)
        for x in own:
            before, after = other.add(x)
            if before >= 0 and x - before <= most:
                found.add((x - before, x))
            if after >= 0 and after - x <= most:
                found.add((after - x, after))
        sets[up] = other
    return found


def _agree(codes: np.ndarray, at: int, period: int, step: int) -> int:
    """How many words from ``at`` on, in one direction, equal those a period nearer to the square."""
    n, size, total = len(codes), 64, 0
    while True:
        if step > 0:
            own = codes[at : at + size]
            other = codes[at - period : at - period + len(own)]
        else:
            own = codes[max(at - size + 1, 0) : at + 1][::-1]
            other = codes[max(at - size + 1, 0) + period : at + 1 + period][::-1]
        differ = np.flatnonzero(own != other)
        if len(differ):
            return total + int(differ[0])
        total += len(own)
        at += step * len(own)
        if len(own) < size or at < 0 or at >= n:
            return total
        size *= 2


def runs_of(codes: Sequence[int], least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """All runs of length at least max(least, exponent * period), as (start, length, period), in order."""
    if len(codes) < max(least, exponent):
        return []
    array = np.asarray(codes, np.int64)
    periods: dict[tuple[int, int], int] = {}
    known, upto = 0, -1
    for period, end in sorted(squares(codes, exponent)):
        if period == known and end <= upto:
            continue
        first = end - 2 * period + 1
        first -= _agree(array, first - 1, period, -1) if first else 0
        upto = end + (_agree(array, end + 1, period, 1) if end + 1 < len(array) else 0)
        known = period
        if upto - first + 1 >= max(least, exponent * period):
            periods.setdefault((first, upto), period)  # the smallest comes first
    return sorted((first, last - first + 1, period) for (first, last), period in periods.items())


def stretches(words: Sequence[bytes], least: int, exponent: int) -> list[tuple[int, int]]:
    """Where runs can lie: (start, end) of stretches that repeated triples of words cover."""
    n, need = len(words), min(exponent - 1, max(least, exponent) - 2)
    if n < max(least, exponent):
        return []
    if need < 2 or max(least, exponent) < 3:
        return [(0, n)]
    h = np.fromiter(map(hash, words), np.int64, n)
    triple = (h[:-2] * 0x5851F42D + h[1:-1]) * 0x14057B7F + h[2:]
    order = np.argsort(triple)
    ordered = triple[order]
    edges = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])
    counts = np.diff(edges)
    if counts.max() < need:
        return []
    often = np.zeros(n, bool)
    often[order] = np.repeat(counts >= need, counts)
    edge = np.flatnonzero(np.diff(np.r_[False, often, False].astype(np.int8)))
    return [(int(a), int(b) + 2) for a, b in zip(edge[::2], edge[1::2], strict=True) if b + 2 - a >= max(least, exponent)]


def runs_of_words(words: Sequence[bytes], least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """All runs of a list of words."""
    out = []
    for begin, end in stretches(words, least, exponent):
        number: dict[bytes, int] = {}
        codes = [number.setdefault(w, len(number)) for w in words[begin:end]]
        out += [(begin + start, length, period) for start, length, period in runs_of(codes, least, exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, one space between them."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0))


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """Every row's runs by start and period, and its text with each run cut to its first period.

    A run has at least ``least`` words and ``exponent`` (a whole number from 2) periods.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, left = [], []
            for raw in batch.column(1).to_pylist():
                words = (raw or b"").split()  # bytes are split at ASCII white space and nothing else
                own = runs_of_words(words, least, exponent)
                found.append([dict(zip(RUN.names, r, strict=True)) for r in own])
                left.append(collapse(words, own))
            kind = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in RUN.names]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(left, pa.binary()).cast(pa.string())], names=[key, "runs", "collapsed"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return docs.select(key, F.col(text).cast("binary").alias(f"{text}_")).mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, the first of equal ones; null where there is none."""
    none = F.lit(None).cast(RUN.simpleString())
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """What ``find_runs`` found as numbers and digests: how many runs, the strongest, all runs, the text that is left."""
    best = strongest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(key, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed").select(
        key,
        "n_runs",
        *[F.col(f"best.{n}").alias(n) for n in RUN.names],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.concat("lines", F.when(F.col("n_runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, of which one in ten (by crc32 of its id) repeats a part of itself from some word to its end."""
    h = id_crc(F.col(key))
    words = F.col("words_")
    n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
    a = g % n
    p = F.lit(1) + F.expr("(n_ - a_) div (3 + g_ % 8)")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, (F.col("a_") + 1).cast("int"), F.col("p_").cast("int")), F.expr("cast((n_ - a_) div p_ + 1 as int)"))), F.lit(1), (F.col("n_") - F.col("a_")).cast("int"))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), F.col("a_").cast("int")), tail), " ")
    chosen = docs.select(F.col(key), text_of(text).alias(text), (h % 10 == 0).alias("chosen_"), g.alias("g_"))
    chosen = chosen.withColumn("words_", F.when(F.col("chosen_"), words_of(F.col(text)))).withColumn("n_", n).withColumn("a_", F.when(F.col("n_") > 0, a))
    return chosen.withColumn("p_", p).select(key, F.when(F.col("n_") > 0, planted).otherwise(F.col(text)).alias(text))

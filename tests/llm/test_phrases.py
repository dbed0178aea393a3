"""Phrase mining against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomstead.llm import phrases
from loomstead.llm.common import Workspace


def plain_counts(rows):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, text = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts, totals


def plain(rows, least=30, inside=80, top=2000):
    counts, totals = plain_counts(rows)
    out = []
    for lang, f in counts.items():
        held = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        longer = defaultdict(int)
        for p, n in held.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], n)
        scored = []
        for p, a in held.items():
            if 100 * longer[p] >= inside * a:
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def rows_with_ties(n=400, seed=2):
    rng = random.Random(seed)
    words = "the of and a to Ünder é x1 |".split() + [f"w{i}" for i in range(25)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words[: rng.choice([4, 9, 34])]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "fr", None]), text if i % 50 else None))
    return rows + [("en", "New York City is A fixed Phrase")] * 40 + [("de", "")] + [("fr", "of the")] * 35


@pytest.mark.parametrize("most_pointers", [None, 1, 60, 10**9])
def test_against_plain(spark, most_pointers):
    """However many prefixes are grown apart, counts and ranks are the same."""
    rows = rows_with_ties()
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = phrases.collocations(docs, Workspace(spark, "t"), most_pointers=most_pointers)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_fewer_rows_and_other_thresholds(spark):
    rows = rows_with_ties(150, 3)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, phrase string")
    assert sorted(map(tuple, phrases.collocations(docs, Workspace(spark, "t"), least=5, inside=50, top=7).collect())) == plain(rows, 5, 50, 7)
    assert phrases.collocations(docs.limit(0), Workspace(spark, "t")).collect() == []
    assert phrases.collocations(docs.where("text is null"), Workspace(spark, "t")).collect() == []


def test_blocks_are_halved_without_loss(monkeypatch):
    monkeypatch.setattr(phrases, "DIFFERENT", 9)
    monkeypatch.setattr(phrases, "BLOCK", 300)
    rows = [(r[0] or "und", r[1]) for r in rows_with_ties(60)]
    rows.append(("en", " ".join(f"w{i % 25}" for i in range(2000))))
    every = phrases.Bitmap(np.full(1 << (phrases.MAP_BITS - 6), np.uint64(2**64 - 1)))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([None if r[1] is None else r[1].encode() for r in rows], pa.binary())], names=["lang", "text"])
    got = defaultdict(Counter)
    for own in phrases.block_windows(iter([batch]), every):
        for window, n in zip(own.windows, own.counts, strict=True):
            words = [own.words[int(own.word(k, np.array([window]))[0])].decode() for k in range(1, 5)]
            for k in range(2, 5):
                if words[k - 1]:
                    got[own.lang][tuple(words[:k])] += int(n)
    want = {lang: Counter({p: n for p, n in c.items() if len(p) > 1}) for lang, c in plain_counts(rows)[0].items()}
    assert {lang: c for lang, c in got.items() if c} == {lang: c for lang, c in want.items() if c}


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 20} w{i % 7}" for i in range(60_000))
    docs = spark.createDataFrame([("en", text)], "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(docs, Workspace(spark, "t")).collect())) == plain([("en", text)])


def test_products_beyond_64_bits(spark):
    """Counts near 2^43, where 2000000 * a passes 2^63."""
    a, left, right = 8_796_093_022_207, 9_000_000_000_001, 8_796_093_022_208
    got = spark.sql(f"select {phrases.SCORE} s from values ({a}L, {left}L, {right}L) t(a, l, r)").first().s
    assert got == 2_000_000 * a // (left + right)

"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from loomstead.llm import queries, runs


def plain(words, least=6, exponent=4):
    """Every stretch whose words equal those a period later, by its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = [w for w in (text or "").encode().translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    left = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (6, 3), (3, 2), (10, 4)])
def test_words_against_plain(least, exponent):
    rng = random.Random(least * 10 + exponent)
    for _ in range(3000):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 2, 3])
        words = [b"%d" % rng.randint(0, k) for _ in range(n)]
        if n > 4 and rng.random() < 0.7:
            begin, period = rng.randint(0, n - 1), rng.randint(1, 6)
            for i in range(begin + period, n):
                words[i] = words[i - period]
            if rng.random() < 0.5:
                words[rng.randint(0, n - 1)] = b"other"
        assert runs.runs_of_words(words, least, exponent) == plain(words, least, exponent)


def test_ordered_sets_with_many_blocks(monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 2)
    rng = random.Random(1)
    own, taken = runs.Ends(50), [50]
    for x in rng.sample([i for i in range(200) if i != 50], 150):
        before, after = own.add(x)
        assert before == max((y for y in taken if y < x), default=-1) and after == min((y for y in taken if y > x), default=-1)
        taken.append(x)
    assert list(own) == sorted(taken) and own.size == len(taken)
    words = [b"a" if i % 7 else b"b" for i in range(500)]
    assert runs.runs_of_words(words, 2, 2) == plain(words, 2, 2)


def test_very_long_runs():
    words = [b"w%d" % (i % 20_000) for i in range(100_000)]
    assert runs.runs_of_words(words) == [(0, 100_000, 20_000)]
    assert runs.runs_of_words([b"x"] * 200_000) == [(0, 200_000, 1)]
    assert runs.collapse([b"x"] * 200_000, [(0, 200_000, 1)]) == b"x"


def test_query(spark, data):
    want = {r.doc_id: plain_row(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.QUERIES["op13_periodic_runs"](spark, data)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    assert sum(w[0] > 0 for w in want.values()) > 5


def test_rows_and_columns(spark):
    ids = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    rows = [(i, text, 1, "x") for i in ids for text in ("", None, "one", " \t\n ", "one two three four five six seven eight nine ten", "a " * 40)]
    rows += [(None, "a " * 20, 2, "y"), (None, None, 2, "y"), (1, "b\x0bb\x0cb\rb b b b b b b", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_ int, chosen_ string")
    got = runs.digest(runs.find_runs(runs.with_planted_runs(docs))).collect()
    want = [(r[0], *plain_row("" if r[0] is None else r[0], r[1])) for r in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert runs.find_runs(docs.limit(0)).collect() == []
    assert runs.find_runs(docs.selectExpr("cast(doc_id as string) doc_id", "text")).schema["doc_id"].dataType.simpleString() == "string"
    with pytest.raises(ValueError):
        runs.find_runs(docs, exponent=1)

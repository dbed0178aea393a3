"""The back-off model against a plain one that holds everything in dictionaries."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from loomstead.llm import katz
from loomstead.llm.common import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    texts = [(i, [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]) for i, t in rows]
    one, two = Counter(), Counter()
    for i, w in texts:
        if katz.trains(i):
            one.update(w)
            two.update(zip(["<s>", *w], w, strict=False))
    n, v = sum(one.values()), len(one)
    d = [katz.discounts([sum(c == r for c in x.values()) for r in range(katz.CUT + 2)]) for x in (one, two)]
    cut = lambda k, c: c * d[k][c] if c <= katz.CUT else c
    mass = sum(cut(0, c) for c in one.values())
    total = n if mass < n - 1e-9 else n + 1
    unknown = 1 - mass / total
    p1 = lambda w: cut(0, one[w]) / total if one[w] else unknown
    after = defaultdict(dict)
    for (a, b), c in two.items():
        after[a][b] = c
    ctx = {}
    for a, s in after.items():
        count, kept = sum(s.values()), sum(cut(1, c) for c in s.values())
        den = count + (kept > count - 1e-9)
        ctx[a] = den, (1 - kept / den) / (1 - sum(p1(b) for b in s))

    def p2(w, a):
        if w in after.get(a, ()):
            return cut(1, after[a][w]) / ctx[a][0]
        return ctx.get(a, (0, 1.0))[1] * p1(w)

    for a in [*list(after)[:20], "never"]:  # exactly normalised
        assert abs(sum(p2(w, a) for w in one) + p2("never", a) - 1) < 1e-9
    for i, w in texts:
        yield (
            -1 if i is None else i, not katz.trains(i), len(w), sum(one[x] > 0 for x in w), n,
            sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p2(b, a)) for a, b in zip(["<s>", *w], w, strict=False)),
        )


def same(got, want):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9), (a, b)


def test_against_plain(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").repartition(3)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    out = katz.score_documents(df, Workspace(spark, "t"), block_tokens=9000, bucket_keys=4000).collect()
    same(out, plain(rows))
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(30)))) for i in range(40)] + [(3, "a B\tc"), (3, "a B\tc"), (None, None), (99, ""), (98, "zz é")]
    make = lambda x: spark.createDataFrame([(*r, 1.0) for r in x], "doc_id long, text string, score double")
    same(katz.score_documents(make(rows), Workspace(spark, "t"), block_tokens=50, bucket_keys=20).collect(), plain(rows))
    untrained = [(i, "a b") for i in range(60) if not katz.trains(i)]
    same(katz.score_documents(make(untrained), Workspace(spark, "t")).collect(), plain(untrained))
    assert katz.score_documents(make(rows).limit(0), Workspace(spark, "t")).count() == 0


def plain_order(rows, order):
    """Scores by recursion over dictionaries."""
    texts = [(i, ["<s>", *WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]) for i, t in rows]
    counts = [Counter() for _ in range(order + 1)]
    for i, w in texts:
        if katz.trains(i):
            for n in range(1, order + 1):
                counts[n].update(tuple(w[k - n + 1 : k + 1]) for k in range(max(1, n - 1), len(w)))
    d = [None] + [katz.discounts([sum(c == r for c in x.values()) for r in range(katz.CUT + 2)]) for x in counts[1:]]
    cut = lambda n, c: c * d[n][c] if c <= katz.CUT else c
    after = defaultdict(dict)
    for n in range(1, order + 1):
        for g, c in counts[n].items():
            after[g[:-1]][g[-1]] = c
    known = {}

    def context(h):
        if h not in known:
            s, n = after[h], len(h) + 1
            count, kept = sum(s.values()), sum(cut(n, c) for c in s.values())
            den = count + (kept > count - 1e-9)
            known[h] = den, (1 - kept / den) / (1 - sum(p(b, h[1:]) for b in s) if h else 1)
        return known[h]

    def p(w, h):
        if h not in after:
            return p(w, h[1:]) if h else 1.0
        if w in after[h]:
            return cut(len(h) + 1, after[h][w]) / context(h)[0]
        return context(h)[1] * (p(w, h[1:]) if h else 1)

    for h in [h for h in list(after) if len(h) == order - 1][:20]:  # exactly normalised
        assert abs(sum(p(w, h) for w in after[()]) + p("never", h) - 1) < 1e-9
    return sorted((-1 if i is None else i, sum(math.log10(p(w[k], tuple(w[max(0, k - order + 1) : k]))) for k in range(1, len(w)))) for i, w in texts)


def test_longer_orders(spark, data):
    rng = random.Random(1)
    made = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(30)))) for i in range(60)] + [(3, "a B\tc"), (None, None), (99, ""), (98, "zz é a b c")]
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    for rows, order, block, bucket in ((made, 2, 50, 20), (made, 3, 50, 20), (made, 4, 50, 20), (given, 3, 9000, 4000)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = katz.score_documents(df, Workspace(spark, "t"), block_tokens=block, bucket_keys=bucket, order=order).collect()
        got, want = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in got), plain_order(rows, order)
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-9), order
    assert katz.score_documents(df.limit(0), Workspace(spark, "t"), order=3).count() == 0

"""The metric-space join against brute force."""

import random
import re

import numpy as np
import pytest

from loomstead.llm import jaccard as jc
from loomstead.llm.common import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def brute(rows):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            u = len(x | y)
            if u and 100 * len(x & y) >= 90 * u:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((-1 if i is None else i, len(shingle_set(t)), -1 if i is None else find(i)) for i, t in rows)


def near_copies(rng, n, words, changes):
    base = [f"w{rng.randrange(300)}" for _ in range(words)]
    out = []
    for _ in range(n):
        c = list(base)
        for _ in range(rng.choice(changes)):
            c[rng.randrange(words)] = f"x{rng.randrange(50)}"
        out.append(" ".join(c))
    return out


def test_signatures_lose_no_link():
    rng = np.random.default_rng(0)
    for _ in range(4000):
        n = int(rng.integers(9, 400))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        keep = int(rng.integers(0, n // 9 + 2))
        b = a[keep:]
        extra = int(rng.integers(0, n // 9 + 2))
        b = np.concatenate([b, rng.integers(0, 2**63, extra).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        i = len(np.intersect1d(a, b))
        if 100 * i >= 90 * (len(a) + len(b) - i) and i < max(len(a), len(b)):
            assert len(np.intersect1d(jc.signatures(a), jc.signatures(b)))


@pytest.mark.parametrize("leaf", [4, 256])
def test_components(spark, leaf):
    rng = random.Random(leaf)
    texts = near_copies(rng, 60, 80, [0, 1, 2, 3, 5]) + near_copies(rng, 40, 25, [0, 0, 1]) + near_copies(rng, 20, 12, [0, 1]) + near_copies(rng, 6, 3, [0, 1])
    texts += ["a b c", "A B\tc", "a b", "a  b", "a", "", None, " \n", "a b a b a b"] + [" ".join(f"q{i}" for i in range(k)) for k in range(8, 40)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[0]), (None, None), (5000, texts[0]), (5000, texts[70]), (5000, None), (5001, ""), (5001, texts[1])]  # repeated, without id, one id with two texts
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, component string").repartition(3)
    out = jc.jaccard_components(df, Workspace(spark, "t"), leaf=leaf).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in out)
    assert got == brute(rows)
    assert jc.jaccard_components(df.limit(0), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("leaf", [4, 256])
def test_provided_documents(spark, data, leaf):
    df = spark.read.parquet(f"{data}/documents.parquet")
    out = jc.jaccard_components(df, Workspace(spark, "t"), leaf=leaf).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute([(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize("kind", ["template", "nested", "mixed"])
def test_regions_that_cells_do_not_part(spark, kind):
    """One region of sets that are all as far from each other, with some links among them."""
    rng = random.Random(kind)
    common = [rng.getrandbits(63) for _ in range(40)]
    sets = {}
    for i in range(160):
        own = [rng.getrandbits(63) for _ in range(8 if kind == "template" else rng.randrange(1, 9))]
        if kind == "nested":
            own += common[: rng.randrange(10)]
        sets[i] = sorted({*common, *own})
        if i % 5 == 0:  # a near copy of another
            sets[i + 1000] = sorted({*sets[i][1:], rng.getrandbits(63)})
        if kind == "mixed" and i % 7 == 0:
            sets[i + 2000] = sorted({rng.getrandbits(63) for _ in range(60)})
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len({*sets[a]} & {*sets[b]})
            if a < b and 100 * n >= 90 * (len(sets[a]) + len(sets[b]) - n):
                root[max(find(a), find(b))] = min(find(a), find(b))
    members = spark.createDataFrame([(1, i, len(s)) for i, s in sets.items()], "region long, id long, size long")
    table = spark.createDataFrame([(i, bytearray(np.array(s, np.uint64).tobytes())) for i, s in sets.items()], "id long, set binary")
    work = Workspace(spark, "t")
    links = [(r.a, r.b) for x in jc.join_regions(members, table, work, leaf=5) for r in x.collect()]
    got = {i: i for i in sets}

    def top(x):
        while got[x] != x:
            x = got[x]
        return x

    for a, b in links:
        n = len({*sets[a]} & {*sets[b]})
        assert 100 * n >= 90 * (len(sets[a]) + len(sets[b]) - n)
        got[max(top(a), top(b))] = min(top(a), top(b))
    assert {i: top(i) for i in sets} == {i: find(i) for i in sets}


@pytest.mark.parametrize("bounds", [{}, {"few": 0}, {"few": 3}, {"few": 0, "most": 1}])
def test_rows_are_chosen_exactly(spark, bounds):
    ids = spark.range(50_000).selectExpr("id * 7919 - 1000 as id", "id % 3 = 0 as side")
    docs = ids.selectExpr("id as doc_id", "map('a', id) as rows", "1 as _id", "2 as own").unionByName(spark.sql("select cast(null as bigint) doc_id, map('a', 1L) rows, 1 _id, 2 own"))
    got = jc.select_rows(docs, "doc_id", ids, **bounds)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.id for r in ids.where("side").collect())


@pytest.mark.parametrize("bounds", [{}, {"few": 0}, {"few": 0, "most": 1}])
def test_one_of_each_is_kept_as_it_is(spark, bounds):
    """Columns of any name and kind come through; of rows with one id the first by text stays, and all rows without an id."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long), (3, long + " more"), (7, "else where now"), (7, "a different text"), (None, long), (None, None), (9, None)]
    docs = spark.createDataFrame([(i, t, {"k": i}, 1, 2, 3) for i, t in rows], "doc_id int, text string, rows map<string,int>, _id int, _n int, place int").repartition(2)
    got = jc.keep_one_of_each(docs, Workspace(spark, "t"), **bounds)
    assert got.columns == docs.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r._n) for r in got.collect()) == sorted(
        [(3, long + " more", 2), (7, "a different text", 2), (9, "", 2), (-1, long, 2), (-1, "", 2)]
    )

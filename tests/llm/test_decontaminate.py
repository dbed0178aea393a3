"""The FM-index and decontamination against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from loomstead.llm import decontaminate as de
from loomstead.llm.common import Workspace

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, bench, window=13):
    w = words(text)
    hit, items = set(), set()
    for item, t in bench:
        b = words(t)
        for i in range(max(1, len(b) - window + 1)) if b else ():
            p = b[i : i + window]
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    hit.update(range(j, j + len(p)))
                    items.add(item)
    return len(w), len(hit), items


def test_fm_index():
    rng = np.random.default_rng(1)
    for n, sigma, rate in ((1, 1, 4), (50, 2, 3), (700, 5, 16), (300, 200, 1)):
        s = np.append(rng.integers(0, sigma, n), 0)
        assert de.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        index = de.FMIndex(s, rate)
        for m in (1, 2, 4):
            phrases = rng.integers(1, sigma + 2, (20, m))
            for p, lo, hi in zip(phrases.tolist(), *index.search(phrases), strict=True):
                at = sorted(index.locate(np.arange(lo, hi)).tolist())
                assert at == [i for i in range(len(s) - m + 1) if s[i : i + m].tolist() == p]


def test_contamination(spark):
    rng = random.Random(3)
    vocab = ["der", "Über", "a", "b1", "zig", "日本"]
    text = lambda n: rng.choice(["", " ", "\n"]).join([""] * 2).join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "\x00"]) for _ in range(n))
    bench = [(i, text(rng.choice([0, 1, 3, 13, 20, 40]))) for i in range(12)] + [(3, "zig zig"), (99, None)]
    docs = [(i, text(rng.choice([0, 1, 12, 60])) + (bench[i % 12][1] or "") * (i % 3) + text(30)) for i in range(60)]
    docs += [(7, docs[7][1]), (None, None), (100, ""), (101, bench[5][1] * 300)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame([(*x, "y") for x in [*bench, (None, "der")]], "item_id long, text string, spans string")
    whole = {}
    for size, block in ((100, 10**6), (10**6, 50)):  # many shards; many blocks
        out = de.hits(de.find_contamination(d, b, shard_words=size, block_words=block)).collect()
        got = sorted((r.doc_id or 0, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in out)
        want = [(i or 0, *brute(t, bench)) for i, t in docs]
        assert got == sorted((i, n, h, tuple(sorted(x)), h > 0 and 20 * h >= n) for i, n, h, x in want)
        whole = {r.doc_id: r for r in out}
    cut = d.where("doc_id is not null").dropDuplicates().join(spark.createDataFrame(list(whole.values()), de.hits(de.find_contamination(d, b)).schema).select("doc_id", "spans"), "doc_id")
    for r in cut.select("doc_id", F.col("text").alias("t"), de.remove_spans(F.col("text"), F.col("spans")).alias("left")).collect():
        assert len(words(r.t)) - whole[r.doc_id].n_hit >= 0
        kept = [w for i, w in enumerate(words(r.t)) if not any(x.start <= i < x.end for x in whole[r.doc_id].ranges)]
        assert "".join(words(r.left)) == "".join(kept)
    assert de.find_contamination(d.limit(0), b).count() == 0
    assert de.hits(de.find_contamination(d, b.limit(0))).where("n_hit > 0").count() == 0


def test_carried_rows_move_their_text_once(spark):
    """What goes into the search and between blocks has the text in the row alone; null texts come through as they are."""
    seen = []

    class Work(Workspace):
        def save(self, df, name, **how):
            seen.append((df.columns, df.schema["row"].dataType.names))
            return super().save(df, name, **how)

    rows = [(1, None, 5), (2, "a b c d", 6), (3, "e f x", 7), (None, "no hit", 8), (4, "", 9)] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").select("row", "text", "doc_id")
    bench = spark.createDataFrame([(1, "b c"), (2, "e f"), (3, "q")], "item_id long, text string")
    alone = {(r.doc_id, r.n_words, r.n_hit, *r["items"]) for r in de.hits(de.find_contamination(docs, bench)).collect()}
    for shard, block in ((10**6, 10**6), (3, 1)):  # one block; three, with shards that end within a batch
        found = de.hits(de.find_contamination(docs, bench, Work(spark, "t"), carry=True, shard_words=shard, block_words=block))
        plan = found._jdf.queryExecution().analyzed().toString()
        assert "AS text#" not in plan and "coalesce(text#" not in plan
        found = found.collect()
        assert {(r.doc_id, r.n_words, r.n_hit, *r["items"]) for r in found} == alone
        assert sorted(map(repr, (tuple(r["row"]) for r in found))) == sorted(map(repr, ((n, t, i) for i, t, n in rows)))
        assert all(r["row"]["text"][s.start : s.end] in ("b c", "e f") for r in found for s in r.spans)
    assert len(seen) > 1 and all(s == (["doc_id", "ranges", "items", "row"], ["row", "text", "doc_id"]) for s in seen)
    # a text that isn't a plain column of the row by this name comes beside it
    other = de.hits(de.find_contamination(docs, bench, text="TEXT", carry=True)).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, *r["items"]) for r in other} == alone

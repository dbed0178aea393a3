"""URL filters, quality rules and chat formatting against brute force."""

import datetime as dt
import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from loomstead.llm import chat, quality, urls
from loomstead.llm.common import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    win = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(win)
    hit = {j for i, w in enumerate(win) if often[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_measures(spark, data):
    odd = ["", None, " \n\t ", "a", "a b c a b c a b", "x\nx\n \nx y\nx", "é|<> 𝄞 # b  c", "w " * 500]
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(-i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string"))
    texts = {r.doc_id: r.text for r in docs.where("doc_id <> 0").collect()}
    # lengths as hashes: windows meet all the time, and the slow way must give the same
    for how in (quality.WINDOW_HASH, "cast(length(words[i]) as bigint) << 40"):
        got = quality.measure(docs.where("doc_id <> 0").where("length(text) < 3000 or text is null"), window_hash=how).collect()
        assert len(got) > 100
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id]), r.doc_id


def test_binomial_tail_is_exact(spark):
    rows = spark.createDataFrame([(n, k) for n in (1, 10, 400, 3000) for k in (0, 1, 3, 9) if k <= n], "n long, k long")
    for r in rows.withColumn("p", F.expr(quality.binomial_tail("n", "k", 0.01))).collect():
        exact = sum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == 1.0 if r.k > r.n * 0.01 else abs(r.p - exact) < 1e-9 * exact


def test_thresholds_bound_false_rejection(spark):
    plain = "".join(f"w{j} " for j in range(100))
    rows = [(i, plain + "# " * (i % 2 * 30 if i >= 2000 else i % 500 == 0), "en", 9) for i in range(4000)]
    docs = spark.createDataFrame([(a, b + str(a), c, d) for a, b, c, d in rows], "doc_id long, text string, lang string, extra int")
    labels = docs.select("doc_id", F.expr("if(doc_id < 2000, 1, 0)").alias("quality"), F.lit(1).alias("lang"))
    out = quality.quality_rules(docs, labels, Workspace(spark, "t")).collect()
    assert sum(not r.kept for r in out if r.doc_id < 2000) <= 0.05 * 2000
    assert all(r.kept == (r.doc_id % 2 == 0) for r in out if r.doc_id >= 2000)
    few = quality.quality_rules(docs, labels.where("doc_id < 20"), Workspace(spark, "t")).collect()
    assert all(r.kept for r in few)  # too few labels reject nothing
    assert quality.quality_rules(docs.limit(0), labels.limit(0), Workspace(spark, "t")).count() == 0


def test_chat_round_trip(spark):
    nasty = ["</s>", "<\\/s>", "[TURN]x[/TURN]<s>", "\\", "<s", "", None, "[/TURN]\\[\\TURN] 𝄞 é"]
    rows = [(c, t, r, nasty[(c + t) % len(nasty)], 1) for c in range(8) for t, r in enumerate(["system", "user", "assistant", "</s>", "assistant", "user"][: c + 1])]
    rows += [(None, None, None, "z", 1), (5, 0, "system", "again", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}
    examples = chat.format_conversations(df).collect()
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = out[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(e.formatted) for e in examples if e.conv_id == c)
    assert sum(e.loss_start is not None for e in examples) == sum(r[2] == "assistant" for r in rows)
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_url_intervals(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    entries = spark.createDataFrame(
        [("host", "a.b.com", "x", "add", t(2)), ("host", "a.b.com", "x", "remove", t(5)), ("host", "a.b.com", "x", "add", t(8)), ("domain", "b.com", "y", "add", t(4)),
         ("path", "q.org/p", "z", "add", t(1)), ("host", "c.d", "x", "add", t(3)), ("host", "c.d", "x", "remove", t(3)), ("host", None, "x", "add", t(1)), ("host", "n", "x", "add", None)],
        "kind string, key string, category string, action string, listed_at timestamp",
    )
    cases = [("http://A.b.com:80/", 1, ""), ("http://a.b.com", 2, "x"), ("https://u@a.b.com./q?x", 4, "x,y"), ("http://a.b.com", 5, "y"), ("http://a.b.com", 9, "x,y"),
             ("http://xb.com", 9, ""), ("http://z.b.com/", 9, "y"), ("http://q.org/p/1", 3, "z"), ("http://q.org/o", 3, ""), ("http://c.d", 4, ""), ("nonsense", 4, ""), (None, 4, ""), ("http://q.org/p/1", None, "")]
    cases += cases[:1]
    caps = spark.createDataFrame([(i, u, d and t(d), "k") for i, (u, d, _) in enumerate(cases)], "page_id long, url string, fetched_at timestamp, key string")
    out = urls.filter_captures(caps, urls.validity(entries)).collect()
    assert sorted((r.capture_id, r.categories, r.blocked) for r in out) == [(i, c, bool(c)) for i, (_, _, c) in enumerate(cases)]
    assert urls.filter_captures(caps.limit(0), urls.validity(entries.limit(0))).count() == 0
    assert urls.filter_captures(caps, urls.validity(entries.limit(0))).where("blocked").count() == 0

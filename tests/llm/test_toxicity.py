"""The toxicity classifier on held-out rows, its counterfactual term, and odd inputs."""

import numpy as np
from pyspark.sql import functions as F

from loomstead.llm import toxicity as tox


def test_held_out_accuracy(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/{t}.parquet") for t in ("documents", "labels"))
    model = tox.fit(docs, labels, tox.is_held_out(F.col("doc_id")))
    out = tox.score(docs, model).withColumn("held_out", tox.is_held_out(F.col("doc_id"))).join(labels, "doc_id").where("held_out")
    r = out.selectExpr("count_if(toxic = 1) t", "count_if(toxic = 0) c", "count_if(toxic = 1 and score >= 0.5) tp", "count_if(toxic = 0 and score >= 0.5) fp").first()
    assert r.tp >= 0.85 * r.t and r.fp <= 0.01 * r.c, r


def test_neutral_mentions_are_not_toxic():
    f = tox.Features()
    rng = np.random.default_rng(0)
    plain = [f"w{i}" for i in range(200)]
    texts, y = [], []
    for i in range(600):  # toxic texts mostly name a group; clean ones seldom do
        words = list(rng.choice(plain, 30))
        bad = i % 3 == 0
        words += ["vile"] * (bad and rng.random() < 0.7) + ["gay"] * int(rng.random() < (0.8 if bad else 0.02))
        texts.append(" ".join(words))
        y.append(float(bad))
    x = [f.of(t) for t in texts]
    pairs = [p for t in texts for p in tox.counterfactuals(t, f, tox.IDENTITY_TERMS)]
    gap = {}
    for fairness in (0.0, 50.0):
        m = tox.train(x, np.array(y), pairs, fairness=fairness)
        w = m.dense()
        gap[fairness] = w[f.of("gay")].sum()
        assert w[f.of("vile")].sum() > 1
    assert gap[0.0] > 1 and abs(gap[50.0]) < 0.3 * gap[0.0]


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "", 0.1), (1, None, 0.2), (None, "x", 0.3), (2, "bad " * 50000, 0.4)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in tox.score(docs, tox.fit(docs, none)).collect()] == [0.0] * 4
    one = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    assert {r.score for r in tox.score(docs, tox.fit(docs, one)).collect()} == {1.0}
    both = spark.createDataFrame([(1, 0), (2, 1), (2, 1)], "doc_id long, toxic int")
    out = tox.score(docs, tox.fit(docs, both)).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert tox.score(docs.limit(0), tox.fit(docs, both)).count() == 0


def test_every_naming_is_swapped():
    f = tox.Features()
    plain = "One two. Three four. Five six. Seven eight. "
    pairs = tox.counterfactuals(plain + "All (women), they said. Nine ten. " + "And men! " * 70, f, tox.IDENTITY_TERMS)
    named = [(p, q) for p, q in pairs if len(np.setdiff1d(p, q))]
    assert len(pairs) == 3 + 71 and len(named) == 71
    assert set(f.of("women")) <= set(named[0][0]) and not set(f.of("women")) <= set(named[0][1])


def test_long_texts_keep_all_features(spark):
    f = tox.Features()
    word = next(w for w in (f"{i:02d}" for i in range(100)) if f.of(w).min() > 0.9 * (1 << tox.BITS))  # last in the order of features
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"{x:08x}" for x in rng.integers(0, 1 << 32, 8000)) + f" {word if i % 2 else 'fine'}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert tox.fit(docs, labels).dense()[f.of(word)].sum() > 1


def test_rows_are_bounded_and_ids_keep_their_type(spark):
    rows = [("a", f"vile text {i}") for i in range(300)] + [(f"c{i}", f"calm text {i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i == "a")) for i in {r[0] for r in rows}], "doc_id string, toxic int")
    seen = []
    train, tox.train = tox.train, lambda x, *a, **k: seen.append(len(x)) or train(x, *a, **k)
    least, tox.telling = tox.telling, lambda a, b, t, n, least=1: (np.flatnonzero(a > b), np.log((a + 0.5) / (b + 0.5)))
    try:
        model = tox.fit(docs, labels)
    finally:
        tox.train, tox.telling = train, least
    assert seen in ([], [6])
    assert tox.score(docs, model).schema["doc_id"].dataType.simpleString() == "string"


def plain_loss(m, x, y, pairs, w, scale, l2, fairness):
    """The loss in plain Python; w by feature."""
    total = lambda f: sum(w.get(int(i), 0.0) * scale.get(int(i), 0.0) for i in f)
    n, toxic = len(x), sum(y)
    weights = [(0.5 * n / toxic) ** 0.5 if t else (0.5 * n / (n - toxic)) ** 0.5 for t in y]
    mean = sum(weights) / n
    out = 0.0
    for f, t, c in zip(x, y, weights, strict=True):
        z = m.intercept + total(f)
        out += c / mean * (np.log1p(np.exp(-abs(z))) + max(z, 0) - t * z) / n
    out += l2 / 2 * sum(v * v for v in w.values())
    return out + fairness / 2 * sum((total(set(q) - set(p)) - total(set(p) - set(q))) ** 2 for p, q in pairs) / len(pairs)


def test_fit_is_the_minimum_of_the_plain_loss():
    f, rng = tox.Features(12), np.random.default_rng(3)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "women", "men"], 4)) + (" vile" if i % 3 == 0 and i % 4 else "") for i in range(60)]
    y = np.array([float(i % 3 == 0) for i in range(60)])
    x = [f.of(t) for t in texts]
    pairs = [p for t in texts for p in tox.counterfactuals(t, f, tox.IDENTITY_TERMS)]
    old, tox.telling = tox.telling, lambda a, b, t, n, least=1: (np.flatnonzero(a > 0), 1.0 + np.arange(len(a)) % 3)
    try:
        m = tox.train(x, y, pairs, bits=12, l2=0.01, fairness=2.0, steps=6000)
    finally:
        tox.telling = old
    scale = {int(i): 1.0 + int(i) % 3 for i in m.features}
    w = {int(i): v / scale[int(i)] for i, v in zip(m.features, m.weights, strict=True)}
    best = plain_loss(m, x, y, pairs, w, scale, 0.01, 2.0)
    for i in w:
        for step in (1e-3, -1e-3):
            if w[i] + step >= 0:
                assert plain_loss(m, x, y, pairs, w | {i: w[i] + step}, scale, 0.01, 2.0) > best - 1e-7
    for step in (1e-3, -1e-3):
        moved = tox.Model(m.intercept + step, m.features, m.weights, 12)
        assert plain_loss(moved, x, y, pairs, w, scale, 0.01, 2.0) > best - 1e-7


def plain_features(words):
    import zlib

    out = set()
    for w in words:
        w = w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        if w:
            out.add(zlib.crc32(b"=" + w.encode()) % (1 << tox.BITS))
            out |= {zlib.crc32(b"^" + w[:n].encode()) % (1 << tox.BITS) for n in range(3, min(7, len(w)) + 1)}
    return out


def test_pairs_against_a_plain_version():
    text = "Women, men and (jews) met.\nWe saw Gay men! A calm day. Nothing at all here? One more. And one. \u00c4rger mit Frauen"
    want, step, added = [], 0, 0
    terms = list(tox.IDENTITY_TERMS)
    for s in __import__("re").split(r"[.!?\n]+", text):
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in s.split()]
        bare = [w.strip("!,.()?") for w in words]
        if any(b in terms for b in bare):
            k = 1 + step % (len(terms) - 1)
            other = [terms[(terms.index(b) + k) % len(terms)] if b in terms else w for w, b in zip(words, bare, strict=True)]
        elif words and added < 3:
            added += 1
            other = [*words, terms[__import__("zlib").crc32(s.encode()) % len(terms)]]
        else:
            continue
        want.append((plain_features(words), plain_features(other)))
        step += 1
    got = tox.counterfactuals(text, tox.Features(), tox.IDENTITY_TERMS)
    assert [(set(p.tolist()), set(q.tolist())) for p, q in got] == want

"""One-pass lexicons and places of cues against plain Python."""

import random
import re

from pyspark.sql import functions as F

from loomstead.functions import literals, vocabulary
from loomstead.operators import lexicons, places, windows
from loomstead.operators.extract import extract

PATTERNS = [p for bank in (vocabulary.CLEAN_MODELS, vocabulary.CLEAN_VISION, vocabulary.CLEAN_FUSION, vocabulary.BACKFILL_OBJECTIVES) for p, _ in bank]
PATTERNS += [p for bank in (vocabulary.DATASETS, vocabulary.VISION, vocabulary.FAMILIES) for ps in bank.values() for p in ps]
WORDS = "gpt-3 GPT 2 gpt-4vision vit vitb16 ViT-b/16 swin clip resnet 50 cross attention co-attention gated itm image-text matching mimic-cxr iu x-ray open-i nih chestx-ray14 blip-2 instruct blip qwen2-vl bert t5".split()


def test_required_parts_are_in_every_match():
    rng = random.Random(1)
    hits = 0
    for _ in range(20_000):
        text = "".join(rng.choice(WORDS) + rng.choice([" ", "-", "", " "]) for _ in range(rng.randint(1, 6)))
        p = rng.choice(PATTERNS)
        if re.search(p, text, re.I):
            hits += 1
            assert any(part in text.lower() for part in literals.required(p)), (p, text)
    assert hits > 200
    assert literals.required("[0-9]{3}") == literals.required("(a|b)?c?") == literals.required("x|[yz]") == frozenset()
    assert literals.required(r"\b(itm|image[- ]text matching)\b") == {"itm", "text matching"}


def test_terms_that_overlap(spark):
    terms = ["blip", "BLIP-2", "lip", "p-2 x", "a.b", "a", "é x", "ct", "contrastive", "rag"]
    texts = ["BLIP-2 x", "a.b", "axb É X", "coverage; Contrastive", "", None, "blip blip-2", "x" * 50_000 + "rag"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.f for r in df.select("i", literals.found_terms(F.col("t"), terms).alias("f")).collect()}
    for i, t in enumerate(texts):
        low = (t or "").lower()
        want = sorted((low.find(x.lower()), x.lower()) for x in terms if x.lower() in low)
        assert (got[i] or []) == [x for _, x in want]
    assert df.select(literals.holds_any(F.col("t"), terms).alias("h")).where("h").count() == 6


def test_letters_beyond_ascii_that_a_pattern_takes(spark):
    lexicons = literals.Lexicons({"f": [("kiss", "K"), (r"\bs\b", "S")]})
    df = spark.createDataFrame([("a Kİſs here",), ("ſ",), ("none",)], "t string").withColumn("found", lexicons.terms_in(F.col("t")))
    got = df.select(lexicons.labels(lexicons.hits(F.col("found"), F.col("t")), "f").alias("l"), F.col("t").rlike("(?iu)kiss").alias("k"), F.col("t").rlike(r"(?iu)\bs\b").alias("s")).collect()
    assert all(r.l == ["K"] * r.k + ["S"] * r.s for r in got)


def test_lexicons_against_each_pattern_alone(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(WORDS) + rng.choice([" ", "-", "", ", "]) for _ in range(rng.randint(0, 8))) for _ in range(300)] + [None, ""]
    lists = {"models": vocabulary.CLEAN_MODELS, "fusion": vocabulary.CLEAN_FUSION, "digits": [("[0-9]{2}", "two"), ("[0-9]", "one")]}
    lexicons = literals.Lexicons(lists)
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("found", lexicons.terms_in(F.col("t")))
    df = df.withColumn("hits", lexicons.hits(F.col("found"), F.col("t")))
    got = df.select("t", *[lexicons.labels(F.col("hits"), f).alias(f) for f in lists], lexicons.first(F.col("hits"), "models", "none").alias("first")).collect()
    for r in got:
        for f, rows in lists.items():
            want = list(dict.fromkeys(label for p, label in rows if re.search(p, r.t or "", re.I)))
            assert r[f] == want, (r.t, f)
        assert r["first"] == (r.models or ["none"])[0]


def test_sums(spark, monkeypatch):
    for run in (2, 3, 256):
        monkeypatch.setattr(places, "RUN", run)
        df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 2, 3, 4, 7, 9, 20)], "x array<int>")
        for r in df.select("x", places.sums_before(F.col("x")).alias("s")).collect():
            assert r.s == [sum(r.x[:i]) for i in range(len(r.x))]


def around(text, start, width):
    return text[max(0, start - width) : start + width]


def test_anchored_cues_against_slices(spark):
    rng = random.Random(3)
    words = ["cue", "cues", "anchor", "anchors", "xanchor", "Anchored", "é", "𝒳", "other", "-", "lead", "misleading"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(250)] + [None, "", "cue", "anchor " * 400 + "cue" + " anchor" * 300]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"found": F.lit(1), "cell": F.lit("x"), "kinds": F.lit(2)})
    cues, anchor = {"a": r"\bcue(s)?\b", "b": "lead", "c": r"\bé\b"}, r"\banchor(s|ed)?\b"
    for width in (7, 12, 80):
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.labels) for r in windows.anchored(df, "doc_id", "text", cues, anchor, width).collect()), key=repr)
        want = [(i is None, i or 0, [k for k, p in cues.items() if any(re.search(anchor, around(t or "", m.start(), width), re.I) for m in re.finditer(p, t or "", re.I))]) for i, t in rows]
        assert got == sorted(want, key=repr)


def test_records_against_slices(spark):
    """Roles of data sets and anchored labels, as a search in each mention's surroundings gives them."""
    rng = random.Random(4)
    v = vocabulary
    words = ["MIMIC-CXR", "CheXpert", "IU X-Ray", "training", "trained", "pretraining", "evaluated", "evaluation", "test", "contest", "reports", "caption", "context", "text", "paired data", "vit", "BERT", "t5",
             "encoder", "decoder", "image", "vision", "television", "language model", "cross-attention", "attention", "loss", "contrastive", "x", "of the", "and", "."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    got = {int(r.File): r for r in extract(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    any_of = lambda patterns, t: any(re.search(p, t, re.I) for p in patterns)
    for i, t in enumerate(texts):
        roles, paired = {"train": set(), "eval": set()}, False
        for name, patterns in v.DATASETS.items():
            for near in (around(t, m.start(), 80) for p in patterns for m in re.finditer(p, t, re.I)):
                said = [r for r, p in (("train", v.TRAIN_WORDS), ("eval", v.EVAL_WORDS)) if any_of(p, near)]
                for r in said or roles:
                    roles[r].add(name)
                paired |= (name in v.PAIRED_DATASETS or any_of(v.PAIRED_PHRASES, near)) and any_of(v.REPORT_WORDS, near)
        assert (got[i]["Datasets (train)"], got[i]["Datasets (eval)"], got[i]["Paired"]) == (", ".join(sorted(roles["train"])), ", ".join(sorted(roles["eval"])), "Yes" if paired else ""), t
        for column, cues, field in (("Vision Enc", v.VISION, "vision"), ("Lang Dec", v.LANGUAGE, "language"), ("Objectives", v.OBJECTIVES, "objectives"), ("Fusion", v.FUSION, "fusion")):
            labels = [x for x, ps in cues.items() if any(any_of(v.ANCHORS[field], around(t, m.start(), 80)) for p in ps for m in re.finditer(p, t, re.I))]
            assert got[i][column] == ", ".join(sorted(labels, key=str.lower)), t


def test_a_hundred_thousand_patterns(spark):
    """Against nested loops over those that any text could meet; the others share no word with a text."""
    rng = random.Random(6)
    words = [f"w{i}q" for i in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(60)] + ["W7Q  w8q", None, "", "w7q w8q", "tab\tab 12"]
    texts += texts[:2]
    patterns = [rf"(?i)\b{words[rng.randrange(3000)]}\s+{words[rng.randrange(3000)]}\b" for _ in range(2000)] + [r"(?i)w7q\s+w8q", r"w7q\s", "[0-9]{2}", "^tab", "a|b", r"(?i)\p{Lu}w", "w1q|w2q|zzzz", "no part", None]
    patterns += [rf"\b{a}.{{0,3}}{b}" for t in texts[:20] for a, b in [(t.split()[3], t.split()[4])]]
    none = [rf"\bx{i}y[- ]?z{i}\b" for i in range(100_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lexicon = spark.createDataFrame([(p, "some") for p in patterns], "pattern string, label string").union(spark.createDataFrame([(p, "none") for p in none], "pattern string, label string"))
    lexicon = lexicon.union(lexicon.limit(3))  # repeated rows
    loops = sorted(map(tuple, docs.join(lexicon.where("label = 'some'"), F.expr("text rlike pattern")).collect()))
    got = lexicons.join_lexicon(docs, lexicon, "text", block=3)
    assert got.columns == ["doc_id", "text", "pattern", "label"]
    assert sorted(map(tuple, got.collect())) == loops and len(loops) > 50
    # a table that fits into one expression gives the same rows, and so does one that each row goes through
    assert sorted(map(tuple, lexicons.join_lexicon(docs, lexicon.where("label = 'some'"), "text").collect())) == loops
    few = lexicon.where("label = 'some' and (length(pattern) < 16 or pattern like '%.{0,3}%')")
    assert few.count() < lexicons.IN_A_ROW
    loops = sorted(map(tuple, docs.join(few, F.expr("text rlike pattern")).collect()))
    assert sorted(map(tuple, lexicons.join_lexicon(docs, few, "text").collect())) == loops and len(loops) > 50
    assert lexicons.join_lexicon(docs, lexicon.limit(0), "text").count() == lexicons.join_lexicon(docs.limit(0), lexicon, "text").count() == 0

"""Hand-written rows for the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from loomstead.functions import lexicon, missing, stats, tokens


def values(spark, rows, *columns, schema="c string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    out = df.select(*[c.alias(f"o{i}") for i, c in enumerate(columns)]).collect()
    return [tuple(r) if len(r) > 1 else r[0] for r in out]





def test_missing_policies(spark):
    rows = [None, "", " N/A ", "nr", "—", "not  reported", "\tNot reported\n", "Not reported", "x", "nan", "-"]
    want = {
        "eval": [1, 1, 1, 1, 0, 1, 1, 1, 0, 0, 0],
        "compare": [1, 1, 1, 0, 0, 0, 1, 1, 0, 1, 1],
        "long_dashes": [1, 1, 1, 0, 1, 0, 1, 1, 0, 0, 1],
        "mask": [1, 1, 1, 0, 1, 0, 1, 1, 0, 0, 1],
        "coverage": [1, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0],
        "gold": [1, 1, 0, 0, 0, 0, 1, 1, 0, 0, 0],
        "fuse": [1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0],
    }
    for policy, w in want.items():
        assert [int(x) for x in values(spark, rows, missing.is_missing(F.col("c"), policy))] == w, policy


def test_keys_and_truth(spark):
    rows = ["a.txt", "A.TXT", "a  b.pdf", "x.txt.y"]
    assert values(spark, rows, missing.norm_key(F.col("c"), "one_txt")) == ["a", "A.TXT", "a  b.pdf", "x.txt.y"]
    assert values(spark, rows, missing.norm_key(F.col("c"), "lower")) == ["a", "a", "a b", "x.txt.y"]
    assert values(spark, rows, missing.norm_key(F.col("c"), "cased")) == ["a", "A", "a b", "x.txt.y"]
    assert values(spark, rows, missing.norm_key(F.col("c"), "any_txt")) == ["a", "A.TXT", "a  b.pdf", "x.y"]
    rows = ["1", "1.0", "true", "Y", "0.5", "x", None]
    got = [values(spark, rows, missing.truthy(F.col("c"), v)) for v in ("words", "listed", "positive", "one")]
    assert [[int(x) for x in g] for g in got] == [[1, 0, 1, 1, 0, 0, 0], [1, 1, 1, 1, 0, 0, 0], [1, 1, 0, 0, 1, 0, 0], [1, 1, 0, 0, 0, 0, 0]]
    assert values(spark, ["yes", "0", "maybe", None], missing.tri_state(F.col("c"))) == ["Yes", "No", "Not reported", "Not reported"]
    assert values(spark, ["maybe"], missing.tri_state(F.col("c"), keep_unknown=True)) == ["maybe"]


def test_tokens(spark):
    cell = "ViT; CLIP and BERT + T5 & GRU|LSTM/CNN，Swin, , CLIP"
    assert values(spark, [cell], tokens.split_multi(F.col("c"))) == [["ViT", "CLIP", "BERT", "T5", "GRU", "LSTM", "CNN", "Swin", "CLIP"]]
    assert values(spark, ["b A;a", None], tokens.token_set(F.col("c"))) == [["a", "b a"], []]
    assert values(spark, ["x & y; Not Reported"], tokens.label_set(F.col("c"))) == [["x & y"]]
    assert values(spark, ["B, a; B"], tokens.vote_tokens(F.col("c"))) == [["B", "a"]]
    assert values(spark, ["BLEU, bleu, BLEU, Rouge"], tokens.distinct_ci(tokens.split_multi(F.col("c")))) == [["BLEU", "Rouge"]]
    rules = [("gpt-4v?", "GPT-4V"), ("gpt-4", "GPT-4"), ("blip-?2", "BLIP-2"), (r"\bblip\b", "BLIP")]
    assert values(spark, ["gpt-4, gpt-4v, blip-2, blip, instruct-blip, other, not reported"], tokens.canonical(F.col("c"), rules)) == ["GPT-4V, BLIP-2, BLIP, other"]
    once = values(spark, ["b2; blip+gpt-4 and z"], tokens.canonical(F.col("c"), rules))
    assert values(spark, once, tokens.canonical(F.col("c"), rules)) == once  # idempotent
    assert values(spark, ["vqa; vlm, caption"], F.struct(*tokens.move_tokens(F.col("c"), F.lit("x"), "vqa|capt")))[0] == (["vlm"], ["caption", "vqa", "x"])


def test_lexicon(spark):
    lex = [("b+", "B"), ("a", "A"), ("aa", "B")]
    assert values(spark, ["xAAx", "b", None], lexicon.all_labels(F.col("c"), lex)) == [["A", "B"], ["B"], []]
    assert values(spark, ["xAAx b", "", None], lexicon.first_label(F.col("c"), lex, "-")) == ["B", "-", "-"]
    assert values(spark, ["zz Foo bar"], lexicon.terms_by_position(F.col("c"), ["bar", "foo", "no"])) == [["foo", "bar"]]
    assert values(spark, ["B1 a2 b1"], lexicon.find_all(F.col("c"), "[a-zA-Z][0-9]")) == [["a2", "b1"]]
    assert values(spark, ["X-Ray, ct, MRI"], lexicon.gate(F.col("c"), F.lit("an x ray and a CT"))) == [["X-Ray", "ct"]]


@pytest.mark.parametrize("b,c", [(0, 3), (5, 9), (40, 60), (0, 0), (300, 900)])
def test_mcnemar(spark, b, c):
    n, k = b + c, min(b, c)
    exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else None
    got = values(spark, [(b, c)], stats.mcnemar("b", "c"), schema="b long, c long")[0]
    assert got is None if exact is None else abs(got - exact) <= 1e-9 * exact


def test_wilson_holds_the_share(spark):
    for k, n, lo, hi in values(spark, [(0, 0), (0, 5), (5, 5), (72, 134)], F.col("k"), F.col("n"), *stats.wilson(F.col("k"), F.col("n")), schema="k long, n long"):
        assert 0 <= lo <= (k / n if n else 0) <= hi <= 1
    lo, hi = values(spark, [(72, 134)], *stats.wilson(F.col("k"), F.col("n")), schema="k long, n long")[0]
    assert (round(lo, 3), round(hi, 3)) == (0.453, 0.620)

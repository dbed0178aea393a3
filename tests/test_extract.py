"""Records from hand-written texts."""

import pytest

from loomstead.functions import literals
from loomstead.operators import windows
from loomstead.operators.extract import extract


def records(spark, texts, mode="strict"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.asDict() for r in extract(df, mode=mode).orderBy("File").collect()]


def test_strict_record(spark):
    a, b, c = records(
        spark,
        [
            "We use a ViT image encoder with a BERT text decoder. Training used MIMIC-CXR reports. " + "." * 200 + "Evaluation on IU X-Ray text. A contrastive loss. Cross-attention fusion. BLEU and CIDEr.",
            "BLIP-2 with retrieval-augmented generation; chest x-ray report generation. CT.",
            None,
        ],
    )
    assert (a["Datasets (train)"], a["Datasets (eval)"], a["Paired"], a["Modality"]) == ("MIMIC-CXR", "IU X-ray", "Yes", "X-Ray")
    assert (a["Vision Enc"], a["Lang Dec"], a["Objectives"], a["Fusion"], a["Metrics(primary)"]) == ("ViT", "BERT", "contrastive", "cross-attention", "BLEU, CIDEr")
    assert (b["Family"], b["VLM?"], b["Class"], b["RAG"], b["Task"], b["Modality"]) == ("BLIP-2", "Yes", "VLM (multimodal)", "Yes", "report-generation", "X-Ray, CT")
    assert set(c.values()) == {"2", ""}


def test_windows_and_modes(spark):
    text = "encoder" + "." * 100 + " vit "
    assert records(spark, [text])[0]["Vision Enc"] == ""
    assert records(spark, [text], "hybrid")[0]["Vision Enc"] == "ViT"
    text = "chexpert; magnetic resonance; the findings"
    assert records(spark, [text])[0]["Modality"] == "X-Ray"
    hybrid = records(spark, [text], "hybrid")[0]
    assert (hybrid["Modality"], hybrid["Task"], hybrid["Datasets (train)"], hybrid["Datasets (eval)"]) == ("X-Ray, MRI", "report-generation", "CheXpert", "CheXpert")
    assert records(spark, ["a cnn backbone and a transformer decoder"])[0]["Class"] == "CNN+Transformer"


def test_words_end_at_letters_beyond_ascii(spark):
    """As in the query's SQL: "test" is a word in "testü", "vit" in "évit"."""
    a, b = records(spark, ["testü We train on MIMIC-CXR with reports", "Évit image, blipß tests"])
    assert (a["Datasets (train)"], a["Datasets (eval)"], a["Paired"]) == ("MIMIC-CXR", "MIMIC-CXR", "Yes")
    assert (b["Vision Enc"], b["Family"], b["Datasets (eval)"]) == ("ViT", "BLIP", "")


def test_anchors_that_overlap(spark):
    """The surroundings begin within one anchor and hold another that overlaps it."""
    text = lambda n: " the the " + "a" * n + " with x"
    df = spark.createDataFrame([(n, text(n)) for n in range(60, 80)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in windows.anchored(df, "doc_id", "text", {"which": " with "}, " the |version").collect()}
    assert got == {n: ["which"] if " the " in text(n)[max(0, n + 9 - 80) : n + 9 + 80] else [] for n in range(60, 80)}
    assert got[73] == ["which"] and got[79] == []


def test_records_are_made_within_rows(spark):
    """Whatever a text holds, nothing is moved, sorted or multiplied: the cost follows the texts' length."""
    df = spark.createDataFrame([(1, "a vit image encoder"), (2, None)], "doc_id long, text string")
    plan = extract(df)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Exchange", "Sort", "Window", "Generate", "Join") if x in plan], plan


def test_texts_full_of_cues(spark):
    """Long texts without any cue, of cues alone, and without words; each word counts once it is whole."""
    texts = ["us " * 20_000, "clip image " * 5_000, "a" * 300_000, ".\n" * 100_000 + "vit image", "bleu1x " * 5_000, "bleu" + "1" * 300, "llava" + " " * 300 + "med", "decoder llama-" + "1" * 300 + "b"]
    got = {int(r["File"]): {k: x for k, x in r.items() if x and k != "File"} for r in records(spark, texts)}
    want = [{"Modality": "Ultrasound"}, {"Vision Enc": "CLIP"}, {}, {"Vision Enc": "ViT"}, {}, {"Metrics(primary)": "BLEU"}, {"Model": "LLaVA", "Family": "LLaVA", "VLM?": "Yes", "Class": "VLM (multimodal)"}, {"Lang Dec": "LLaMA"}]
    assert got == dict(enumerate(want))


def test_letters_as_in_sql(spark):
    """As in the query's SQL: "ſ" stands for an s, but is of no word; the dotless and the dotted i aren't i's."""
    got = records(spark, ["reſnet 50 image", "aſpice", " ſpice", "vit ımage", "chest x-rayſa", "xrays; \x01vit; image\x01mri"])
    assert [(r["Vision Enc"], r["Metrics(primary)"], r["Modality"]) for r in got] == [("ResNet50", "", ""), ("", "SPICE", ""), ("", "", ""), ("", "", ""), ("", "", "X-Ray"), ("ViT", "", "MRI")]


def test_a_match_inside_another_is_none(spark):
    """The short name within the long one's match is no mention of its own, so what only its surroundings hold doesn't count."""
    a, b = records(spark, ["nih chestxray14" + " test" + "." * 58 + " train", "chestxray14" + " test" + "." * 58 + " train"])
    assert (a["Datasets (train)"], a["Datasets (eval)"], b["Datasets (train)"]) == ("", "NIH ChestX-ray14", "NIH ChestX-ray14")


def test_beginnings_of_patterns():
    assert literals.lead(r"\bCo[- ]attention\b") == ("co", r"[- ]attention\b") and literals.lead(r"\bcxr?\b") == ("cx", r"r?\b")
    assert literals.alternatives(r"a(b|c)[|]|\|d") == ["a(b|c)[|]", r"\|d"]
    assert literals.inside(r"\b(x[- ]?1|y x[- ]?1)\b") == [("y ", "x[- ]?1")] and literals.inside(r"\bx\b") == []
    assert literals.reach(r"\ba\b(?! with)") == 7
    with pytest.raises(ValueError):
        literals.lead("a|b")

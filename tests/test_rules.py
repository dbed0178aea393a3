"""Records whose cells were worked out by hand from the rules of the tables' first cleaner, not from the library's lists."""

from loomstead.operators import normalize

COLUMNS = "key title model family vision language fusion objectives vlm rag metrics train eval_ klass".split()
GIVEN = {
    "otter": dict(family="Otter"),
    "kosmos": dict(model="Kosmos-1", fusion="late fusion"),
    "pali-x": dict(model="my PaLI-X net", language="GPT-2"),
    "ofa": dict(family="ofa", objectives="not reported"),
    "flag": dict(vlm="yes"),
    "vision": dict(vision="vit b; swin", train="MIMIC"),
    "text": dict(language="llama 2", eval_="E"),
    "none": dict(title="nothing"),
    "denied": dict(title="no learned retrieval, a retriever", model="GPT-2"),
    "no": dict(title="bm25 over reports", rag="no"),
    "said": dict(rag="dense retrieval"),
    "only cell": dict(rag="a reranker"),
    "knowledge": dict(model="LLaVA", title="with a knowledge base"),
}
# model, family, class, fusion, objectives, rag, train, eval_
EXPECTED = {
    "otter": ("Otter", "Otter", "VLM", "cross-attention", "contrastive", "", "", ""),
    "kosmos": ("Kosmos-1", "Kosmos-1", "VLM", "late fusion", "contrastive, ITM", "", "", ""),
    "pali-x": ("PaLI-X", "PaLI-X", "VLM", "cross-attention", "contrastive, ITM", "", "", ""),
    "ofa": ("OFA", "OFA", "VLM", "cross-attention", "ITM", "", "", ""),
    "flag": ("", "", "VLM", "cross-attention", "contrastive, ITM", "", "", ""),
    "vision": ("ViT, Swin", "", "Vision-only", "", "", "", "MIMIC", "MIMIC"),
    "text": ("LLaMA-2", "", "Text-only", "Not applicable", "Not applicable", "", "E", "E"),
    "none": ("", "", "", "Not applicable", "Not applicable", "", "", ""),
    "denied": ("GPT-2", "", "", "Not applicable", "Not applicable", "", "", ""),
    "no": ("", "", "", "Not applicable", "Not applicable", "Yes", "", ""),
    "said": ("", "", "", "Not applicable", "Not applicable", "Yes", "", ""),
    "only cell": ("", "", "", "Not applicable", "Not applicable", "", "", ""),
    "knowledge": ("LLaVA", "LLaVA", "VLM", "cross-attention", "contrastive", "Yes", "", ""),
}


def given(spark, rows):
    return spark.createDataFrame([tuple(k if c == "key" else r.get(c, "") for c in COLUMNS) for k, r in rows.items()], ", ".join(f"{c} string" for c in COLUMNS))


def test_records_by_hand(spark):
    got = {r.key: (r.model, r.family, r.klass, r.fusion, r.objectives, r.rag, r.train, r.eval_) for r in normalize.clean(given(spark, GIVEN), "key").collect()}
    assert got == EXPECTED


def test_the_primary_model_alone(spark):
    rows = {"a": dict(model="Transformer, vicuna", family="blip; LLaVA"), "b": dict(model="LSTM + GRU"), "c": dict(model="Transformer", vision="clip, vit"), "d": {}, "e": dict(model="GPT-2; albef")}
    got = {r.key: r.model for r in normalize.clean(given(spark, rows), "key", primary_only=True).collect()}
    assert got == {"a": "LLaVA", "b": "LSTM", "c": "CLIP", "d": "", "e": "ALBEF"}

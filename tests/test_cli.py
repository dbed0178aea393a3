"""Whole runs from files to files."""

import pytest

from loomstead import cli

GOLD = "File,Model,Fusion,RAG,Vision Enc,Family\na.txt,BLIP-2,cross-attention,Yes,ViT,\nb.txt,,late fusion,,CNN,\n"
PRED = "File,Model,Fusion,RAG,Vision Enc,Family\na.txt,blip2 net,co-attention,No,ViT,\nb.txt,x,Not reported,,CNN + ViT,\nb.txt,albef,,Yes,,ALBEF\n"


def rows(spark, path):
    return sorted(tuple(r) for r in spark.read.option("header", True).csv(path).fillna("").collect())


def test_commands(spark, tmp_path):
    for name, text in {"g.csv": GOLD, "p.csv": PRED, "m.csv": "File,Model,Fusion,RAG,Vision Enc,Family\nA,1,1.0,1,0,0\nB,1,1,1,1,0\n"}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("The image encoder is a ViT; the language decoder a LLaMA. BLIP-2, BLEU.")
    g, p, m = (str(tmp_path / x) for x in ("g.csv", "p.csv", "m.csv"))
    out = lambda x: str(tmp_path / "out" / x)
    run = lambda *args: cli.main(args, spark)
    run("extract", "--texts", str(tmp_path / "t"), "--out", out("e"))
    assert rows(spark, out("e"))[0][:2] == ("a", "")
    run("clean", "--table", p, "--mask", m, "--best", "--out", out("c"))
    cleaned = spark.read.option("header", True).csv(out("c")).fillna("")
    assert {r.File: r.Model for r in cleaned.collect()} == {"a.txt": "BLIP-2", "b.txt": "ALBEF"}
    run("evaluate", "--gold", g, "--pred", p, "--tokens", "--fields", "Model", "Fusion", "--out", out("v"))
    assert {r[0] for r in rows(spark, out("v") + "/summary")} == {"Model", "Fusion"}
    assert rows(spark, out("v") + "/mismatches/Model")[0][:2] == ("a.txt", "Model")
    run("gold", "--gold", g, "--pred", p, "--out", out("s"))
    assert "__MICRO__" in {r[0] for r in rows(spark, out("s"))}
    run("coverage", "--table", p, "--out", out("k"))
    assert {r[0]: r[2] for r in rows(spark, out("k") + "/columns")}["Vision Enc"] == "2"
    run("compare", "--base", g, "--target", p, "--out", out("d"))
    assert {r[0]: r[1:] for r in rows(spark, out("d") + "/figures")}["rows"] == ("2.0", "3.0")
    for how in ("mask", "all", "list"):
        run("availability", "--base", g, "--target", p, "--mask", m, "--apply", how, "--listed", "Family", "--out", out("a" + how))
        assert len(rows(spark, out("a" + how))) == 5
    run("misses", "--mask", m, "--pred", p, "--out", out("m"))
    assert ("b", "Fusion") in rows(spark, out("m"))
    run("fuse", "--tables", g, p, "--out", out("f"))
    fused = {r.key: r for r in spark.read.option("header", True).csv(out("f")).fillna("").collect()}
    assert fused["a.txt"]["Model"] == "BLIP-2" and fused["b.txt"]["Vision Enc"] == "CNN, CNN + ViT"
    with pytest.raises(SystemExit):
        run("evaluate", "--gold", g)

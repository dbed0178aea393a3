"""Sentence pieces against the library itself."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from loomstead.llm import pieces, queries


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.default_path())


def same(model, library, texts):
    ids, starts = model.encode(texts)
    want = library.encode([t or "" for t in texts])
    assert [ids[starts[i] : starts[i + 1]].tolist() for i in range(len(texts))] == want
    assert model.decode(ids, starts) == library.decode(want)


def test_texts_made_to_tie_and_overlap(model, library):
    rng = random.Random(4)
    letters = "aaabbcde▁  \n\t0123.,é中文𝒳\u0000ß🙂<s>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 200))) for _ in range(1000)]
    texts += ["", None, "<s>", "</s>", "<unk>", "<0x41>", " ", "   ", "a  b ", SPACES, "a" * 500, "ab" * 300, "=" * 77 + "-" * 33, "in" * 99 + "g", "﻿"]
    same(model, library, texts)


SPACES = "▁▁ ▁x"


def test_long_texts_with_and_without_words(model, library):
    rng = random.Random(5)
    same(model, library, ["".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(30_000)), " ".join(f"w{rng.random()}" for _ in range(30_000))])


def test_words_are_forgotten(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    for i in range(5):
        same(model, library, [f"word {i} {j} other" * 3 for j in range(20)])


def test_decoding_any_ids(model, library):
    rng = random.Random(6)
    pool = [0, 1, 2, *range(3, 259), *range(259, 32000, 97)]
    rows = [[rng.choice(pool) for _ in range(rng.randint(0, 12))] for _ in range(5000)]
    rows += [[rng.choice([0, 35, 1, 259, 29871, 227, 131, 3, 200]) for _ in range(6)] for _ in range(5000)]
    assert model.decode(np.array([x for r in rows for x in r]), pieces._upto(np.array([len(r) for r in rows]))) == library.decode(rows)


def test_query(spark, data, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.QUERIES["op11_sentence_pieces"](spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_rows_and_columns(spark, library):
    docs = spark.createDataFrame([("a", "two words", 1, "x"), ("a", "two words", 2, "y"), (None, None, 3, None), ("c", "", 4, "z")], "doc_id string, text string, ids int, decoded string")
    coded = pieces.encode_documents(docs)
    want = library.encode("two words")
    assert sorted((r.doc_id or "", r.ids) for r in coded.collect()) == [("", []), ("a", want), ("a", want), ("c", [])]
    back = pieces.decode_documents(coded.unionByName(spark.createDataFrame([("n", None)], "doc_id string, ids array<int>")))
    assert sorted((r.doc_id or "", r.decoded) for r in back.collect()) == [("", ""), ("a", "two words"), ("a", "two words"), ("c", ""), ("n", "")]
    assert pieces.encode_documents(docs.limit(0), decoded=True).collect() == []


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(pieces.default_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Pieces(str(tmp_path / "m"))

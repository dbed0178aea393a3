"""Tokens against the library, packing against plain best-fit decreasing, and the query's contract."""

import random
import zlib

import numpy as np
import pytest

from loomstead.llm import packing, tokens
from loomstead.llm.common import Workspace


def test_ids_are_the_librarys(spark, data):
    e = tokens.Encoder(tokens.default_path())
    odd = ["", " ", "a ", " a", "a  b\n c", "\n", "x <|endoftext|> y", "a\u00a0b", "\0", "it's 12 é 𝄞!!", "<|endoftext"]
    for t in odd + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]:
        assert e.encode(t).tolist() == e._tokenizer.encode(t, add_special_tokens=False).ids


def best_fit(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(size - n)
    return sorted(rooms)


@pytest.mark.parametrize("size", [1, 8, 50, 64])
def test_plan_is_best_fit_decreasing(size):
    rng = random.Random(size)
    for _ in range(60):
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 150))]
        runs, windows = packing.plan({n: lengths.count(n) for n in lengths}, size)
        fill = [0] * windows
        for length, _, rests, each, first, offset in runs:
            for j in range(rests):
                assert fill[first + j // each] == offset + j % each * length  # gapless
                fill[first + j // each] += length
        assert sorted(size - f for f in fill) == best_fit(lengths, size)


def test_pack_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").repartition(5)
    more = [(1, "again", "x"), (None, None, None), (-1, "", "x"), (-2, "word " * 9000, "x")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    out = packing.pack_documents(docs, Workspace(spark, "t"), tokens.default_path()).collect()
    e = tokens.Encoder(tokens.default_path())
    texts = {r.doc_id: r.text or "" for r in docs.where("text is null or text <> 'again'").collect()}
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc, rows in by_doc.items():
        rows = [r for r in rows if r.doc_tokens > 2] if doc == 1 else rows
        ids = np.append(e.whole(texts[doc]), 0).astype("<u4")
        assert sum(r.length for r in rows) == len(ids) == rows[0].doc_tokens
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    used = sum(r.length for r in out)
    assert used / (1024 * len(by_seq)) > 0.97
    assert packing.pack_documents(docs.limit(0), Workspace(spark, "t"), tokens.default_path()).count() == 0

"""The permutation, and shards read back by offset."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from loomstead.llm import order, tokens
from loomstead.llm.common import Workspace


def test_permutation():
    for n in (1, 2, 3, 5, 17, 64, 1000, 4097):
        p = order.Permutation(n, 7)
        slots = p.slot_of(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n))
        assert p.sequence_of(slots).tolist() == list(range(n))
    a, b = order.Permutation(1000, 1).slot_of(np.arange(1000)), order.Permutation(1000, 2).slot_of(np.arange(1000))
    assert (a != b).sum() > 900 and (a != np.arange(1000)).sum() > 900
    assert abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.15


def test_shards(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").repartition(3, "doc_id")
    docs = docs.unionByName(spark.createDataFrame([(None, None, "x"), (1, "again", "x")], "doc_id long, text string, lang string"))
    docs = Workspace(spark, "t").save(docs, "docs")
    length, per = 128, 50
    path, slots, width = order.materialise(docs, Workspace(spark, "t"), tokens.default_path(), length=length, per_shard=per, docs_in_part=50)
    rows = slots.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    read = {r.slot: r for r in order.read_shards(spark, path, length, width, per).collect()}
    assert len(read) == len(rows)
    raw = {int(f.path.split("shard=")[1].split("/")[0]): bytes(f.content) for f in spark.read.format("binaryFile").load(path).collect()}
    e = tokens.Encoder(tokens.default_path())
    spent = {}
    for r in docs.collect():
        spent.setdefault(r.doc_id, []).append(np.append(e.whole(r.text or ""), 0))
    total = sum(len(x) for v in spent.values() for x in v)
    assert sum(r.n_ids for r in rows) == total
    streams = {}
    for r in rows:
        shard, at = order.place_of(r.slot, length, width, per)
        ids = np.frombuffer(raw[shard][at : at + length * width], "<u2")
        assert zlib.crc32(ids.tobytes()) == read[r.slot].ids_crc32 and read[r.slot].byte_offset == at
        assert (ids[r.n_ids :] == 0).all() and len(r.doc_ids) > 0
        streams[r.sequence] = ids[: r.n_ids].tolist()
    flat = [x for s in sorted(streams) for x in streams[s]]
    text = ",".join(map(str, flat)) + ","
    for v in spent.values():
        for x in v:
            assert ",".join(map(str, x.tolist())) in text
    # however the table is split, the order is the same
    columns = ["slot", "shard", "byte_offset", "ids_crc32", "sequence", "n_ids", "doc_ids"]
    every = []
    for n in (1, 7):
        split = Workspace(spark, "t").save(docs.repartition(n, "lang", "text").withColumn("part", F.lit("clash")).withColumn("number", F.lit(1)), "docs")
        out = order.ordered(split, Workspace(spark, "t"), tokens.default_path(), length=length, per_shard=per, docs_in_part=50)
        every.append(sorted(map(repr, out.select(columns).collect())))
    assert every[0] == every[1] and len(every[0]) == len(rows)
    named = spark.createDataFrame([("a", "one two"), ("b", None)], "doc_id string, text string")
    assert [r.doc_ids for r in order.ordered(named, Workspace(spark, "t"), tokens.default_path()).collect()] in ([["a", "b"]], [["b", "a"]])
    assert order.ordered(docs.limit(0), Workspace(spark, "t"), tokens.default_path()).count() == 0

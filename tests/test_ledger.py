"""Batches that count once."""

import threading

import pytest
from pyspark.sql import functions as F

from loomstead.sources import ledger
from loomstead.streaming import ingest_once


def batch(spark, keys, value="a"):
    return spark.createDataFrame([(k, f"{value}{i}") for i, k in enumerate(keys)], "id long, v string")


def ids(spark, path):
    return sorted((r.id is not None, r.id) for r in ledger.read(spark, path).collect())


def test_repeated_batches_and_keys(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    assert ledger.append(batch(spark, [1, 2, 2, None, None]), at, "one", "id") == 3
    assert ledger.append(batch(spark, [1, 2, 2, None, None]), at, "one", "id") == 3  # the same batch again
    assert ids(spark, at) == [(False, None), (True, 1), (True, 2)]
    assert {r.id: r.v for r in ledger.read(spark, at).collect()}[2] == "a1"  # the first of a key
    assert ledger.append(batch(spark, [2, 3, None], "b"), at, "two", "id") == 1
    assert ledger.append(batch(spark, []), at, "three", "id") == 0
    assert ids(spark, at) == [(False, None), (True, 1), (True, 2), (True, 3)] and len(ledger.entries(spark, at)) == 3
    with pytest.raises(ValueError):
        ledger.read(spark, f"file://{tmp_path}/none")


def test_a_batch_that_is_cut_off(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    ledger.append(batch(spark, [1]), at, "one", "id")

    def killed():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        ledger.append(batch(spark, [2, 3]), at, "two", "id", before_entry=killed)
    assert ids(spark, at) == [(True, 1)]
    assert ledger.append(batch(spark, [2, 3]), at, "two", "id") == 2
    assert ids(spark, at) == [(True, 1), (True, 2), (True, 3)]


def test_another_writer_comes_first(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    other = iter([lambda: ledger.append(batch(spark, [2, 3], "other"), at, "other", "id"), lambda: None])
    assert ledger.append(batch(spark, [1, 2]), at, "own", "id", before_entry=lambda: next(other)()) == 1
    assert {r.id: r.v for r in ledger.read(spark, at).collect()} == {1: "a0", 2: "other0", 3: "other1"}


def test_writers_at_once(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    gate = threading.Barrier(3)
    wait = {i: iter([gate.wait, *[lambda: None] * 9]) for i in range(3)}  # all write before any claims
    run = lambda i: ledger.append(batch(spark, [1, 2, 10 + i], f"w{i}"), at, f"w{i}", "id", before_entry=lambda: next(wait[i])())
    threads = [threading.Thread(target=run, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert ids(spark, at) == [(True, i) for i in (1, 2, 10, 11, 12)]
    assert [e["rows"] for e in ledger.entries(spark, at)] == [3, 1, 1]


def test_a_stream_that_repeats_a_batch(spark, tmp_path):
    src, at = (f"file://{tmp_path}/{x}" for x in ("in", "t"))
    first = batch(spark, [1, 2, 3])
    first.write.mode("append").parquet(src)
    ingest_once(spark, src, at, f"file://{tmp_path}/c1", first.schema, lambda d: d.where("id < 3"), "id", "s")
    ingest_once(spark, src, at, f"file://{tmp_path}/c2", first.schema, lambda d: d.where("id < 3"), "id", "s")  # a lost checkpoint: the batch comes again
    assert ids(spark, at) == [(True, 1), (True, 2)]
    batch(spark, [2, 7]).write.mode("append").parquet(src)
    ingest_once(spark, src, at, f"file://{tmp_path}/c1", first.schema, lambda d: d.withColumn("v", F.upper("v")), "id", "s")
    assert ids(spark, at) == [(True, 1), (True, 2), (True, 7)]

"""Training-order materialisation: token sequences in a keyed random order, in fixed-stride files.

Documents are tokenised and dealt by a hash of their ids into parts of about
``docs_in_part`` documents. Within a part they are put in order by that hash (and by
their content where ids repeat), joined and cut into sequences
of ``length`` ids (the last one padded with the end id). So the sequences depend
on the documents alone, not on how a table is split into files or partitions.
They are numbered part after part, and a keyed Feistel permutation of [0, N) gives each its
global slot: a balanced network over the next even number of bits, walked on
along its cycle while it leads outside of [0, N). The permutation is its own
index: ``slot_of`` and ``sequence_of`` need the key and N alone.

Shard k holds the slots from k * ``per_shard`` on, in order, each as ``length``
little-endian numbers of 2 (or 4) bytes and a line feed. So a slot's place is
known without an index (``place_of``), a reader streams a shard from any slot
on, and a run that was stopped goes on from the slot it had reached. Shards are
written through Spark's own committer, so a lost executor's shards are written
again and never twice.

Documents are moved once into their parts, and sequences once into their shards,
those of one task and shard together and compressed.

Defined cases: a null text is empty and gives its end id alone; null and
repeated ids are kept, each row being a document of its own, ids of any type as
they are; an empty table gives no shard; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Workspace, text_of
from .tokens import Encoder

LENGTH, END_ID, PER_SHARD, ROUNDS = 2048, 0, 4096, 6


class Permutation:
    """A keyed permutation of [0, n)."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        mix = np.random.Generator(np.random.Philox(key)).integers(0, 2**63, ROUNDS)
        self.keys = [np.uint64(k) for k in mix]

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) & self.mask

    def _once(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ self._round(right, k)
        return (right << np.uint64(self.half)) | left  # halves swapped back, so the reverse is the same walk with reversed keys

    def _walk(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        x = self._once(np.asarray(x).astype(np.uint64), keys)
        while (out := x >= self.n).any():
            x[out] = self._once(x[out], keys)
        return x.astype(np.int64)

    def slot_of(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, self.keys)

    def sequence_of(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


def place_of(slot: int, length: int = LENGTH, width: int = 2, per_shard: int = PER_SHARD) -> tuple[int, int]:
    """Shard and byte offset of a slot."""
    return slot // per_shard, slot % per_shard * (length * width + 1)


def tokenised(docs: DataFrame, tokenizer: str, width: int, end_id: int, doc_id: str, text: str, parts: int) -> DataFrame:
    """part, h, crc, doc_id and ids (with the end id) of every row."""
    own = docs.select(F.xxhash64(F.col(doc_id)).alias("h"), F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    own = own.select(F.pmod("h", F.lit(parts)).cast("int").alias("part"), "h", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        end = np.array([end_id], f"<u{width}").tobytes()
        for batch in batches:
            ids = [encoder.encode(t.as_py()).astype(f"<u{width}").tobytes() + end for t in batch.column(3)]
            columns = [batch.column(0), batch.column(1), pa.array(map(zlib.crc32, ids), pa.int64()), batch.column(2), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "h", "crc", "doc_id", "ids"])

    return own.mapInArrow(run, f"part int, h long, crc long, doc_id {own.schema['doc_id'].dataType.simpleString()}, ids binary")


def sequences(docs: DataFrame, tokenizer: str, width: int, length: int, end_id: int, doc_id: str, text: str, docs_in_part: int = 8_000) -> DataFrame:
    """part, number (within it), n_ids (without padding), doc_ids (whose ids are in it) and ids."""
    parts = max(1, docs.count() // docs_in_part)
    made = tokenised(docs, tokenizer, width, end_id, doc_id, text, parts)
    kind = made.schema["doc_id"].dataType
    id_type, names = to_arrow_type(kind), ["part", "number", "n_ids", "doc_ids", "ids"]
    placed = made.repartitionById(parts, "part").sortWithinPartitions("part", "h", "crc", "doc_id").select("part", "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, part, number, have = length * width, None, 0, 0
        waiting: list[bytes] = []
        docs_in: list[tuple[int, object]] = []  # where each waiting document begins, in bytes

        def cut(last: bool) -> pa.RecordBatch:
            nonlocal number, have, waiting, docs_in
            raw = b"".join(waiting)
            n = len(raw) // step + (last and len(raw) % step > 0)
            begins = np.array([b for b, _ in docs_in], np.int64)
            edges = np.arange(n + 1) * step
            upto = np.searchsorted(begins, edges[1:])
            since = np.maximum(0, np.searchsorted(begins, edges[:-1], "right") - 1)
            ids = [raw[i * step : (i + 1) * step] for i in range(n)]
            sizes = [len(x) // width for x in ids]
            if n and sizes[-1] < length:
                ids[-1] += np.full(length - sizes[-1], end_id, f"<u{width}").tobytes()
            of = [[docs_in[j][1] for j in range(a, b)] for a, b in zip(since.tolist(), upto.tolist(), strict=True)]
            columns = [pa.array([part] * n, pa.int32()), pa.array(range(number, number + n), pa.int64()), pa.array(sizes, pa.int32()), pa.array(of, pa.list_(id_type)), pa.array(ids, pa.binary())]
            number += n
            used = min(len(raw), n * step)
            left = int(np.searchsorted(begins, used, "right")) - 1
            docs_in = [(max(0, b - used), d) for b, d in docs_in[max(0, left) :]] if used < len(raw) else []
            waiting, have = [raw[used:]] if used < len(raw) else [], len(raw) - used
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for p, d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if p != part:
                    if have:
                        yield cut(True)
                    part, number = p, 0
                docs_in.append((have, d))
                waiting.append(ids.as_py())
                have += len(waiting[-1])
                if have >= 1000 * step:
                    yield cut(False)
        if have:
            yield cut(True)

    return placed.mapInArrow(run, f"part int, number long, n_ids int, doc_ids array<{kind.simpleString()}>, ids binary")


def materialise(
    docs: DataFrame, work: Workspace, tokenizer: str, key: int = 20_240_229, length: int = LENGTH, per_shard: int = PER_SHARD, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", docs_in_part: int = 8_000
) -> tuple[str, DataFrame, int]:
    """Write the shards. Returns their folder, a table of sequence, slot, n_ids and doc_ids, and the width of a number."""
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    made = work.save(sequences(docs, tokenizer, width, length, end_id, doc_id, text, docs_in_part), "sequences")
    counts = made.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    firsts = counts.select("part", "n", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))  # a row for each part
    firsts = work.save(firsts, "firsts")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    permutation = Permutation(total, key)
    numbered = made.join(firsts.select("part", "first"), "part").withColumn("sequence", F.col("first") + F.col("number"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permutation.slot_of(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slot), batch.column(1), batch.column(2)], ["sequence", "slot", "n_ids", "doc_ids"])

    slots = numbered.select("sequence", "n_ids", "doc_ids").mapInArrow(number, f"sequence long, slot long, n_ids int, doc_ids {made.schema['doc_ids'].dataType.simpleString()}")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sequences of a batch by shard, compressed together."""
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            slot = permutation.slot_of(batch.column(0).to_numpy())
            order = np.argsort(slot)
            shard = slot[order] // per_shard
            cut = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(order)]))
            rows = [(int(shard[a]), order[a:b]) for a, b in zip(cut, cut[1:], strict=False) if b > a]
            ids = batch.column(1)
            blobs = [press.compress(b"".join(ids[int(i)].as_py() for i in part)) for _, part in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in rows], pa.int32()), pa.array([slot[part].tobytes() for _, part in rows], pa.binary()), pa.array(blobs, pa.binary())], ["shard", "slots", "blob"]
            )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand, step = zstandard.ZstdDecompressor(), length * width
        for batch in batches:
            for s, slot, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                slots_, raw = np.frombuffer(slot, np.int64), expand.decompress(blob)
                ids = [raw[i * step : (i + 1) * step] for i in range(len(slots_))]
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(ids), pa.int32()), pa.array(slots_), pa.array(ids, pa.binary())], ["shard", "slot", "ids"])

    if total:
        shards = -(-total // per_shard)
        moved = numbered.select("sequence", "ids").mapInArrow(gather, "shard int, slots binary, blob binary").repartitionById(shards, "shard")
        rows = moved.mapInArrow(spread, "shard int, slot long, ids binary").sortWithinPartitions("shard", "slot")
        rows.select("shard", F.col("ids").cast("string").alias("value")).write.partitionBy("shard").option("compression", "none").text(work.path("shards"))
    return work.path("shards"), slots, width


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, width: int = 2, per_shard: int = PER_SHARD) -> DataFrame:
    """slot, shard, byte_offset and ids_crc32 of everything in the shards."""
    size, stride = length * width, length * width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = memoryview(content.as_buffer())
                at = list(range(0, len(raw), stride))
                slots = [shard * per_shard + i for i in range(len(at))]
                crc = [zlib.crc32(raw[i : i + size]) for i in at]
                columns = [pa.array(slots, pa.int64()), pa.array([shard] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["slot", "shard", "byte_offset", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).select(F.col("shard").cast("long").alias("shard"), "content")
    return files.mapInArrow(run, "slot long, shard long, byte_offset long, ids_crc32 long")


def ordered(docs: DataFrame, work: Workspace, tokenizer: str, length: int = LENGTH, per_shard: int = PER_SHARD, **more) -> DataFrame:
    """Write the shards, read them back, and say what each slot holds."""
    path, slots, width = materialise(docs, work, tokenizer, length=length, per_shard=per_shard, **more)
    slots = work.save(slots, "slots")
    work.drop("sequences")
    if slots.isEmpty():
        return slots.selectExpr("slot", "cast(0 as long) shard", "cast(0 as long) byte_offset", "cast(0 as long) ids_crc32", "sequence", "n_ids", "doc_ids")
    return read_shards(docs.sparkSession, path, length, width, per_shard).join(slots, "slot")

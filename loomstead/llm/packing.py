"""Packing documents into token sequences by best-fit decreasing.

``tokenise`` cuts every document (its ids, then an end id) into full windows and
one rest. Rests are packed best-fit decreasing over the whole table: longest
first, each into the open window with the least room that still holds it, found
in a segment tree indexed by remaining room.

Best-fit decreasing sees lengths alone, and a window has only ``size`` possible
lengths. So the driver packs the histogram of the lengths (``size`` numbers
whatever the input) and gets runs: "rests number a to b of length l go q to a
window into the windows from w on, starting at offset o". Rests of one length
are numbered across the table by counts per partition, and each finds its run by
bisection. Texts and ids don't move; a piece's few numbers move once, to the count of its
length and partition. Nothing that grows with the table is collected.

A window that ends up filled to a power of two needs no padding; all others are
padded to ``size``.

Defined cases: a null text is empty and gives its end id alone; null and
repeated ids are kept, each row being a document of its own, ids of any type as they
are; an empty table gives no pieces; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Workspace, text_of
from .tokens import Encoder

SIZE, END_ID = 1024, 0

PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, part int, number long"


def tokenise(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents; number counts pieces of one length within a partition."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.encode(x.as_py()), np.uint32(end_id)).astype("<u4")
                raw = memoryview(ids.tobytes())
                for at in range(0, len(ids), size):
                    n = min(size, len(ids) - at)
                    rows.append((doc, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), len(ids), part, int(seen[n])))
                    seen[n] += 1
            types = [id_type] + [pa.int64()] * 4 + [pa.int32(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * 7
            names = [c.split()[0] for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    own = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    kind = own.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    return own.mapInArrow(pieces, PIECES.format(id=kind.simpleString()))


class RoomTree:
    """A segment tree over remaining room: which rooms have open windows."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.some = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.some[i] += n
            i //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that has an open window."""
        i = least + self.leaves
        if self.some[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over lengths: runs (length, first number, rests, rests to a window, first window, offset), and the number of windows."""
    tree = RoomTree(size)
    open_: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    runs, windows = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            open_[room].append((first, n))
            tree.add(room, n)

    for length in sorted(histogram, reverse=True):
        left, number = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                # a new window takes rests of this length while they fit, so all that are left open at once
                room, first, n = size, windows, -(-left // (size // length))
                windows += n
            else:
                first, n = open_[room].pop()
                tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, number, full * each, each, first, size - room))
                leave(room - each * length, first, full)
                number, left = number + full * each, left - full * each
            first, n = first + full, n - full
            if n and left:  # fewer rests than fill one more window: n > 0 here only if left < each
                runs.append((length, number, left, each, first, size - room))
                leave(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            leave(room, first, n)
    return runs, windows


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` with sequence_id and offset. They are read twice: give a written table."""
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("first"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n"))
    histogram = {r["length"]: r["n"] for r in totals.collect()}  # at most ``size`` numbers
    runs, _ = plan(histogram, size)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # runs in order of length and first number; a piece's run is the last one that begins no later
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    begins = np.searchsorted(table[:, 0], np.arange(size + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, n = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            run = np.zeros(len(n), np.int64)
            for x in np.unique(length):
                own = length == x
                run[own] = begins[x] + np.searchsorted(table[begins[x] : begins[x + 1], 1], n[own], "right") - 1
            _, number, _, each, window, offset = table[run].T
            columns = [batch.column(i) for i in range(5)] + [pa.array(window + (n - number) // each), pa.array(offset + (n - number) % each * length)]
            yield pa.RecordBatch.from_arrays(columns, names)

    numbered = pieces.join(first, ["length", "part"]).select(*names[:5], (F.col("number") + F.col("first")).alias("number"))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(place, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))


def pack_documents(docs: DataFrame, work: Workspace, tokenizer: str, size: int = SIZE) -> DataFrame:
    """Tokenise once, write the pieces (a few numbers each), and pack them."""
    return pack(work.save(tokenise(docs, tokenizer, size), "pieces"), size)

"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents within a partition, of about ``shard_words``
words. Of its words only those can be part of a match that occur in the
benchmark, and only where at least as many of them follow each other as the
shortest phrase has; these stretches, parted by a separator, are the indexed
string. Its Burrows-Wheeler transform is kept in a wavelet matrix. All phrases
of a benchmark block are searched backwards at once, their occurrences located
by sampled suffix positions and joined to word ranges and to removal spans in
the text.

The benchmark is the side whose size is checked: it is cut into blocks of about
``block_words`` words, and all documents are held against each block. The driver
holds a block and the next one, no more: what one block found is written, and read again with
the next. A benchmark of one block writes nothing. No row is shuffled.

A phrase is ``window`` consecutive words of an item; an item of fewer words, but
not none, is one phrase. Words are runs of ASCII letters and digits and of all
characters beyond ASCII, A-Z in lower case.

Defined cases: null texts have no words; documents without words are kept and
not contaminated; null and repeated document ids are kept row by row, ids of any
type as they are; items without an id or words are left out, items with one id
count as one; an empty benchmark hits nothing; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Workspace, text_of

WINDOW, SHARE = 13, 20
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

RANGES = "array<struct<start:int,end:int>>"


def words_of(text: str) -> list[bytes]:
    """The words of a text as bytes."""
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; a suffix that ends first is the smaller."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank = rank.astype(np.int64)
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        sa = np.argsort(key, kind="stable")
        ordered = key[sa]
        new = np.empty(n, np.int64)
        new[sa] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = new
        if k >= n or rank[sa[-1]] == n - 1:
            return sa
        k *= 2


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)])
        self.words = packed.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each i."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Rank and access of symbols, for arrays of queries at once."""

    def __init__(self, s: np.ndarray):
        self.levels: list[tuple[Bits, int]] = []
        self.depth = max(1, int(s.max(initial=0)).bit_length())
        for level in reversed(range(self.depth)):
            bit = (s >> level) & 1 == 1
            self.levels.append((Bits(bit), int(len(s) - bit.sum())))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol c before position i."""
        lo = np.zeros_like(i)
        for level, (bits, zeros) in enumerate(self.levels):
            one = (c >> (self.depth - 1 - level)) & 1 == 1
            r, q = bits.rank(i), bits.rank(lo)
            i, lo = np.where(one, zeros + r, i - r), np.where(one, zeros + q, lo - q)
        return i - lo

    def get(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for bits, zeros in self.levels:
            one = bits.get(i).astype(np.int64)
            r = bits.rank(i)
            c, i = 2 * c + one, np.where(one == 1, zeros + r, i - r)
        return c


class FMIndex:
    """Backward search and location over a string of small numbers."""

    def __init__(self, s: np.ndarray, rate: int = 16):
        s = np.append(s + 1, 0)  # an end that is smaller than every symbol
        sa = suffix_array(s)
        self.n = len(s)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s))))
        self.tree = WaveletMatrix(s[sa - 1])
        kept = sa % rate == 0
        self.kept, self.samples = Bits(kept), sa[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases of one length; a row for each phrase."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for j in reversed(range(phrases.shape[1])):
            c = phrases[alive, j] + 1
            known = c < len(self.first) - 1
            hi[alive[~known]] = lo[alive[~known]] = 0
            alive, c = alive[known], c[known]
            lo[alive] = self.first[c] + self.tree.rank(c, lo[alive])
            hi[alive] = self.first[c] + self.tree.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: walk back to the next sampled position."""
        rows = rows.copy()
        out, steps, left = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(left):
            at = rows[left]
            done = self.kept.get(at) == 1
            out[left[done]] = self.samples[self.kept.rank(at[done])] + steps
            left, at = left[~done], at[~done]
            c = self.tree.get(at)
            rows[left] = self.first[c] + self.tree.rank(c, at)
            steps += 1
        return out


class Block:
    """The phrases of some benchmark items."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        of: dict[tuple[int, ...], set[int]] = {}
        for item, words in items:
            ids = [number(w, len(self.vocabulary) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1)):
                of.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[set[int]]]] = {}
        for n in sorted({len(p) for p in of}):
            own = [p for p in of if len(p) == n]
            self.by_length[n] = np.array(own, np.int64), [of[p] for p in own]

    def find(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[int]]]:
        """For each document of a shard: merged ranges of words inside occurrences, and the items they belong to."""
        found: list[tuple[list[tuple[int, int]], set[int]]] = [([], set()) for _ in texts]
        if not self.by_length:
            return found
        shortest = min(self.by_length)
        lengths = np.array([len(w) for w in texts], np.int64)
        ids = np.concatenate([np.fromiter(map(self.vocabulary.get, w, repeat(0)), np.int64, len(w)) for w in texts] or [np.zeros(0, np.int64)])
        doc = np.repeat(np.arange(len(texts)), lengths)
        word = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        # stretches of known words, each within a document
        known = ids > 0
        begins = known & np.concatenate(([True], (~known[:-1]) | (doc[1:] != doc[:-1])))[: len(ids)]
        stretch = np.cumsum(begins) - 1
        kept = known & (np.bincount(stretch[known], minlength=len(ids) + 1)[np.maximum(stretch, 0)] >= shortest)
        at = np.flatnonzero(kept)
        if not len(at):
            return found
        own = stretch[at]
        # a separator after each stretch
        place = np.arange(len(at)) + np.concatenate(([0], np.cumsum(own[1:] != own[:-1])))
        s = np.zeros(place[-1] + 1, np.int64)
        s[place] = ids[at]
        back = np.full(len(s), -1, np.int64)
        back[place] = at
        index = FMIndex(s)
        marks = np.zeros(len(s) + 1, np.int64)
        for n, (phrases, items) in self.by_length.items():
            lo, hi = index.search(phrases)
            many = hi - lo
            which = np.repeat(np.arange(len(phrases)), many)
            if not len(which):
                continue
            start = np.cumsum(many) - many
            pos = index.locate(np.arange(len(which)) - np.repeat(start, many) + np.repeat(lo, many))
            np.add.at(marks, pos, 1)
            np.add.at(marks, pos + n, -1)
            for d, p in np.unique(np.stack([doc[back[pos]], which]), axis=1).T.tolist():
                found[d][1].update(items[p])
        hit = back[np.flatnonzero(np.cumsum(marks[:-1]) > 0)]
        if len(hit):
            cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(doc[hit]) != 0)) + 1
            for a, b in zip([0, *cut], [*cut, len(hit)], strict=True):
                found[doc[hit[a]]][0].append((int(word[hit[a]]), int(word[hit[b - 1]]) + 1))
        return found


def _spans(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """The ranges of words as code points of the text."""
    raw = text.encode("utf-8", "replace")
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [{"start": int(chars[at[a][0]]) - 1, "end": int(chars[at[b - 1][1] - 1])} for a, b in ranges]


def _join(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges merged where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1] = out[-1][0], max(y, out[-1][1])
        else:
            out.append((x, y))
    return out


def blocks(benchmark: DataFrame, window: int, block_words: int, item_id: str, text: str) -> Iterator[Block]:
    """The benchmark in blocks, a partition of it at a time on the driver."""
    items: list[tuple[int, list[bytes]]] = []
    n = 0
    for r in benchmark.select(F.col(item_id).alias("i"), text_of(text).alias("t")).where("i is not null").toLocalIterator():
        if words := words_of(r["t"]):
            items.append((r["i"], words))
            n += len(words)
        if n >= block_words:
            yield Block(items, window)
            items, n = [], 0
    yield Block(items, window)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    work: Workspace | None = None,
    window: int = WINDOW,
    shard_words: int = 250_000,
    block_words: int = 1_000_000,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    carry: bool = False,
) -> DataFrame:
    """Per row: doc_id, n_words, ranges (of words), spans (of code points; what to remove), items.

    With ``carry`` the whole input row comes along as the struct ``row``; its text
    is read there, so that no text is passed or written twice. ``work`` takes what is written between blocks.
    """
    work = work or Workspace(docs.sparkSession, "decontaminate")
    place = docs.columns.index(text) if carry and dict(docs.dtypes).get(text) == "string" else None  # of the text in the row
    own_text = [text_of(text).alias("text")] if place is None else []
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    out = docs.select(F.col(doc_id).alias("doc_id"), *own_text, *rest)
    kinds = [out.schema["doc_id"].dataType, benchmark.schema[item_id].dataType]
    own, of = (k.simpleString() for k in kinds)
    names = ["doc_id", *(["text"] if own_text else [])]
    out = out.selectExpr(*names, f"cast(array() as {RANGES}) as ranges", f"cast(array() as array<{of}>) as items", *(["row"] if carry else []))
    texts_too = ", text string" if own_text else ""
    extra = f", row {out.schema['row'].dataType.simpleString()}" if carry else ""
    id_type, item_type = (to_arrow_type(k) for k in kinds)
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    structs = lambda x: [[{"start": a, "end": b} for a, b in r] for r in x]

    def searching(block: Block, last: bool):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids: list = []
            texts: list[str] = []
            words: list[list[bytes]] = []
            before: list[tuple] = []
            rows: list[pa.Array] = []
            n = 0

            def shard() -> pa.RecordBatch:
                found = [(_join(r, a), sorted({*i, *b})) for (r, i), (a, b) in zip(before, block.find(words), strict=True)]
                ranges, items = [f[0] for f in found], [f[1] for f in found]
                columns = {"doc_id": pa.array(ids, id_type)}
                if last:
                    columns |= {"n_words": pa.array([len(w) for w in words], pa.int64()), "ranges": pa.array(structs(ranges), pair)}
                    columns |= {"spans": pa.array([_spans(t, r) if r else [] for t, r in zip(texts, ranges, strict=True)], pair)}
                else:
                    columns |= {"text": pa.array(texts, pa.string())} if place is None else {}
                    columns["ranges"] = pa.array(structs(ranges), pair)
                columns["items"] = pa.array(items, pa.list_(item_type))
                return pa.RecordBatch.from_pydict(columns | ({"row": pa.concat_arrays(rows)} if carry else {}))

            for batch in batches:
                row = batch.column("row") if carry else None
                given = batch.column("text") if place is None else row.field(place)
                columns = [batch.column("doc_id").to_pylist(), given, batch.column("ranges").to_pylist(), batch.column("items").to_pylist()]
                first = 0  # the batch's rows from here on aren't in ``rows`` yet
                for at, (i, t, r, it) in enumerate(zip(*columns, strict=True)):
                    t = t.as_py() or ""
                    ids.append(i)
                    texts.append(t)
                    words.append(words_of(t))
                    before.append(([(x["start"], x["end"]) for x in r], it))
                    n += len(words[-1])
                    if n >= shard_words:
                        if carry:
                            rows.append(row.slice(first, at + 1 - first))
                        yield shard()
                        ids, texts, words, before, rows, n, first = [], [], [], [], [], 0, at + 1
                if carry and first < batch.num_rows:
                    rows.append(row.slice(first))
            if ids:
                yield shard()

        return search

    parts = blocks(benchmark, window, block_words, item_id, item_text)
    block, k = next(parts), 0
    for after in parts:
        done = out.mapInArrow(searching(block, False), f"doc_id {own}{texts_too}, ranges {RANGES}, items array<{of}>{extra}")
        out = work.save(done, f"block{k}")
        if k:
            work.drop(f"block{k - 1}")
        block, k = after, k + 1
    return out.mapInArrow(searching(block, True), f"doc_id {own}, n_words long, ranges {RANGES}, spans {RANGES}, items array<{of}>{extra}")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words are inside occurrences."""
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def hits(found: DataFrame) -> DataFrame:
    """``found`` with n_hit and contaminated."""
    n = F.aggregate("ranges", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return found.withColumn("n_hit", n).withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words")))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, work: Workspace | None = None) -> DataFrame:
    """The rows of ``docs``, as they are, that aren't contaminated."""
    return hits(find_contamination(docs, benchmark, work, carry=True)).where("not contaminated").select("row.*")


def remove_spans(text: Column, spans: Column) -> Column:
    """The text without the spans."""
    return F.aggregate(
        F.reverse(spans), text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.substring(t, s["end"] + 1, F.char_length(t)))
    )

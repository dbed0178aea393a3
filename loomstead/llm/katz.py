"""Katz back-off language model: Good-Turing discounted counts of words and of word sequences up to ``order`` words.

P(w | h) of a context h is the discounted share of the sequence (h, w) among h's
sequences if it was seen in training, and otherwise alpha(h) P(w | h'), where h'
is h without its first word; in the end P(w) is the discounted share of the
word, and all words never seen share the mass that the discounts leave.
alpha(h) makes every P(. | h) sum to one exactly: it is what h's seen sequences
leave, over what their words leave of P(. | h'). A context whose counts leave
nothing counts one more; a context never seen has alpha one. The first words of
a text have the start and the words before them as their context, however short.
Counts up to ``CUT`` are discounted, by Good-Turing from the numbers of
sequences of a length seen 1, 2, ... times; where those numbers give no discount
between zero and one, none is made.

Nothing of a corpus' size is held in one place. Documents are gathered in blocks
of about ``block_tokens`` tokens, written once as numbers into the block's own
list of words. What a block needs of the whole corpus it asks for by key: an
exchange deals the keys of all blocks into buckets by hash, sums the values that
the blocks bring for each key, and writes the sums as a table by bucket and
block, in the order in which they were asked. A block brings each of its
distinct words and sequences once, however frequent they are. For each length
there is an exchange of counts, and one of sums over the seen sequences of each
context (each sequence being told by one block only): of their counts, and of
the counts of the same without the first word, which are seen too. An answer
also says whether another block has the key: the sequences after a context that
no other block has are this block's own, and so are their sums, which aren't
moved then. Sums are of integers, so the result doesn't depend on the order of rows. The tokens are then
scored block by block, from the word up to the longest sequence, in ``PASSES`` passes
over a share of the blocks each, so that the answers are on disk once and a little.

Blocks are written in buckets: answers are brought to them, and they stay where they are.

Words are runs of anything but ASCII white space, A-Z in lower case; each text
ends with an end token and is preceded by a start that is only a context. Words
and sequences are told apart by 64-bit hashes within a block, and between blocks
by the upper bits: ``SPARE`` more than the number of tokens takes (64 at most),
so that one key in some millions meets another's.

Defined cases: a null or empty text is the end token alone; null and repeated
ids are kept row by row, ids of any type as they are; without training rows all words are unknown and share
probability one; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Workspace, text_of

CUT, SPARE, PASSES = 5, 22, 2
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BLOCK = "block long, doc_ids array<{id}>, lengths array<int>, trained array<boolean>, words binary, keys binary"
ASKED = "kind int, bucket int, block long, keys binary, sums binary"
ANSWER = "kind int, bucket int, block long, sums binary, told binary"
FIRST, ALONE = 1, 2


def trains(doc_id: object) -> bool:
    """Whether the model learns from a document."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def discounts(seen: list[int]) -> np.ndarray:
    """Good-Turing discount of each count from 0 to CUT; seen[r]: how many were seen r times, r <= CUT + 1."""
    out = np.ones(CUT + 1)
    if seen[1]:
        rest = (CUT + 1) * seen[CUT + 1] / seen[1]
        for r in range(1, CUT + 1):
            if seen[r] and rest < 1:
                d = ((r + 1) * seen[r + 1] / seen[r] / r - rest) / (1 - rest)
                out[r] = d if 0 < d < 1 else 1.0
    return out


class Model:
    """What all blocks share: totals and discounts."""

    def __init__(self, seen: list[list[int]]):
        """seen: for words, pairs and so on."""
        # totals: seen 0 .. CUT + 1 times (0 unused), then the sum of counts, then how many were seen at all
        words = seen[0]
        self.tokens, self.types = words[CUT + 2], words[CUT + 3]
        self.d = [np.zeros(0), *map(discounts, seen)]  # by length
        low = sum(r * words[r] for r in range(1, CUT + 1))
        mass = sum(self.d[1][r] * r * words[r] for r in range(1, CUT + 1)) + (self.tokens - low)
        self.total = self.tokens if mass < self.tokens - 1e-9 else self.tokens + 1
        self.unknown = 1 - mass / self.total

    def weigh(self, n: int, c: np.ndarray) -> np.ndarray:
        """Discounted counts of sequences of n words."""
        return c * np.where(c <= CUT, self.d[n][np.minimum(c, CUT)], 1.0)

    def word(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words with these counts."""
        return np.where(c > 0, self.weigh(1, c) / self.total, self.unknown)

    def context(self, n: int, sums: np.ndarray, shorter: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """The denominator and alpha of contexts of n - 1 words, from the sums over their sequences; shorter: the denominators without the first word."""
        r = np.arange(1, CUT + 1)
        count = sums[:, :CUT] @ r + sums[:, CUT]
        kept = sums[:, :CUT] @ (r * self.d[n][1:]) + sums[:, CUT]
        below = (sums[:, CUT + 1 : 2 * CUT + 1] @ (r * self.d[n - 1][1:]) + sums[:, 2 * CUT + 1]) / np.maximum(shorter, 1)
        total = count + (kept > count - 1e-9)
        alpha = np.where(count > 0, (1 - kept / np.maximum(total, 1)) / np.maximum(1 - below, 1e-300), 1.0)
        return total, alpha


@cache
def _zstd():
    """A compressor and a decompressor for each process: messages are short, and making one takes longer than using it."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(a: np.ndarray) -> bytes:
    """Non-negative whole numbers in the fewest bytes, planes of bytes together, compressed."""
    a = np.ascontiguousarray(a).reshape(-1)
    most = int(a.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    planes = a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + _zstd()[0].compress(planes.tobytes())


def expand(b: bytes) -> np.ndarray:
    """The inverse of ``squeeze``."""
    planes = np.frombuffer(_zstd()[1].decompress(b[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(b[0], -1).T).reshape(-1).view(f"<u{b[0]}").astype(np.uint64)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Keys in order, by their differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b), dtype=np.uint64)


def _digest():
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest


def block_of(docs: DataFrame, block_tokens: int, doc_id: str, text: str) -> DataFrame:
    """The blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = _digest()
        end = np.array([digest(b"", 7)], np.uint64)
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        hashes: list[np.ndarray] = []
        n = 0

        def block() -> pa.RecordBatch:
            keys, words = np.unique(np.concatenate(hashes), return_inverse=True)
            row = [[number], [ids], [[len(h) for h in hashes]], [[trains(i) for i in ids]], [squeeze(words)], [squeeze_sorted(keys)]]
            types = [pa.int64(), pa.list_(id_type), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = t.as_py().encode("utf-8", "replace").lower().split()
                ids.append(i)
                hashes.append(np.append(np.fromiter(map(digest, words), np.uint64, len(words)), end))
                n += len(words) + 1
                if n >= block_tokens:
                    yield block()
                    ids, hashes, n, number = [], [], 0, number + 1
        if ids:
            yield block()

    own = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    id_type = to_arrow_type(own.schema["doc_id"].dataType)
    return own.mapInArrow(run, BLOCK.format(id=own.schema["doc_id"].dataType.simpleString()))


class Tokens:
    """A block's tokens, words and sequences, numbered in order of their keys.

    For each length n from 2: ``at[n]`` is each token's number among the distinct
    sequences (-1 near a text's start), ``left[n]`` and ``rest[n]`` are the numbers
    of a sequence's context and of the sequence without its first word.
    """

    def __init__(self, row: dict, order: int):
        self.ids, self.lengths = row["doc_ids"], np.array(row["lengths"], np.int64)
        self.trained = np.array(row["trained"], bool)
        self.words, words = expand(row["words"]).astype(np.int64), expand_sorted(row["keys"])
        self.in_training = np.repeat(self.trained, self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        before = np.empty_like(self.words)
        before[1:] = self.words[:-1]
        before[self.starts] = len(words)  # the start of a text
        self.at, self.keys = {1: self.words}, {1: words}
        self.contexts = {2: np.append(words, np.uint64(_digest()(b"", 9)))}
        self.left: dict[int, np.ndarray] = {}
        self.rest: dict[int, np.ndarray] = {}
        for n in range(2, order + 1):
            there = before >= 0
            x = self.contexts[n][before[there]] * _A
            x = ((x ^ (x >> np.uint64(31))) + words[self.words[there]]) * _B
            self.keys[n], number = np.unique(x ^ (x >> np.uint64(29)), return_inverse=True)
            self.contexts[n + 1] = self.keys[n]
            self.at[n] = np.full(len(self.words), -1, np.int32)
            self.at[n][there] = number
            self.left[n], self.rest[n] = np.empty(len(self.keys[n]), np.int32), np.empty(len(self.keys[n]), np.int32)
            self.left[n][number], self.rest[n][number] = before[there], self.at[n - 1][there]
            before = np.full(len(self.words), -1, np.int64)
            before[1:] = self.at[n][:-1]
            before[self.starts] = -1

    def count(self, n: int) -> np.ndarray:
        """Occurrences of the sequences of n words in training."""
        at = self.at[n][self.in_training]
        return np.bincount(at[at >= 0], minlength=len(self.keys[n])).astype(np.int64)


def ask(kind: int, block: int, keys: np.ndarray, sums: np.ndarray, buckets: int, bits: int) -> list[tuple]:
    """Rows that ask for the sums of the keys and bring the block's own; of the keys the upper bits are sent."""
    if (order := _order(keys)) is not None:
        keys, sums = keys[order], sums[order]
    bucket = (keys >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)
    keys = keys >> np.uint64(64 - bits)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]))
    return [(kind, int(bucket[a]), block, squeeze_sorted(keys[a:b]), squeeze(sums[a:b].T)) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def _order(keys: np.ndarray) -> np.ndarray | None:
    """The order of keys; None if they are in order."""
    return None if (keys[1:] >= keys[:-1]).all() else np.argsort(keys)


def understand(rows: list[dict], keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The answers to ``ask`` in the order of ``keys``, and what they tell of each key: FIRST, this block is the one to tell of it; ALONE, no other has it."""
    rows = sorted(rows, key=lambda r: r["bucket"])
    if not rows:
        return np.zeros((len(keys), width), np.int64), np.zeros(len(keys), np.uint8)
    sums = np.concatenate([expand(r["sums"]).astype(np.int64).reshape(width, -1).T for r in rows])
    told = np.concatenate([expand(r["told"]).astype(np.uint8) for r in rows]) if rows[0]["kind"] > 0 else np.zeros(len(keys), np.uint8)
    if (order := _order(keys)) is not None:
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        sums, told = sums[back], told[back]
    return sums, told


def _table(rows: list[tuple], schema: str) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, types[t]) for (n, t), c in zip(names, columns, strict=True)})


def tally(c: np.ndarray) -> np.ndarray:
    """How many of the counts are 0, 1 .. CUT + 1, then their sum, then how many aren't 0."""
    seen = np.bincount(np.minimum(c, CUT + 2), minlength=CUT + 3)[: CUT + 2]
    return np.array([*seen.tolist(), int(c.sum()), int((c > 0).sum())], np.int64)


def exchange(asked: DataFrame, width: dict[int, int]) -> DataFrame:
    """Answer what all blocks asked. Of each kind rows with block -1 tell how many keys summed to 1, 2, ... in the first column."""

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        kind, bucket = key[0].as_py(), key[1].as_py()
        w = width[kind]
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        each = [expand_sorted(r["keys"]) for r in rows]
        keys = np.concatenate(each)
        own = np.concatenate([expand(r["sums"]).astype(np.int64).reshape(w, -1).T for r in rows])
        order = np.argsort(keys)
        new = np.diff(keys[order], prepend=~keys[order[:1]]) != 0
        begins = np.flatnonzero(new)
        sums = np.add.reduceat(own[order], begins, axis=0)
        number = np.empty(len(keys), np.int64)
        number[order] = np.cumsum(new) - 1
        told = (np.diff(begins, append=len(keys)) == 1).astype(np.uint8)[number] * np.uint8(ALONE)
        told[order[begins]] |= np.uint8(FIRST)
        out = [(kind, bucket, -1, tally(sums[:, 0]).tobytes(), b"")]
        upto = 0
        for r, k in zip(rows, each, strict=True):
            part = slice(upto, upto + len(k))
            out.append((kind, bucket, r["block"], squeeze(sums[number[part]].T), squeeze(told[part]) if kind > 0 else b""))
            upto += len(k)
        return _table(out, ANSWER)

    return asked.groupBy("kind", "bucket").applyInArrow(answer, ANSWER).withColumn("part", part_of(F.col("block")))


def part_of(block: Column) -> Column:
    """The pass in which a block is scored."""
    return F.pmod(F.xxhash64(block), F.lit(PASSES)).cast("int")


def with_answers(blocks: DataFrame, answers: DataFrame, run: Callable[[Tokens, int, dict[int, list[dict]]], pa.Table], schema: str, order: int) -> DataFrame:
    """Apply ``run`` to each block and the answers to it, by kind."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        by_kind: dict[int, list[dict]] = defaultdict(list)
        for r in right.to_pylist():
            by_kind[r["kind"]].append(r)
        parts = [run(Tokens(row, order), row["block"], by_kind) for row in left.to_pylist()]  # one
        return pa.concat_tables(parts)

    return blocks.groupBy("block").cogroup(answers.where("block >= 0").drop("part").groupBy("block")).applyInArrow(meet, schema)


def totals(answers: DataFrame, kind: int) -> list[int]:
    """Over all buckets: how many keys were seen 0, 1, ... times, the sum, and how many were seen."""
    cells = answers.where((F.col("block") == -1) & (F.col("kind") == kind)).select("sums")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = sum(np.frombuffer(x.as_py(), np.int64) for x in batch.column(0))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "x"])

    out = [0] * (CUT + 4)
    for i, x in cells.mapInArrow(spread, "i int, x long").groupBy("i").agg(F.sum("x")).collect():  # CUT + 4 rows
        out[i] = x
    return out


SCORED = "doc_id {id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Known:
    """What a block knows by now of its sequences of each length: counts in the corpus, whether it tells of them, whether it alone has them."""

    def __init__(self, t: Tokens, answers: dict[int, list[dict]], upto: int):
        self.c: dict[int, np.ndarray] = {}
        self.first: dict[int, np.ndarray] = {}
        self.alone: dict[int, np.ndarray] = {}
        for k in range(1, upto + 1):
            if k < 2 < upto and k not in answers:  # longer contexts don't look at words
                continue
            sums, told = understand(answers[k], t.keys[k], 1)
            self.c[k], self.first[k], self.alone[k] = sums[:, 0], told & FIRST > 0, told & ALONE > 0

    def lone_contexts(self, k: int) -> np.ndarray:
        """Which contexts of sequences of k words no other block has; the start of a text is everyone's."""
        return np.append(self.alone[1], False) if k == 2 else self.alone[k - 1]

    def contexts(self, t: Tokens, k: int, which: np.ndarray) -> np.ndarray:
        """For the contexts of sequences of k words that count: the sums over the sequences that this block tells of."""
        own = self.first[k] & (self.c[k] > 0) & which[t.left[k]]
        left, c, below = t.left[k][own], self.c[k][own], self.c[k - 1][t.rest[k][own]]
        cell = (np.cumsum(which) - 1)[left] * WIDTH
        # columns for 1 .. CUT, and one for the sum of what is more
        few = [(cell + (first - 1) + x)[x <= CUT] for first, x in ((0, c), (CUT + 1, below))]
        sums = np.bincount(np.concatenate(few), minlength=int(which.sum()) * WIDTH)
        for first, x in ((0, c), (CUT + 1, below)):
            np.add.at(sums, (cell + first + CUT)[x > CUT], x[x > CUT])
        return sums.reshape(-1, WIDTH)


WIDTH = 2 * CUT + 2


def score_documents(
    docs: DataFrame, work: Workspace, block_tokens: int = 1_000_000, bucket_keys: int = 4_000_000, doc_id: str = "doc_id", text: str = "text", order: int = 2
) -> DataFrame:
    """The model's log10 probability of every text, and that of the add-one base; order: the words of the longest sequences, two at least."""
    if order < 2:
        raise ValueError("order must be at least 2")
    # in buckets of the block: later steps bring answers to blocks, and blocks stay where they are
    blocks = work.save_bucketed(block_of(docs, block_tokens, doc_id, text), "blocks", "block")
    n = blocks.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    buckets = 1 << max(2, n // bucket_keys).bit_length()
    bits = min(64, SPARE + n.bit_length())

    def first_asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = Tokens(row, 2)
                rows = [r for k in (1, 2) for r in ask(k, row["block"], t.keys[k], t.count(k), buckets, bits)]
                yield from _table(rows, ASKED).to_batches()

    answered = work.save(exchange(blocks.mapInArrow(first_asks, ASKED), {1: 1, 2: 1}), "answers1", by="part")

    def more_asks(k: int) -> Callable[[Tokens, int, dict[int, list[dict]]], pa.Table]:
        """Ask for the sums of the contexts of sequences of k words, as kind -k, and for the counts of the next longer sequences."""

        def asks(t: Tokens, block: int, answers: dict[int, list[dict]]) -> pa.Table:
            known = Known(t, answers, k)
            some = ~known.lone_contexts(k)
            # a context has a row of sums: smaller buckets
            rows = ask(-k, block, t.contexts[k][some], known.contexts(t, k, some), 2 * buckets, bits)
            if k < order:
                rows += ask(k + 1, block, t.keys[k + 1], t.count(k + 1), buckets, bits)
            return _table(rows, ASKED)

        return asks

    for k in range(2, order + 1):
        needed = answered.where(F.col("kind").isin([x for x in range(1, k + 1) if k == 2 or x > 1]))
        asked = with_answers(blocks, needed, more_asks(k), ASKED, min(k + 1, order))
        answered = answered.unionByName(work.save(exchange(asked, {-k: WIDTH, k + 1: 1}), f"answers{k}", by="part"))
    model = Model([totals(answered, k) for k in range(1, order + 1)])
    kind = blocks.schema["doc_ids"].dataType.elementType
    id_type = to_arrow_type(kind)

    def evaluate(t: Tokens, block: int, answers: dict[int, list[dict]]) -> pa.Table:
        known = Known(t, answers, order)
        c1 = known.c[1]
        base = np.log10((c1 + 1) / (model.tokens + model.types + 1))
        best, shorter = np.log10(model.word(c1)), model.total
        scored = np.empty(len(t.words))
        for k in range(2, order + 1):
            c, some = known.c[k], ~known.lone_contexts(k)
            sums = np.empty((len(some), WIDTH), np.int64)
            sums[~some] = known.contexts(t, k, ~some)
            sums[some] = understand(answers[-k], t.contexts[k][some], WIDTH)[0]
            total, alpha = model.context(k, sums, shorter)
            with np.errstate(divide="ignore"):
                seen = np.log10(model.weigh(k, c)) - np.log10(np.maximum(total, 1))[t.left[k]]
                unseen = np.log10(alpha)[t.left[k]] + best[t.rest[k]]
            best, shorter = np.where(c > 0, seen, unseen), total[t.rest[k]]
            there = t.at[k] >= 0
            scored[there] = best[t.at[k][there]]
        sums = lambda x: np.add.reduceat(x, t.starts)
        out = [t.ids, ~t.trained, t.lengths, sums((c1 > 0).astype(np.int64)[t.words]), np.full(len(t.ids), model.tokens), sums(base[t.words]), sums(scored)]
        types = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({c.split()[0]: pa.array(x, y) for c, x, y in zip(SCORED.split(", "), out, types, strict=True)})

    scores = None
    for p in range(PASSES):
        some = with_answers(blocks.where(part_of(F.col("block")) == p), answered.where(F.col("part") == p), evaluate, SCORED.format(id=kind.simpleString()), order)
        some = work.save(some, f"scores{p}")
        scores = some if scores is None else scores.unionByName(some)
    work.keep(*[f"scores{p}" for p in range(PASSES)])
    return scores

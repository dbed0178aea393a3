"""Phrases whose words belong together, mined by contiguous pattern growth.

A pass over the texts counts words. Every frequent word is then a prefix with the
occurrences behind it as its projection: pointers, each the few words that follow,
equal ones of a block of text as one with a weight. One task has all pointers of a
prefix and grows it to the right, depth first, as long as phrases stay frequent.
A prefix with more pointers than a task should hold is grown by one word in a pass
of its own, counted in Spark with partial sums, so its longer prefixes become the
tasks' prefixes; after the last word only sums are left. No group is unbounded.

Two bitmaps of fixed size travel with a pass: which phrases may be frequent, and
which prefixes are grown apart. They go by hashes; where two hashes meet, some
pointers move that needn't, or a prefix is grown apart that needn't, and counts
stay exact.

Rows: null texts are empty, a null language counts as ``und``; empty texts give
nothing; very long texts are taken whole, and halved, with the few words behind that
windows need, where one has too many different words; repeated rows count each time;
an empty table gives no phrase; only ``lang`` and ``text`` are read. Ties in the
ranking fall by the phrase.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace
from .pieces import _flat, _upto

#: Words of the longest phrase; four numbers of 16 bits are one window.
MOST = 4
BITS = 16
#: Different words of a block; one with more is halved.
DIFFERENT = (1 << BITS) - 1
#: Words that a task counts at once.
BLOCK = 1_000_000
#: Pointers that one prefix may bring to a task at most.
POINTERS = 1 << 20
#: log2 of the bits in a bitmap.
MAP_BITS = 26
#: Buckets of prefixes at least, and pointers that one holds on average at most; a task reads one at a time.
BUCKETS, HELD = 4096, 1 << 19
#: Parts of a language's candidates that are ranked apart first.
PARTS = 64
#: The score of a cut, exact beyond 64 bits.
SCORE = "cast((2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r) as bigint)"
END = b"\xff"  # in no UTF-8 text
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
CLEAN = bytes.maketrans(UPPER + b"\t" + b".,;:!?\n\v\f\r", LOWER + b" " + END * 10)


def words_in(text: bytes) -> list[bytes]:
    """The lower-cased words of a text; an END stands between its pieces and behind the last."""
    return (text.translate(CLEAN) + END).replace(END, b" " + END + b" ").split()


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """The words of all texts by language, in blocks of some size."""
    held: dict[str, list[bytes]] = defaultdict(list)
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_in(text) if text else []
            held[lang] += words
            total += len(words)
            if total >= BLOCK:
                yield from held.items()
                held.clear()
                total = 0
    yield from held.items()


class Bitmap:
    """Which phrases of a table there may be, by a hash of language and phrase."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def of(phrases: DataFrame) -> Bitmap:
        """Of a table with lang and phrase; the driver gets a fixed number of words at most."""
        bit = F.crc32(F.concat(F.col("lang").cast("binary"), F.unhex(F.lit("00")), F.col("phrase"))) % (1 << MAP_BITS)
        by_word = phrases.select((bit.cast("int") % 64).alias("low"), F.floor(bit / 64).cast("int").alias("word"))
        found = by_word.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, low)")).alias("set")).toArrow()
        words = np.zeros(1 << (MAP_BITS - 6), np.uint64)
        words[found["word"].to_numpy()] = found["set"].to_numpy().view(np.uint64)
        return Bitmap(words)

    def has(self, lang: str, phrases: Sequence[bytes]) -> np.ndarray:
        begun = zlib.crc32(lang.encode() + b"\x00")
        bit = np.fromiter((zlib.crc32(p, begun) for p in phrases), np.int64, len(phrases)) % (1 << MAP_BITS)
        return (self.words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1


class Windows:
    """The different windows of a block: up to MOST frequent words each, as one number, with how often they occur.

    Windows begin at the first ``upto`` words.
    """

    def __init__(self, lang: str, words: list[bytes], upto: int, frequent: Bitmap):
        self.lang, known = lang, [w for w in set(words) if w != END]
        known = [w for w, f in zip(known, frequent.has(lang, known), strict=True) if f]
        self.fits = len(known) <= DIFFERENT or upto < 2
        if not self.fits:
            return
        self.words = [b"", *sorted(known)]
        number = dict.fromkeys(words, 0)
        number.update(zip(self.words[1:], range(1, len(self.words)), strict=True))
        codes = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
        all_codes = window = codes
        for k in range(1, MOST):
            after = np.r_[codes[k:], np.zeros(min(k, len(codes)), np.uint64)]
            all_codes = np.where(all_codes > 0, after, np.uint64(0))
            window = (window << np.uint64(BITS)) | all_codes
        window = window[:upto]
        self.windows, self.counts = np.unique(window[window >> np.uint64(BITS * (MOST - 1)) > 0], return_counts=True)
        raw = b"".join(self.words)
        self.raw, self.length = np.frombuffer(raw, np.uint8), np.array([len(w) for w in self.words], np.int64)

    def word(self, k: int, windows: np.ndarray | None = None) -> np.ndarray:
        """The k-th word's number of each window, 0 where there is none."""
        own = self.windows if windows is None else windows
        return ((own >> np.uint64(BITS * (MOST - k))) & np.uint64((1 << BITS) - 1)).astype(np.int64)

    def phrases(self, windows: np.ndarray, k: int) -> list[bytes]:
        """The first k words of each window, one space between them."""
        return [b" ".join([self.words[i] for i in row]) for row in zip(*(self.word(j, windows).tolist() for j in range(1, k + 1)), strict=True)]

    def in_map(self, which: Bitmap, k: int, among: np.ndarray) -> np.ndarray:
        """Which of the windows chosen have their first k words in a bitmap."""
        out = np.zeros(len(self.windows), bool)
        at = np.flatnonzero(among & (self.word(k) > 0))
        first = np.uint64(BITS * (MOST - k))
        own = self.windows[at] >> first
        begins = np.flatnonzero(np.r_[len(own) > 0, own[1:] != own[:-1]])
        found = which.has(self.lang, self.phrases(own[begins] << first, k))
        out[at] = np.repeat(found, np.diff(np.r_[begins, len(own)]))
        return out


def block_windows(batches: Iterator[pa.RecordBatch], frequent: Bitmap) -> Iterator[Windows]:
    """The windows of all blocks; a block with too many different words is halved."""
    for lang, words in blocks(batches):
        waiting = [(words, len(words))]
        while waiting:
            own, upto = waiting.pop()
            found = Windows(lang, own, upto, frequent)
            if found.fits:
                yield found
            else:  # the first half sees the words behind it, but counts no window that begins there
                cut = upto // 2
                waiting += [(own[: cut + MOST - 1], cut), (own[cut:], upto - cut)]


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Byte strings of some sizes that lie one after the other."""
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(_upto(sizes).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


COUNTS = "lang string, phrase binary, n long"


def _count_batch(lang: str, phrases: Sequence[bytes], counts: Sequence[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()), pa.array(counts, pa.int64())], names=["lang", "phrase", "n"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang_"), F.col("text").cast("binary").alias("text_"))


def count_words(docs: DataFrame) -> DataFrame:
    """How often each word occurs in each language; the row with a null phrase has all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in blocks(batches):
            counts = Counter(words)
            counts.pop(END, None)
            if counts:
                yield _count_batch(lang, [None, *counts], [counts.total(), *counts.values()])

    return _texts(docs).mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def count_apart(docs: DataFrame, k: int, frequent, apart) -> DataFrame:
    """How often each phrase of k words occurs whose first k - 1 are grown apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in block_windows(batches, frequent.value):
            chosen = own.word(k) > 0
            for j in range(1, k):
                chosen = own.in_map(apart.value, j, chosen)
            shift = np.uint64(BITS * (MOST - k))
            phrases, at = np.unique(own.windows[chosen] >> shift, return_inverse=True)
            if len(phrases):
                counts = np.bincount(at, own.counts[chosen]).astype(np.int64)
                yield _count_batch(own.lang, own.phrases(phrases << shift, k), counts)

    return _texts(docs).mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def pointers(docs: DataFrame, frequent, apart, buckets: int) -> DataFrame:
    """For each block and bucket of prefixes: each prefix and the words behind it, a line for each different continuation, and their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in block_windows(batches, frequent.value):
            depth, among = np.ones(len(own.windows), np.int64), np.ones(len(own.windows), bool)
            for k in range(1, MOST):
                among = own.in_map(apart.value, k, among)
                depth[among] = k + 1
            kept = np.zeros(len(own.windows), bool)
            for k in range(1, MOST):
                these = (depth == k) & (own.word(k + 1) > 0)
                kept |= own.in_map(frequent.value, k, these) if k > 1 else these
            if kept.any():
                yield _pointer_batch(own, own.windows[kept], own.counts[kept], depth[kept], buckets)

    return _texts(docs).mapInArrow(run, "lang string, bucket int, lines binary, weights binary")


def _pointer_batch(own: Windows, windows: np.ndarray, counts: np.ndarray, depth: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows for buckets. A prefix stands before a tab; every line is what one of its pointers has behind it."""
    shift = (BITS * (MOST - depth)).astype(np.uint64)
    prefix = (windows >> shift) << shift
    begins = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (depth[1:] != depth[:-1])])
    sizes = np.diff(np.r_[begins, len(windows)])
    seed = zlib.crc32(own.lang.encode() + b"\x00")
    bucket = np.empty(len(begins), np.int64)
    for k in range(1, MOST):
        at = np.flatnonzero(depth[begins] == k)
        bucket[at] = np.fromiter((zlib.crc32(p, seed) % buckets for p in own.phrases(windows[begins[at]], k)), np.int64, len(at))
    order = np.argsort(bucket, kind="stable")  # prefixes by bucket, their windows after them
    bucket, sizes = bucket[order], sizes[order]
    windows, counts, depth = (_flat(x, begins[order], sizes) for x in (windows, counts, depth))
    starts = _upto(sizes)[:-1]
    codes = np.stack([own.word(k, windows) for k in range(1, MOST + 1)], axis=1)
    place = np.arange(1, MOST + 1)
    first = np.zeros(len(windows), bool)
    first[starts] = True
    last = np.max(np.where(codes > 0, place, 0), axis=1)
    row, column = np.nonzero((codes > 0) & (first[:, None] | (place > depth[:, None])))
    which = codes[row, column]
    end = np.where(column + 1 == depth[row], 9, np.where(column + 1 == last[row], 10, 32))  # a tab, a line's end, a space
    length = own.length[which] + 1
    flat = np.empty(int(length.sum()), np.uint8)
    ends = np.cumsum(length)
    inside = np.ones(len(flat), bool)
    inside[ends - 1] = False
    flat[inside] = _flat(own.raw, (_upto(own.length)[:-1])[which], own.length[which])
    flat[ends - 1] = end
    by_window = np.bincount(row, length, len(windows)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    n = len(cut)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([own.lang] * n, pa.string()),
            pa.array(bucket[cut], pa.int32()),
            _binary(flat, np.add.reduceat(by_window, starts[cut])),
            _binary(counts.astype(np.uint32).view(np.uint8), 4 * np.add.reduceat(sizes, cut)),
        ],
        names=["lang", "bucket", "lines", "weights"],
    )


def grow(prefix: bytes, behind: np.ndarray, weights: np.ndarray, names: Sequence[bytes], least: int) -> Iterator[tuple[bytes, int]]:
    """All frequent phrases that begin with a prefix and are longer, depth first.

    ``behind`` has a row for each pointer: the numbers of the words that follow, 0 where there are none.
    """
    if not behind.shape[1]:
        return
    order = np.argsort(behind[:, 0], kind="stable")
    ordered = behind[order, 0]
    begins = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sums = np.add.reduceat(weights[order], begins)
    ends = np.r_[begins[1:], len(ordered)]
    for i in np.flatnonzero((sums >= least) & (ordered[begins] > 0)):
        own, phrase = order[begins[i] : ends[i]], prefix + b" " + names[ordered[begins[i]]]
        yield phrase, int(sums[i])
        yield from grow(phrase, behind[own, 1:], weights[own], names, least)


def _grow_bucket(lines: bytes, weights: np.ndarray, least: int) -> Iterator[tuple[bytes, int]]:
    """Grow all prefixes of a bucket, of which every pointer is there."""
    words = lines.replace(b"\t", b" \t ").replace(b"\n", b" \n ").split(b" ")
    words = [w for w in words if w]
    names = [b"", b"\n", b"\t", *(set(words) - {b"\n", b"\t"})]
    number = dict(zip(names, range(len(names)), strict=True))
    codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    tabs, ends = np.flatnonzero(codes == 2), np.flatnonzero(codes == 1)
    heads = np.r_[0, ends[np.searchsorted(ends, tabs[1:]) - 1] + 1]  # where a prefix begins: behind the line before it
    prefixes = np.zeros((len(tabs), MOST - 1), np.int64)
    for k in range(MOST - 1):
        has = heads + k < tabs
        prefixes[has, k] = codes[heads[has] + k]
    own = np.searchsorted(tabs, ends) - 1  # the prefix that a line belongs to
    begins = np.r_[0, ends[:-1] + 1]
    firsts = np.searchsorted(ends, tabs)
    begins[firsts] = tabs + 1
    behind = np.zeros((len(ends), MOST - 1), np.int64)
    for k in range(MOST - 1):
        has = begins + k < ends
        behind[has, k] = codes[begins[has] + k]
    kinds, same = np.unique(prefixes, axis=0, return_inverse=True)
    group = same.reshape(-1)[own]
    order = np.argsort(group, kind="stable")
    edges = np.searchsorted(group[order], np.arange(len(kinds) + 1))
    sums = np.add.reduceat(weights[order], edges[:-1])
    for i in np.flatnonzero(sums >= least):
        at = order[edges[i] : edges[i + 1]]
        prefix = [names[c] for c in kinds[i] if c]
        yield from grow(b" ".join(prefix), behind[at, : MOST - len(prefix)], weights[at], names, least)


def grow_prefixes(found: DataFrame, parts: int, least: int) -> DataFrame:
    """One task for each prefix: its frequent phrases and how often they occur."""

    def grown(lang: str, lines: list[bytes], weights: list[bytes]) -> pa.RecordBatch:
        rows = list(_grow_bucket(b"".join(lines), np.frombuffer(b"".join(weights), np.uint32).astype(np.int64), least))
        return _count_batch(lang, [r[0] for r in rows], [r[1] for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lines, weights = None, [], []
        for batch in batches:
            for bucket, lang, own_lines, own_weights in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lang", "lines", "weights")), strict=True):
                if (bucket, lang) != last:
                    if last:
                        yield grown(last[1], lines, weights)
                    last, lines, weights = (bucket, lang), [], []
                lines.append(own_lines)
                weights.append(own_weights)
        if last:
            yield grown(last[1], lines, weights)

    return found.repartition(parts, "bucket").sortWithinPartitions("bucket", "lang").mapInArrow(run, COUNTS)


def frequent_phrases(docs: DataFrame, work: Workspace, least: int = 30, most_pointers: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to four words that occur at least ``least`` times, and how many words each language has."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = work.save(count_words(docs).where((F.col("n") >= least) | F.col("phrase").isNull()), "words")
    totals, words = counted.where("phrase is null").select("lang", F.col("n").alias("total")), counted.where("phrase is not null")
    n = totals.agg(F.sum("total")).first()[0] or 0
    bound = most_pointers or min(POINTERS, n // (4 * parts) + least)
    known, apart, begun = words, words.where(F.col("n") > bound), words
    for k in range(2, MOST + 1):
        if begun.where(F.col("n") > bound).isEmpty():
            break
        frequent, hot = (_send(spark, Bitmap.of(t)) for t in (known, apart))
        begun = work.save(count_apart(docs, k, frequent, hot).where(F.col("n") >= least), f"apart{k}")
        known, apart = known.unionByName(begun), apart.unionByName(begun.where(F.col("n") > bound))
    frequent, hot = (_send(spark, Bitmap.of(t)) for t in (known, apart))
    grown = work.save(grow_prefixes(pointers(docs, frequent, hot, max(BUCKETS, n // HELD)), parts, least), "grown")
    return known.unionByName(grown), totals


def _send(spark: SparkSession, value: Bitmap):
    return spark.sparkContext.broadcast(value)


def _run(words: str, first: str, n: str) -> str:
    """SQL: some words of an array, joined."""
    return f"array_join(slice({words}, {first}, {n}), ' ')"


def collocations(docs: DataFrame, work: Workspace, least: int = 30, inside: int = 80, top: int = 2000, most_pointers: int | None = None) -> DataFrame:
    """Each language's strongest phrases: those of two to four words by the score of their weakest cut.

    A phrase goes when a longer candidate holds it with at least ``inside`` hundredths of its count.
    """
    frequent, totals = frequent_phrases(docs, work, least, most_pointers)
    known = work.save(frequent.select("lang", F.col("phrase").cast("string").alias("phrase"), "n"), "phrases")
    split = known.withColumn("ws", F.split("phrase", " ")).withColumn("k", F.size("ws"))
    longer = split.where("k > 2").selectExpr("lang", "n", "ws", "k", "explode(sequence(2, k - 1)) m").selectExpr("lang", "n", "ws", "m", "explode(sequence(1, k - m + 1)) i")
    covered = longer.selectExpr("lang", f"{_run('ws', 'i', 'm')} phrase", "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    candidates = split.where("k > 1").join(covered, ["lang", "phrase"], "left")
    candidates = candidates.where(f"longer is null or 100 * cast(longer as decimal(20, 0)) < {inside} * cast(n as decimal(20, 0))")
    cuts = candidates.selectExpr("lang", "phrase", "n a", "ws", "k", "explode(sequence(1, k - 1)) cut").selectExpr("lang", "phrase", "a", "cut", f"explode(array(struct(0 side, {_run('ws', '1', 'cut')} part), struct(1 side, {_run('ws', 'cut + 1', 'k - cut')} part))) p")
    parts = known.selectExpr("lang", "phrase part", "n")
    met = cuts.selectExpr("lang", "phrase", "a", "cut", "p.side", "p.part").join(parts, ["lang", "part"])
    both = met.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.expr("if(side = 0, n, null)")).alias("l"), F.max(F.expr("if(side = 1, n, null)")).alias("r"))
    weakest = both.groupBy("lang", "phrase", "a").agg(F.min(F.expr(f"struct({SCORE} score, cut, l, r)")).alias("w"))
    scored = work.save(weakest.select("lang", "phrase", "a", "w.l", "w.r", "w.score"), "scored")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")

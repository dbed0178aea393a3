"""Toxicity by a counterfactual-regularised linear classifier.

A text is described by which of its words, and which word beginnings of three to
seven characters, occur in it (hashed, once each, A-Z in lower case, punctuation
at the ends taken off). ``fit`` learns from labelled rows:

* every feature's log-odds among toxic and clean rows say how much it can tell
  (features that too few toxic rows have, tell nothing), and scale its input;
* logistic regression by Newton-like accelerated gradient steps weighs them;
* for each labelled sentence that names a group, wherever it stands in its text,
  every naming is swapped for another group's, and the first three other
  sentences of each text get a neutral mention; the squared change of the score is added to the loss, times ``fairness``. A
  mention of a group alone then moves the score little, in either direction.
  Only features that speak for toxicity get weights, so a name that leans to the
  clean side has none, and swaps with it change nothing but the other's.

Labels are read for learning from at most ``max_rows`` rows, those with the
smallest hash of the id, and of rows that share an id from one. Spark counts every feature of these rows by class; a
row then sends the features that can tell something and no others, and of its
swaps the changes in those features with how often each occurs. Scoring is one pass over the
documents, without a shuffle, with the weights of at most 2**bits features.

Defined cases: a null text is empty; an empty text gets the model's intercept;
without labelled rows, or with one class only, every score is the share of
toxic labels (0 without any); null labels don't count; a document labelled more
than once is toxic if any label says so; null and repeated ids are scored row by
row, ids of any type as they are, and of rows with one id that with the smallest hash
of its text is learned from; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, id_crc, text_of

BITS = 20
#: Toxic rows that must have a feature for it to tell something.
LEAST = 3
#: Terms that name groups of people, in the corpus' languages. A neutral mention must not count as toxic.
IDENTITY_TERMS = (
    "women", "men", "girls", "boys", "muslims", "christians", "jews", "hindus", "atheists", "immigrants", "refugees", "black", "white", "asian", "gay", "lesbian",
    "transgender", "disabled", "elderly", "femmes", "hommes", "musulmans", "juifs", "frauen", "maenner", "muslime", "juden", "mujeres", "hombres", "musulmanes", "judios",
)
_SENTENCE = re.compile(r"[.!?\n]+")
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def word_features(word: bytes, bits: int = BITS) -> tuple[int, ...]:
    """The features of one word: itself and its beginnings."""
    word = word.strip(_EDGE)
    if not word:
        return ()
    mask = (1 << bits) - 1
    text = word.decode("utf-8", "replace")
    out = [zlib.crc32(b"=" + word) & mask]
    out += [zlib.crc32(b"^" + text[:n].encode()) & mask for n in range(3, min(7, len(text)) + 1)]
    return tuple(out)


class Features:
    """The features of texts; remembers those of words, up to a bound."""

    def __init__(self, bits: int = BITS, remember: int = 100_000):
        self.bits, self.remember = bits, remember
        self.known: dict[bytes, tuple[int, ...]] = {}

    def of(self, text: str) -> np.ndarray:
        """The distinct features of a text, in order."""
        return self.of_words(text.encode("utf-8", "replace").lower().split())

    def of_words(self, words: list[bytes]) -> np.ndarray:
        """The distinct features of words in lower case, in order."""
        if len(self.known) > self.remember:
            self.known = {}
        out: set[int] = set()
        for w in set(words):
            f = self.known.get(w)
            if f is None:
                f = self.known[w] = word_features(w, self.bits)
            out.update(f)
        return np.array(sorted(out), np.int32)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(intercept + sum of weights)))."""

    intercept: float = 0.0
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bits: int = BITS
    constant: float | None = None

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.features] = self.weights
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def telling(a: np.ndarray, b: np.ndarray, toxic: int, n: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The features that can tell something, and all log-odds; a, b: how many toxic and clean rows have each feature."""
    odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (n - toxic + 1))
    # what chance alone could give is taken off
    odds = np.maximum(0, np.abs(odds) - 1.5 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))) * np.sign(odds)
    return np.flatnonzero((odds > 1.0) & (a >= least)), odds


def train(
    rows: list[np.ndarray],
    y: np.ndarray,
    pairs: list[tuple[np.ndarray, np.ndarray]],
    bits: int = BITS,
    least: int = LEAST,
    l2: float = 0.006,
    fairness: float = 4.0,
    steps: int = 300,
    times: np.ndarray | None = None,
) -> Model:
    """Fit on the features of texts. pairs: the features of a sentence and of its counterfactual; times: how often each pair occurs."""
    n, toxic = len(rows), int(y.sum())
    if n == 0 or toxic in (0, n):
        return Model(bits=bits, constant=toxic / n if n else 0.0)
    size = 1 << bits
    lengths = np.array([len(r) for r in rows])
    flat, row = np.concatenate(rows), np.repeat(np.arange(n, dtype=np.int32), lengths)
    bad = np.repeat(y == 1, lengths)
    a, b = np.bincount(flat[bad], minlength=size), np.bincount(flat[~bad], minlength=size)
    kept, odds = telling(a, b, toxic, n, least)
    number = np.full(size, -1, np.int32)
    number[kept] = np.arange(len(kept))
    scale = odds[kept]
    ok = number[flat] >= 0
    cols, row = number[flat[ok]], row[ok]
    value = scale[cols]
    # counterfactual differences, over kept features
    dc, dr, dv = [], [], []
    for i, (p, q) in enumerate(pairs):
        for f, sign in ((np.setdiff1d(q, p), 1.0), (np.setdiff1d(p, q), -1.0)):
            f = number[f]
            f = f[f >= 0]
            dc.append(f)
            dr.append(np.full(len(f), i))
            dv.append(sign * scale[f])
    dc, dr, dv = (np.concatenate(x) if x else np.zeros(0) for x in (dc, dr, dv))
    dc, dr = dc.astype(np.int64), dr.astype(np.int64)
    times = np.ones(len(pairs)) if times is None else times
    n_pairs = times.sum()
    w, c = np.zeros(len(kept)), np.log(toxic / (n - toxic))
    weight = np.where(y == 1, 0.5 * n / toxic, 0.5 * n / (n - toxic)) ** 0.5
    weight /= weight.mean()
    # accelerated gradient steps, each coordinate by a bound of its curvature
    per_row = np.bincount(row, weights=np.abs(value), minlength=n)
    bound = 0.25 * np.bincount(cols, weights=weight[row] * np.abs(value) * per_row[row], minlength=len(kept)) / n + l2
    if len(pairs):
        per_pair = np.bincount(dr, weights=np.abs(dv), minlength=len(pairs))
        bound += fairness * np.bincount(dc, weights=np.abs(dv) * (times * per_pair)[dr], minlength=len(kept)) / n_pairs
    vw, vc, t = w, c, 1.0
    for _ in range(steps):
        z = vc + np.bincount(row, weights=vw[cols] * value, minlength=n)
        e = weight * (_sigmoid(z) - y)
        g = np.bincount(cols, weights=e[row] * value, minlength=len(kept)) / n + l2 * vw
        if len(pairs):
            d = np.bincount(dr, weights=vw[dc] * dv, minlength=len(pairs))
            g += fairness * np.bincount(dc, weights=(times * d)[dr] * dv, minlength=len(kept)) / n_pairs
        nw = np.maximum(0, vw - g / (2 * bound))
        nc = vc - e.mean() / 0.5
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vc = nw + (t - 1) / s * (nw - w), nc + (t - 1) / s * (nc - c)
        w, c, t = nw, nc, s
    return Model(float(c), kept.astype(np.int32), w * scale, bits)


def counterfactuals(text: str, features: Features, terms: tuple[str, ...], most: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sentences of a text: each that names a group, and with another's name; the first ``most`` others, and with a neutral mention."""
    out, names, added = [], [t.encode() for t in terms], 0
    known = {t: i for i, t in enumerate(names)}
    for sentence in _SENTENCE.split(text):
        words = sentence.encode("utf-8", "replace").lower().split()
        bare = [w.strip(_EDGE) for w in words]
        if not known.keys().isdisjoint(bare):
            step = 1 + len(out) % max(1, len(terms) - 1)  # never round to the term itself
            swapped = [names[(known[b] + step) % len(names)] if b in known else w for w, b in zip(words, bare, strict=True)]
        elif words and added < most:
            added += 1
            swapped = [*words, names[zlib.crc32(sentence.encode("utf-8", "replace")) % len(names)]]
        else:
            continue
        out.append((features.of_words(words), features.of_words(swapped)))
    return out


def fit(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column | None = None,
    max_rows: int = 8_000,
    terms: tuple[str, ...] = IDENTITY_TERMS,
    bits: int = BITS,
    fairness: float = 4.0,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> Model:
    """Learn from the labelled rows that are not held out. ``held_out`` is a condition on doc_id."""
    marks = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    if held_out is not None:
        marks = marks.where(~held_out)
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    own = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).join(F.broadcast(marks), "doc_id")  # max_rows rows at most
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    work = Workspace(docs.sparkSession, "toxicity")
    own = work.save(own.withColumn("turn", turn).where("turn = 1").drop("turn"), "labelled")  # again max_rows rows at most, read twice

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, seen, rows = Features(bits), np.zeros((2, 1 << bits), np.int64), [0, 0]
        for batch in batches:
            for t, toxic in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                clean = int(not toxic)
                seen[clean, features.of(t.as_py())] += 1
                rows[clean] += 1
        f = np.flatnonzero(seen.any(axis=0))
        columns = [np.append(f, -1), np.append(seen[0, f], rows[0]), np.append(seen[1, f], rows[1])]  # -1: all rows
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["f", "a", "b"])

    counted = own.mapInArrow(count, "f long, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    f, a, b = (c.to_numpy() for c in counted.where(f"f = -1 or a >= {LEAST}").select("f", "a", "b").toArrow().columns)
    toxic, n = (int(a[f == -1].sum()), int((a + b)[f == -1].sum()))
    if toxic in (0, n):
        return Model(bits=bits, constant=toxic / n if n else 0.0)
    kept = np.sort(f[f >= 0][telling(a[f >= 0], b[f >= 0], toxic, n)[0]]).astype(np.int32)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        among = lambda x: np.intersect1d(x, kept, assume_unique=True).tobytes()
        for batch in batches:
            rows = []
            for t in batch.column(1):
                t = t.as_py()
                pairs = Counter((among(np.setdiff1d(p, q)), among(np.setdiff1d(q, p))) for p, q in counterfactuals(t, features, terms))
                rows.append((among(features.of(t)), [x for p in pairs for x in p], list(pairs.values())))
            x, twos, times = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [pa.array(x, pa.binary()), pa.array(twos, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64())), batch.column(2), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["x", "pairs", "times", "y", "hash"])

    own = own.select("doc_id", "text", "y", F.xxhash64("doc_id").alias("hash"))
    got = own.mapInArrow(extract, "x binary, pairs array<binary>, times array<long>, y int, hash long").toArrow()
    work.drop("labelled")
    rows, y, order, pairs = [], [], [], Counter()
    for x, twos, times, label_, i in zip(*(got.column(c) for c in range(5)), strict=True):
        x, twos = x.as_py(), twos.as_py()
        rows.append(np.frombuffer(x, np.int32))
        y.append(label_.as_py())
        for p, q, t in zip(twos[::2], twos[1::2], times.as_py(), strict=True):
            pairs[p, q] += t
        order.append((i.as_py(), zlib.crc32(x)))
    del got
    by = sorted(range(len(rows)), key=order.__getitem__)  # the same model however the rows arrive
    changes = sorted(pairs)
    both = [(np.frombuffer(p, np.int32), np.frombuffer(q, np.int32)) for p, q in changes]
    return train([rows[i] for i in by], np.array([y[i] for i in by], float), both, bits, fairness=fairness, times=np.array([pairs[c] for c in changes], float))


class Weights:
    """Scores texts; remembers words with and without a weight, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.weights = model, model.dense()
        self.telling: dict[bytes, dict[int, float]] = {}
        self.plain: set[bytes] = set()

    def total(self, text: str) -> float:
        """The sum of the weights of the text's distinct features."""
        if len(self.plain) > 150_000:
            self.plain = set()
        total: dict[int, float] = {}
        for w in set(text.encode("utf-8", "replace").lower().split()) - self.plain:
            x = self.telling.get(w)
            if x is None:
                x = {f: self.weights[f] for f in word_features(w, self.model.bits) if self.weights[f]}
                if not x:
                    self.plain.add(w)
                elif len(self.telling) < 60_000:
                    self.telling[w] = x
            total.update(x)
        return sum(total[f] for f in sorted(total))

    def score(self, texts: list[str]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        return _sigmoid(self.model.intercept + np.array([self.total(t) for t in texts], float))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model)
        for batch in batches:
            s = weights.score([t.as_py() for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    own = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, with a score below the threshold."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model)
        for batch in batches:
            scores = weights.score([t.as_py() or "" for t in batch.column(place)])
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)


def is_held_out(doc_id: Column) -> Column:
    """The fold that learning never sees."""
    return id_crc(doc_id) % 5 == 0

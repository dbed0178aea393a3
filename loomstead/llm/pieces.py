"""Sentence-piece ids of whole texts, and texts of ids, by vectorised merge rounds.

For byte-pair models with byte fallback, such as the file the queries use. A text
is cut where no piece of the model can cross, which gives words; each different
word is merged once. All words of a batch lie in flat numpy arrays of symbols. In
a round every word takes its pair of lowest rank and merges all its occurrences
at once, leftmost first; words without a pair leave the arrays. Where a merge
would make a pair that is due no later than the round's own, the word merges only
its leftmost occurrence in that round, so the order is the library's exactly.

Rows: a null text counts as empty and has no ids; very long texts are cut into
words like others (a word may be as long as its text); repeated rows each give a
row; an empty table gives none; only the named columns are read, so other columns
can't clash; ids of rows keep their type. Decoding a null list gives the empty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
NEVER = np.iinfo(np.int32).max
#: Words that a Python worker remembers between batches.
REMEMBERED = 300_000
#: Characters that are encoded at once; a longer text is taken alone.
AT_ONCE = 2_000_000
SLOT_BITS = 20


def default_path() -> str:
    """The model file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _flat(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of a flat table one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return table[np.repeat(starts - ends + lengths, lengths) + np.arange(total)]


def _slot(key: np.ndarray) -> np.ndarray:
    """A pair's slot in the table of pairs: the upper bits of its key times an odd number."""
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _upto(lengths: np.ndarray) -> np.ndarray:
    """Where each stretch starts, and the end of the last."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


class Pieces:
    """A sentence-piece model as arrays."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
        plain = not rules.precompiled_charsmap and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        odd = any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or not plain or odd:
            raise ValueError("a byte-pair model with byte fallback, without normalisation and without user-defined or unused pieces is needed")
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self._pieces(model.pieces, kinds)
        self._pairs([(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL])
        self._cuts([p.piece for p in model.pieces if p.type == kinds.NORMAL and len(p.piece) > 1])
        self.forget()

    def _pieces(self, pieces: Sequence, kinds) -> None:
        """What each id stands for as bytes, and the ids of single bytes."""
        spelled, self.byte_ids = [], np.zeros(256, np.int32)
        self.is_byte = np.array([p.type == kinds.BYTE for p in pieces])
        self.spaced = np.array([p.type == kinds.NORMAL and p.piece.startswith(SPACE) for p in pieces])
        for i, p in enumerate(pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value] = i
                spelled.append(bytes([value]))
            elif p.type == kinds.CONTROL:
                spelled.append(b"")
            elif p.type == kinds.UNKNOWN:
                spelled.append(" ⁇ ".encode())
            else:
                spelled.append(p.piece.replace(SPACE, " ").encode())
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_length = np.array([len(s) for s in spelled], np.int64)
        self.spelled_at = _upto(self.spelled_length)[:-1]

    def _pairs(self, normal: list[tuple[int, str, float]]) -> None:
        """Symbols are pieces and the characters in them; a table says what two of them make, and its rank."""
        symbol = {piece: i for i, (_, piece, _) in enumerate(normal)}
        for _, piece, _ in normal:
            for c in piece:
                symbol.setdefault(c, len(symbol))
        self.id_of = np.full(len(symbol), -1, np.int32)
        self.id_of[: len(normal)] = [i for i, _, _ in normal]
        ranks = {score: r for r, score in enumerate(sorted({s for _, _, s in normal}, reverse=True))}
        self.width = len(symbol)
        made = []
        for i, (_, piece, score) in enumerate(normal):
            for cut in range(1, len(piece)):
                a, b = symbol.get(piece[:cut]), symbol.get(piece[cut:])
                if a is not None and b is not None:
                    made.append((a * self.width + b, ranks[score], i))
        made.sort()
        self.pair_keys = np.array([m[0] for m in made] or [-1], np.int64)
        self.pair_ranks = np.array([m[1] for m in made] or [NEVER], np.int32)
        self.pair_makes = np.array([m[2] for m in made] or [-1], np.int32)
        slot = _slot(self.pair_keys)
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)
        self.slots[slot] = np.where(np.bincount(slot)[slot] > 1, -1, np.arange(len(slot)))  # below 0: several pairs share the slot
        chars = sorted((ord(c), s) for c, s in symbol.items() if len(c) == 1)
        self.symbol_of = np.full(0x110000, -1, np.int32)
        self.symbol_of[[c for c, _ in chars]] = [s for _, s in chars]

    def _cuts(self, long: list[str]) -> None:
        """The expression that cuts texts into words: before spaces that follow something else, and around ASCII characters that only stand alone."""
        inside = set("".join(long))
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inside)
        crossing = any(SPACE in p.lstrip(SPACE) for p in long)
        self.words = re.compile(r"(?s).+" if crossing else rf"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def forget(self) -> None:
        """Start a new memory of words."""
        self.index: dict[str, int] = {}
        self.known = np.zeros(0, np.int32)
        self.known_at, self.known_length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of pairs of symbols; symbols below 0 pair with nothing."""
        key = a.astype(np.int64) * self.width + b
        at = self.slots[_slot(key)]
        shared = np.flatnonzero(at < 0)
        at[shared] = np.minimum(np.searchsorted(self.pair_keys, key[shared]), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(found, self.pair_ranks[at], NEVER), self.pair_makes[at]

    def merge(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words: flat ids, and how many each word has."""
        char = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        symbol, first = self.symbol_of[char], np.arange(len(char))
        done = []
        rank, makes = self._ranks(symbol, word)
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            ready = lowest == NEVER
            if ready.any():  # words without a pair leave
                done.append((word[ready], symbol[ready], first[ready]))
                word, symbol, first, rank, makes, lowest = (x[~ready] for x in (word, symbol, first, rank, makes, lowest))
                continue
            due = rank == lowest
            begins = due & ~np.r_[False, due[:-1]]
            run = np.maximum.accumulate(np.where(begins, np.arange(len(due)), 0))
            at = np.flatnonzero(due & ((np.arange(len(due)) - run) % 2 == 0))
            at = self._in_order(at, symbol, word, makes, lowest)
            symbol[at] = makes[at]
            kept = np.ones(len(symbol), bool)
            kept[at + 1] = False
            at -= np.arange(len(at))  # where the merged symbols are without those before them that go
            word, symbol, first, rank, makes = (x[kept] for x in (word, symbol, first, rank, makes))
            near = np.r_[at, at[at > 0] - 1]
            rank[near], makes[near] = self._ranks(symbol, word, near)
        return self._ids(done, char, len(words))

    def _ranks(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each symbol with the next of its word."""
        at = np.arange(len(symbol)) if at is None else at
        after = np.minimum(at + 1, len(symbol) - 1)
        rank, makes = self._look(symbol[at], symbol[after])
        return np.where((after > at) & (word[after] == word[at]), rank, NEVER).astype(np.int32), makes

    def _in_order(self, at: np.ndarray, symbol: np.ndarray, word: np.ndarray, makes: np.ndarray, lowest: np.ndarray) -> np.ndarray:
        """The merges that can be done at once: where one makes a pair that is due now, its word keeps the leftmost alone."""
        several = np.r_[False, word[at[1:]] == word[at[:-1]]]
        if not several.any():
            return at
        merged = np.full(len(symbol), -2, np.int32)  # what stands at a place after all merges, seen from either side
        merged[at] = merged[at + 1] = makes[at]
        early = np.zeros(len(at), bool)
        for step, edge in ((-1, at - 1), (1, at + 2)):
            inside = (edge >= 0) & (edge < len(symbol))
            edge = np.clip(edge, 0, len(symbol) - 1)
            inside &= word[edge] == word[at]
            for other in (symbol[edge], merged[edge]):
                pair = (other, makes[at]) if step < 0 else (makes[at], other)
                early |= inside & (self._look(*pair)[0] <= lowest[at])
        careful = np.zeros(word[-1] + 1, bool)
        careful[word[at[early]]] = True
        return at[~(several & careful[word[at]])]

    def _ids(self, done: list, char: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids in the words' order; a character without a piece becomes its bytes."""
        if not done:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        word, symbol, first = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(first, kind="stable")
        word, symbol, first = word[order], symbol[order], first[order]
        ids = np.where(symbol >= 0, self.id_of[symbol], -1)
        unknown = np.flatnonzero(ids < 0)
        size = np.ones(len(ids), np.int64)
        if len(unknown):
            raw = [chr(c).encode() for c in char[first[unknown]]]
            size[unknown] = [len(r) for r in raw]
            out = np.repeat(ids, size)
            out[np.repeat(ids < 0, size)] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            ids = out
        return ids.astype(np.int32), np.bincount(np.repeat(word, size), minlength=n)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts: flat ids, and where each text's start, with the end of the last."""
        if len(self.index) > REMEMBERED:
            self.forget()
        cut = [self.words.findall(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        flat = [w for ws in cut for w in ws]
        new = list(set(flat) - self.index.keys())
        if new:
            ids, lengths = self.merge(new)
            self.known_at = np.r_[self.known_at, len(self.known) + _upto(lengths)[:-1]]
            self.known, self.known_length = np.r_[self.known, ids], np.r_[self.known_length, lengths]
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        which = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        lengths = self.known_length[which]
        return _flat(self.known, self.known_at[which], lengths), _upto(lengths)[_upto(np.array([len(ws) for ws in cut], np.int64))]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The texts of ids, of which those from starts[i] to starts[i + 1] are one text's."""
        lengths = self.spelled_length[ids]
        raw = _flat(self.spelled, self.spelled_at[ids], lengths)
        at = _upto(lengths)[starts]
        parted = _upto(lengths == 0)[starts]  # what stands for nothing keeps bytes on either side apart
        out, whole = [], raw.tobytes()
        for i in range(len(starts) - 1):
            own = whole[at[i] : at[i + 1]]
            if parted[i + 1] > parted[i]:
                out.append(self._broken(ids[starts[i] : starts[i + 1]]))
                continue
            if self.prefix and own and self.spaced[ids[starts[i]]]:
                own = own[1:]
            try:
                out.append(own.decode())
            except UnicodeDecodeError:
                out.append(self._broken(ids[starts[i] : starts[i + 1]]))
        return out

    def _broken(self, ids: np.ndarray) -> str:
        """The text of ids whose bytes aren't all UTF-8: each byte that no character takes becomes U+FFFD."""
        out, i, begun = [], 0, False
        while i < len(ids):
            end = i
            while end < len(ids) and self.is_byte[ids[end]]:
                end += 1
            own = bytes(self.spelled[self.spelled_at[ids[i:end]]])
            while own:
                size = next((k for k in range(1, min(4, len(own)) + 1) if _valid(own[:k])), 0)
                out.append(own[:size].decode() if size else "�")
                own = own[max(size, 1) :]
            begun |= end > i
            if end == i:
                piece = bytes(self.spelled[self.spelled_at[ids[i]] : self.spelled_at[ids[i]] + self.spelled_length[ids[i]]]).decode()
                out.append(piece[1:] if self.prefix and not begun and self.spaced[ids[i]] else piece)
                begun |= bool(piece)
                end += 1
            i = end
        return "".join(out)


def _valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(maxsize=2)
def _loaded(path: str) -> Pieces:
    """The model, once for each Python worker."""
    return Pieces(path)


def _groups(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Stretches of rows that hold AT_ONCE characters at most, or one row."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > AT_ONCE:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """The ids of every row's whole text as an array; with ``decoded`` also the text that these ids give."""
    path, fields = path or default_path(), [T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in _groups([len(t or "") for t in texts]):
                ids, starts = model.encode(texts[begin:end])
                columns = [batch.column(0).slice(begin, end - begin), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))]
                if decoded:
                    columns.append(pa.array(model.decode(ids, starts), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[key, "ids", "decoded"][: len(columns)])

    schema = T.StructType([*fields, T.StructField("decoded", T.StringType())] if decoded else fields)
    return docs.select(key, text).mapInArrow(run, schema)


def decode_documents(coded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The text of every row's ids."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(path)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            for begin, end in _groups([len(r or ()) for r in rows]):
                own = [np.array(r or (), np.int64) for r in rows[begin:end]]
                texts = model.decode(np.concatenate(own), _upto(np.array([len(r) for r in own], np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(texts, pa.string())], names=[key, "decoded"])

    return coded.select(key, ids).mapInArrow(run, T.StructType([T.StructField(key, coded.schema[key].dataType), T.StructField("decoded", T.StringType())]))


def joined(ids: Column) -> Column:
    """Ids as decimal numbers with commas between them."""
    return F.array_join(ids.cast("array<string>"), ",")

"""Many patterns and plain terms found in one pass over a text.

All terms become one expression in the form of a trie. It looks ahead at every
place, takes the longest term there, and what else begins there are that term's
own beginnings, so terms that overlap or hold each other are all found. Regular
expressions join in by the plain parts they can't do without: only where one of
those occurs does the expression itself look at the text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import Lexicon
from .names import let

#: Capitals and letters beyond ASCII that a pattern without regard to case takes for a plain letter.
_FOLDED = ("İıſK", "iisk")


def fold(text: Column) -> Column:
    """Lower case, so that whatever a pattern takes for an ASCII letter is that letter."""
    return F.lower(F.translate(text, *_FOLDED))


def plain_words(pattern: str) -> str:
    """A pattern whose word boundaries take ASCII letters, digits and the underscore for parts of words, nothing else.

    Before Java 19 a boundary takes all letters; here "\\btest\\b" is in "testü", as it is for engines with plain boundaries.
    """

    def bound(m: re.Match) -> str:
        if m[0] != r"\b":
            return m[0]
        before, after = pattern[: m.start()], pattern[m.end() :]
        if re.match("[A-Za-z0-9_](?![*?{])", after):
            return r"(?<!\w)"
        if re.search(r"(?<!\\)[A-Za-z0-9_]$", before) and not re.search(r"\[[^\]]*$", before):
            return r"(?!\w)"
        return r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

    return re.sub(r"\\.", bound, pattern, flags=re.S)


def required(pattern: str) -> frozenset[str]:
    """Plain parts, in lower case, of which every match of a pattern holds one at least; nothing if there are none to tell."""
    return frozenset(_parts(re._parser.parse(pattern, re.I)) or ())


def required_each(pattern: str, least: int = 2) -> list[frozenset[str]]:
    """Several sets of plain parts of at least some length; every match of a pattern holds one part of each set."""
    return [frozenset(c) for c in {frozenset(c) for c in _choices(re._parser.parse(pattern, re.I))} if min(map(len, c)) >= least]


def _parts(items) -> set[str] | None:
    """The best parts of a sequence: those whose shortest is the longest."""
    best = max(_choices(items), key=lambda c: (min(map(len, c)), -len(c)))
    return best if min(map(len, best)) else None


def _choices(items) -> list[set[str]]:
    """Sets of parts of a sequence, of each of which a match has one; an empty part stands for anything."""
    choices: list[set[str]] = []
    run: list = []  # the plain letters up to here
    for op, arg in items:
        kind = str(op)
        letter = _letter(kind, arg)
        if letter:
            run.append(letter)
            continue
        if kind == "AT":
            continue
        inner = None
        if kind == "SUBPATTERN":
            inner = _parts([*run, *arg[3]])
        elif kind == "BRANCH":
            each = [_parts([*run, *b]) for b in arg[1]]
            inner = set().union(*each) if all(each) else None
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            inner = _parts(arg[2])
        elif kind == "ATOMIC_GROUP":
            inner = _parts(arg)
        choices += [{_spelled(run)}, inner or {""}]
        run = []
    choices.append({_spelled(run)})
    return choices


def _letter(kind: str, arg) -> tuple | None:
    """A plain letter, or a set that has one letter in both cases."""
    if kind == "LITERAL":
        return kind, arg
    if kind == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len({chr(c).lower() for _, c in arg}) == 1:
        return "LITERAL", arg[0][1]
    return None


def _spelled(run: Sequence[tuple]) -> str:
    return "".join(chr(c).lower() for _, c in run)


#: A boundary of plain words.
BOUND = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: Letters beyond ASCII that engines with plain words take for a letter where case doesn't matter.
_ALSO = {"s": r"\x{17f}", "k": r"\x{212a}"}


def _pieces(pattern: str) -> list[str]:
    """A pattern's escapes, classes and characters."""
    return re.findall(r"\\.|\[(?:\\.|[^\]])*\]|.", pattern, re.S)


def plain_case(pattern: str) -> str:
    """A pattern for use without regard to ASCII case whose words and letters are those of engines with plain words: "ſ" and the Kelvin sign are letters of a match, but of no word."""
    own = _pieces(pattern)

    def bound(i: int) -> str:
        if i + 1 < len(own) and re.fullmatch("[A-Za-z0-9_]", own[i + 1]) and own[i + 1] not in "sSkK" and own[i + 2 : i + 3] not in (["*"], ["?"], ["{"]):
            return r"(?<!\w)"
        if i and re.fullmatch("[A-Za-z0-9_]", own[i - 1]) and own[i - 1] not in "sSkK":
            return r"(?!\w)"
        return BOUND

    def letter(x: str) -> str:
        also = "".join(a for c, a in _ALSO.items() if re.fullmatch(x, c, re.I)) if x[0] == "[" and x[1] != "^" else _ALSO.get(x.lower(), "")
        return x if not also else f"{x[:-1]}{also}]" if x[0] == "[" else f"[{x}{also}]"

    return "".join(bound(i) if x == r"\b" else x if x[0] == "\\" else letter(x) for i, x in enumerate(own))


def reach(pattern: str) -> int:
    """The most characters that a match depends on from where it begins, what it looks ahead at and the one behind it included."""
    return re._parser.parse(re.sub(r"\(\?[=!]", "(?:", pattern)).getwidth()[1] + 1


def alternatives(pattern: str) -> list[str]:
    """A pattern's parts between its outermost bars."""
    out, depth = [""], 0
    for x in _pieces(pattern):
        depth += (x == "(") - (x == ")")
        out = [*out, ""] if x == "|" and not depth else [*out[:-1], out[-1] + x]
    return out


def lead(pattern: str) -> tuple[str, str]:
    """The plain letters and digits, in lower case, with which a pattern for a word begins, and the rest of it."""
    if not pattern.startswith(r"\b"):
        raise ValueError(f"not the beginning of a word: {pattern}")
    plain = re.match(r"(?:[A-Za-z0-9](?![*?{]))*", pattern[2:])[0]
    return plain.lower(), pattern[2 + len(plain) :]


def inside(pattern: str) -> list[tuple[str, str]]:
    """(before, part): where a pattern is a choice and one part is the end of another, that part right behind what the other has before it lies inside the other's match and is none of its own."""
    choice = re.fullmatch(r"\\b\((.*)\)\\b", pattern)
    parts = alternatives(choice[1]) if choice else []
    return [(a[: -len(b)], b) for a in parts for b in parts if a != b and a.endswith(b)]


def trie_of(patterns: Iterable[str]) -> str:
    """An expression, without regard to case, for any of some patterns behind the beginning of a word; what they begin with is looked at once."""

    def together(leads: list[tuple[str, str, str]]) -> str:
        below: dict[str, list] = {}
        for letters, before, rest in leads:
            below.setdefault(letters[:1], []).append((letters[1:], before + letters[:1], rest))
        out = []
        for c, own in below.items():
            if c:
                out.append(plain_case(c) + together(own))
            else:  # a bound right behind the letters depends on the last of them
                out += [plain_case(before[-1:] + rest)[len(plain_case(before[-1:])) :] for _, before, rest in own]
        return out[0] if len(out) == 1 else f"(?:{'|'.join(out)})"

    each = {lead(a) for p in patterns for a in alternatives(p)}
    return f"(?i:{together([(letters, '', rest) for letters, rest in sorted(each)])})"


def trie(terms: Iterable[str]) -> str:
    """An expression for the longest of some terms at a place."""
    root: dict = {}
    for t in sorted(set(terms)):
        at = root
        for c in t:
            at = at.setdefault(c, {})
        at[""] = {}

    def written(node: dict) -> str:
        branches = []
        for c, below in node.items():
            if not c:
                continue
            part = c if c.isalnum() and c.isascii() else "\\x{%x}" % ord(c)
            while len(below) == 1 and "" not in below:
                ((c, below),) = below.items()
                part += c if c.isalnum() and c.isascii() else "\\x{%x}" % ord(c)
            branches.append(part + (written(below) if set(below) != {""} else ""))
        body = branches[0] if len(branches) == 1 else "|".join(branches)
        return f"(?:{body})?" if "" in node else f"(?:{body})"

    return written(root)


def beginnings(terms: Iterable[str]) -> dict[str, list[str]]:
    """Each term with the terms that it begins with, itself included, in order."""
    own = sorted(set(terms))
    return {t: [b for b in own if t.startswith(b)] for t in own}


def found_terms(text: Column, terms: Sequence[str]) -> Column:
    """The terms (in lower case) that a text holds, by their first place and then alphabetically; the text is read once."""
    own = beginnings(t.lower() for t in terms)
    if not own:
        return F.array().cast("array<string>")
    hits = F.array_distinct(F.regexp_extract_all(fold(text), F.lit(f"(?=({trie(own)}))"), 1))
    several = {t: b for t, b in own.items() if len(b) > 1}
    if several:
        table = F.create_map(*[x for t, b in several.items() for x in (F.lit(t), F.array(*map(F.lit, b)))])
        hits = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.coalesce(F.try_element_at(table, h), F.array(h)))))
    return hits


def holds_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether a text holds one of some plain terms, whatever its case."""
    return F.coalesce(fold(text).rlike(trie(t.lower() for t in terms)), F.lit(False))


#: A pattern of a lexicon as a row: whose it is, what it stands for, and its plain parts.
ENTRY = "struct<field:string,label:string,pattern:string,parts:array<string>>"


class Lexicons:
    """Ordered lists of (pattern, label) by field, and plain terms, looked for together.

    ``found`` is a column with what ``terms_in`` gives; put it into a table's own
    column first, and what ``hits`` gives into another, so that each is made once
    however many labels ask for it. The lists travel as one array, so a plan has
    the same size however long they are.
    """

    def __init__(self, lists: Mapping[str, Lexicon], terms: Iterable[str] = ()):
        self.rows = [{"field": f, "label": label, "pattern": f"(?iu){p}", "parts": sorted(required(p))} for f, rows in lists.items() for p, label in rows]
        self.terms = sorted({t.lower() for t in terms}.union(*[r["parts"] for r in self.rows]))

    def terms_in(self, text: Column) -> Column:
        return found_terms(text, self.terms)

    def entries(self, found: Column) -> Column:
        """The patterns that may occur: one of their plain parts does, or they have none."""
        rows = F.from_json(F.lit(json.dumps(self.rows)), f"array<{ENTRY}>")
        return let(found, lambda own: F.filter(rows, lambda r: (F.size(r["parts"]) == 0) | F.arrays_overlap(own, r["parts"])))

    def hits(self, found: Column, text: Column) -> Column:
        """(field, label) of the patterns that occur, in their lists' order."""
        there = F.filter(self.entries(found), lambda r: F.rlike(text, r["pattern"]))
        return F.coalesce(F.transform(there, lambda r: F.struct(r["field"].alias("field"), r["label"].alias("label"))), F.array().cast("array<struct<field:string,label:string>>"))

    @staticmethod
    def labels(hits: Column, field: str) -> Column:
        """All labels of a field, each once."""
        return F.array_distinct(F.transform(F.filter(hits, lambda h: h["field"] == field), lambda h: h["label"]))

    @staticmethod
    def first(hits: Column, field: str, default: str | None = None) -> Column:
        """A field's first label."""
        return F.coalesce(F.get(F.filter(hits, lambda h: h["field"] == field), F.lit(0))["label"], F.lit(default))

    @staticmethod
    def any(hits: Column, field: str) -> Column:
        """Whether a field has a label."""
        return F.exists(hits, lambda h: h["field"] == field)


def has(found: Column, *terms: str) -> Column:
    """Whether one of some terms is among those found."""
    return F.coalesce(F.arrays_overlap(found, F.array(*[F.lit(t.lower()) for t in terms])), F.lit(False))


def in_order(found: Column, terms: Sequence[str]) -> Column:
    """Those of some terms that were found, as they are given, by their first place."""
    names = F.create_map(*[x for t in dict.fromkeys(terms) for x in (F.lit(t.lower()), F.lit(t))])
    return F.filter(F.transform(found, lambda x: F.try_element_at(names, x)), lambda x: x.isNotNull())

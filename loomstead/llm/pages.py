"""Main text of web pages by consensus host paths.

Each page is read into blocks of text and the containers around them. HTML's own
elements for what no article consists of (menus, headers, footers, sidebars,
dialogs, form controls, scripts, styles) and such roles are left out. Elements
whose class or id says so (adverts, notices, reader comments ...) and forms are
left out unless they are what holds the page: a form around other parts of a
page, or around half of its text, counts as no form, a marked element around the
main part as not marked, and where nothing else would be left, marks don't count.

The page then proposes a container: from the outermost one down, as long as a
single inner container holds most of the text. A container is named by its path
of tags and classes, with digits generalised; paths are told apart by chained
hashes, so deep nesting takes no more than one entry for each element.

The pages of a host vote on paths in Spark, and every page is extracted again
from the path that its host prefers among those it has; a page that has none of
them, or no host, keeps its own proposal. Every path counts, however few pages
vote for it: pages that have the same paths are one candidate list, whose paths
meet the host's votes by key, so no list of a host's paths exists. A short article beside a long box of
unknown kind is found that way, since the other pages of its host outvote it.
Pages without a host take part in no join.

Blocks are joined in page order by two line feeds; character references are
decoded, and white space inside a block (line breaks too) becomes one space.

Defined cases: null html is empty, and a page without text gets an empty text;
null and repeated page ids are kept row by row, ids of any type as they are; broken
markup, also one that ends within a tag, is read as far as it goes; an empty
table works; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_module
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, text_of
from .urls import host_of

#: HTML's own names.
CONTAINERS = frozenset("html body main article section div td center blockquote form".split())
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre table tbody thead tfoot tr th caption figure figcaption hr address details summary fieldset hgroup legend".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style template iframe title textarea".split())
#: Elements that are never the article's text, with all they hold.
OUTSIDE = frozenset("nav header footer aside head button dialog menu label select".split())
#: Elements inside a line of text: left out, they don't break it.
INLINE = frozenset("a abbr b bdi bdo big button cite code data del dfn em font i ins kbd label mark q s samp select small span strong sub sup time tt u var".split())
IN_HEAD = frozenset("title meta link script style base noscript template head html".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: What class and id names call such elements: as their last part ...
LAST = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsors promo promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside widget widgets header masthead footer comment comments commentlist disqus reply replies respond share sharing social "
    "related recommended newsletter subscribe subscription signup login search form pagination pager toolbar skip".split()
)
#: ... or as their first part.
FIRST = frozenset(
    "ad ads advert advertisement adsense sponsored promo cookie cookies gdpr newsletter breadcrumb breadcrumbs related recommended disqus comment comments commentlist share sharing social subscribe".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Parts that say nothing about the kind, parts by which a name tells of another element, and parts that make a header the article's own.
NEUTRAL = frozenset("bar box list area wrap wrapper container block inner outer left right top bottom slot item items link links button buttons section group panel content row col column main".split())
TELLS = frozenset("with has have no not without hide show hides shows is enabled disabled".split())
OWN_HEADER = frozenset("article post entry content page story section card title text body".split())
_VALUE = r"(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+"
_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+" + _VALUE + r"|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PARTS = re.compile(r"[a-z]+")
SHARE = 0.6


def marked(names: str) -> str:
    """Whether class or id names call an element a part outside the article: "", "mark", or "comments"."""
    for name in names.split():
        parts = _PARTS.findall(_CAMEL.sub("-", name).lower())
        if not parts or not TELLS.isdisjoint(parts):
            continue
        core = [p for p in parts if p not in NEUTRAL]
        if not core or (core[-1] == "header" and not OWN_HEADER.isdisjoint(parts)):
            continue
        if core[-1] in LAST or core[0] in FIRST or name.lower() == "side":
            return "comments" if not COMMENTS.isdisjoint(parts) else "mark"
    return ""


@dataclass
class Guard:
    """A form or marked element: perhaps outside the article."""

    parent: int
    kind: str
    holds: bool = False  # parts of a page that such an element hasn't


@dataclass
class Page:
    """Containers (parent, step and hash of the path) and the blocks in page order (container, text, linked characters, guard)."""

    parents: list[int] = field(default_factory=lambda: [0])
    steps: list[str] = field(default_factory=lambda: [""])
    marks: list[bytes] = field(default_factory=lambda: [hashlib.md5(b"").digest()])
    blocks: list[tuple[int, str, int, int]] = field(default_factory=list)
    guards: list[Guard] = field(default_factory=list)

    def settle(self) -> None:
        """Leave out the blocks of guards that hold."""
        weight = [0] * len(self.guards)
        for _, text, linked, g in self.blocks:
            if g >= 0:
                weight[g] += max(1, len(text) - linked)
        for g in reversed(range(len(self.guards))):
            if self.guards[g].parent >= 0:
                weight[self.guards[g].parent] += weight[g]
        everything = sum(max(1, len(text) - linked) for _, text, linked, _ in self.blocks)

        def kept(marks: bool) -> list[tuple[int, str, int, int]]:
            out = []
            for g, w in zip(self.guards, weight, strict=True):
                drops = not g.holds and (2 * w < everything if g.kind == "form" else marks)
                out.append(drops or (g.parent >= 0 and out[g.parent]))
            return [b for b in self.blocks if b[3] < 0 or not out[b[3]]]

        self.blocks = kept(True) or kept(False)

    def totals(self) -> list[int]:
        """Characters of unlinked text in each container with all it holds."""
        out = [0] * len(self.parents)
        for c, text, linked, _ in self.blocks:
            out[c] += max(0, len(text) - linked)
        for c in reversed(range(1, len(out))):  # a container comes after the one that holds it
            out[self.parents[c]] += out[c]
        return out

    def propose(self) -> int:
        """The container that holds the article, by this page alone."""
        totals, at = self.totals(), 0
        inner: dict[int, list[int]] = {}
        for c, p in enumerate(self.parents):
            if c:
                inner.setdefault(p, []).append(c)
        while (best := max(inner.get(at, ()), key=lambda c: totals[c], default=None)) is not None and totals[best] > 0 and totals[best] >= SHARE * totals[at]:
            at = best
        return at

    def path(self, at: int) -> str:
        """A container's path."""
        steps = []
        while at:
            steps.append(self.steps[at])
            at = self.parents[at]
        return "".join("/" + x for x in reversed(steps))

    def candidates(self) -> list[bytes]:
        """The marks of the containers with text, in order."""
        full = [False] * len(self.parents)
        for c, _, _, _ in self.blocks:
            full[c] = True
        for c in reversed(range(1, len(full))):
            full[self.parents[c]] |= full[c]
        return sorted({m for m, f in zip(self.marks, full, strict=True) if f})

    def text(self, chosen: set[int]) -> str:
        """The blocks inside the chosen containers."""
        inside = [False] * len(self.parents)
        for c, p in enumerate(self.parents):
            inside[c] = c in chosen or (c > 0 and inside[p])
        return "\n\n".join(t for c, t, _, _ in self.blocks if inside[c])


def _attributes(raw: str) -> tuple[bool, str, str]:
    """Whether the role is outside the article; what class and id call the element; its generalised class."""
    role, call, kind = False, "", ""
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), a or b or c
        if name == "role":
            role = value.strip().lower() in ROLES
        elif name in ("class", "id"):
            call = call or marked(value)
            if name == "class":
                kind = ".".join(sorted(set(re.sub(r"\d+", "#", value.lower()).split())))
    return role, call, kind


def read(html: str) -> Page:
    """Read a page."""
    page = Page()
    #: open elements: tag, container index, whether outside the article, innermost guard
    stack: list[tuple[str, int, bool, int]] = [("", 0, False, -1)]
    opened: Counter[str] = Counter()
    pending: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if pending:
            text = " ".join(html_module.unescape("".join(pending)).split())
            if text:
                page.blocks.append((stack[-1][1], text, linked, stack[-1][3]))
            pending.clear()
        linked = 0

    def close(tag: str) -> None:
        """Close the innermost open element of this tag, and all that is open in it."""
        while opened[tag]:
            top = stack.pop()[0]
            opened[top] -= 1
            if top == tag:
                return

    def holds(tag: str, call: str) -> None:
        """Tell the guards around a part of a page that they hold it; stops at one that knows already."""
        g = stack[-1][3]
        while g >= 0:
            guard = page.guards[g]
            if tag == "main" or guard.kind == "form" or (tag == "article" and guard.kind == "mark" and not call):
                if guard.holds:
                    return
                guard.holds = True
            g = guard.parent

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        end = m.start() if m else n
        if end > at and not stack[-1][2]:
            pending.append(html[at:end])
            if links:
                linked += end - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        block = (tag in CONTAINERS or tag in BREAKS or tag in OUTSIDE) and tag not in INLINE
        if m[1]:  # an end tag
            if tag == "a":
                links = max(0, links - 1)
            if block or (opened[tag] and tag not in INLINE):
                flush()
            close(tag)
            continue
        if opened["head"] and tag not in IN_HEAD:
            close("head")
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            if not m[0].endswith("/>") and (end or tag in ("script", "style")):
                at = end.end() if end else n
            continue
        if tag == "br":
            pending.append(" ")
            continue
        if tag == "a":
            links += 1
        role, call, kind = _attributes(m[3]) if m[3] else (False, "", "")
        whole = tag in ("main", "body", "html")
        outside = (tag in OUTSIDE or role) and not whole
        if tag == "article" or (tag == "header" and (opened["article"] or opened["main"] or opened["section"])):
            outside = False  # also an article's own heading
        if whole or (tag == "article" and call != "comments") or (tag == "header" and not outside):
            call = ""
        if call and tag in INLINE:
            outside, call = True, ""
        if not block and not outside and not call:
            continue
        if call and not block:  # an element of unknown kind
            flush()
        if block:
            flush()
            links = 0
            close("label")
            close("select")
            # what an opening block ends by itself
            if stack[-1][0] == "p" or (tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1][0] in ("li", "dt", "dd", "td", "th") and (stack[-1][0] == tag or tag == "tr")):
                opened[stack.pop()[0]] -= 1
        if tag in VOID or m[0].endswith("/>"):
            continue
        _, container, out, guard = stack[-1]
        if not (out or outside):
            if tag in ("main", "article", "nav", "header", "footer", "section", "h1"):
                holds(tag, call)
            if tag == "form" or call:
                page.guards.append(Guard(guard, "form" if tag == "form" else call))
                guard = len(page.guards) - 1
            if tag in CONTAINERS:
                step = tag + (f".{kind}" if kind else "")
                page.parents.append(container)
                page.steps.append(step)
                page.marks.append(hashlib.md5(page.marks[container] + step.encode("utf-8", "replace")).digest())
                container = len(page.parents) - 1
        elif tag in ("nav", "header", "footer") and not out:
            holds(tag, call)
        stack.append((tag, container, out or outside, guard))
        opened[tag] += 1
    flush()
    page.settle()
    return page


def preferred(pages: DataFrame, work: Workspace) -> DataFrame:
    """host, key (of a list of candidates), path and mark: which of the candidates most pages of the host vote for, the first path on ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h in batch.column(1):
                page = read(h.as_py())
                own, i = page.candidates(), page.propose()
                rows.append((_key(own), page.marks[i], page.path(i), own) if page.blocks else (b"", None, None, []))
            key, mark, path, own = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [batch.column(0), pa.array(key, pa.binary()), pa.array(mark, pa.binary()), pa.array(path, pa.string()), pa.array(own, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "key", "mark", "path", "candidates"])

    votes = pages.where("host is not null").select("host", "html").mapInArrow(run, "host string, key binary, mark binary, path string, candidates array<binary>").where("path is not null")
    votes = work.save(votes.groupBy("host", "key", "mark").agg(F.count(F.lit(1)).alias("n"), F.first("path").alias("path"), F.first("candidates").alias("candidates")), "votes")
    counted = votes.groupBy("host", "mark").agg(F.sum("n").alias("n"), F.first("path").alias("path"))
    lists = votes.groupBy("host", "key").agg(F.first("candidates").alias("candidates"))
    each = lists.select("host", "key", F.explode("candidates").alias("mark")).join(counted, ["host", "mark"])
    best = each.groupBy("host", "key").agg(F.min(F.struct((-F.col("n")).alias("n"), "path", "mark")).alias("best"))
    return work.finish(best.select("host", "key", "best.path", "best.mark"), "preferred")


def _key(candidates: list[bytes]) -> bytes:
    return hashlib.md5(b"".join(candidates)).digest()


PARSED = "host string, key binary, own int, own_path string, marks binary, parents array<int>, at array<int>, texts array<string>"


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and path (the one used) of every page."""
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), text_of(html).alias("html"))
    kind = own.schema["page_id"].dataType
    best = preferred(own, Workspace(pages.sparkSession, "pages"))
    arrow = {"binary": pa.binary(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = zip(*(c.split() for c in PARSED.split(", ")[1:]), strict=True)
        for batch in batches:
            rows = []
            for h in batch.column(3):
                page = read(h.as_py())
                i = page.propose()
                rows.append((_key(page.candidates()), i, page.path(i), b"".join(page.marks), page.parents, [b[0] for b in page.blocks], [b[1] for b in page.blocks]))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            columns = [*batch.columns[:3], *(pa.array(c, arrow[t]) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", *names])

    # a page without a host gets one that no vote has, another for each page, so that they don't meet in one task
    none = F.concat(F.lit("\0"), F.xxhash64("url", "html").cast("string"))
    parsed = own.select("page_id", "url", F.coalesce("host", none).alias("host"), "html").mapInArrow(parse, f"page_id {kind.simpleString()}, url string, {PARSED}")
    joined = parsed.join(best, ["host", "key"], "left").select("page_id", "url", "own", "own_path", "marks", "parents", "at", "texts", "path", "mark")
    names = ["page_id", "url", "text", "n_chars", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, used = [], []
            for own, own_path, marks, parents, at, parts, path, mark in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                page = Page(parents, [], [], [(c, t, 0, -1) for c, t in zip(at, parts, strict=True)])
                if mark is None:  # the own proposal, and all containers of its path
                    path, mark = own_path, marks[16 * own : 16 * own + 16]
                text = page.text({i for i in range(len(parents)) if marks[16 * i : 16 * i + 16] == mark})
                texts.append(text)
                used.append(path if text else None)
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(used, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, f"page_id {kind.simpleString()}, url string, text string, n_chars long, path string")

"""N-gram Jaccard join: a metric-space join with pivots, Voronoi cells and windows.

Documents are sets of word shingles; two link when their Jaccard similarity is
at least ``THRESHOLD``. The Jaccard distance is a metric, so distances to pivots
tell which documents can't be near each other. Among documents that have nothing
in common all distances are one, and pivots alone can't part them; so the first
regions come from parts of the sets:

1. ``describe``. Each set is split into parts by the shingles' hashes, as many
   that two linked sets must agree in some part whatever their differences are
   (at most D shingles differ, and there are more than D parts). Each part with
   its content is a signature. Parts with under two shingles say little and are
   skipped, unless a set has so many of them that the guarantee would be lost.
   The number of parts follows from a size class; sets near the upper end of
   their class are also split as in the next.
2. First regions. All sets that agree in a part belong to the region of the
   smallest id among them. A set that agrees with no other has no link.

All links between different sets come from the regions, by ``join_regions``:

3. Leaves, regions of at most ``leaf`` documents (and ``leaf_shingles`` shingles),
   are joined exactly in memory.
4. A larger region takes pivots: some of its documents, and its smallest. All
   distances to the pivots are taken, which gives the links to them. Documents
   within the threshold of a pivot, or of one that is linked with it, are
   connected. Of them only those stay that the triangle inequality doesn't part
   from every document outside: d(x, p) >= d(y, p) - r for some y.
5. Voronoi cells. Each document that stays goes to the cell of its nearest pivot,
   and by the triangle inequality also to each other cell whose pivot is at most
   2 r farther, so linked documents meet in a cell. Cells are regions again, if
   they are smaller: where pivots don't part a region, the cheaper of two other
   exact ways is taken.
6. Shared shingles, for documents that have little in common but a core: of two
   linked sets the first |x| - ceil(t |x|) + 1 shingles in any fixed order have
   one in common. The order puts what no pivot has first, so these regions are
   small. What all documents of such a region share is left out in its next turn;
   two sets that link by that alone both link with the smallest document, a pivot.
   Blocks, for dense groups: the documents of the largest ball are connected, so
   only the o others are held, in blocks, against all n of the region: about
   4 n o / leaf rows, and no all-pairs where a ball holds most of the region.
   Cells make a region a quarter smaller, shared shingles halve it, and blocks
   are leaves, so the recursion ends.
7. Links become components by alternating large-star and small-star steps.

Copies of one set count once: sets are told apart by a 128-bit hash, shingles by
64-bit hashes. No pair is emitted but links (to pivots, and in leaves a spanning
forest); no group is collected. A document's set moves once for each of its
regions; texts never move.

Defined cases: null text is empty; documents without words have n_shingles 0 and
link with nothing; rows that share an id are one document, each row with its own
n_shingles; rows without an id link with nothing and have no component; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, text_of

SHINGLE, THRESHOLD, LEAF, LEAF_SHINGLES, PIVOTS = 3, 90, 2048, 4_000_000, 4
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str, n: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    from xxhash import xxh3_64_intdigest as digest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    if len(h) < n:
        return np.array([digest(h.tobytes(), 1)], np.uint64)
    x = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        x *= _A
        x ^= x >> np.uint64(31)
        x += h[i : len(h) - n + 1 + i]
    x *= _B
    x ^= x >> np.uint64(29)
    return np.unique(x)


def smallest(percent: int) -> int:
    """Sets with fewer shingles link only when they are equal."""
    return -(-percent // (100 - percent))


def size_classes(n: int, percent: int) -> list[int]:
    """Upper bounds (excluded) of the size classes in which a set of n shingles takes part."""
    bound = low = smallest(percent)
    if n < low:
        return []
    step = max(1.5, 110 / percent)
    while bound <= n:
        bound = int(bound * step) + 1
    out = [bound]
    if 100 * n >= percent * bound:
        out.append(int(bound * step) + 1)
    return out


def signatures(s: np.ndarray, percent: int = THRESHOLD) -> np.ndarray:
    """Two sets that link share one of these at least."""
    out = []
    if size_classes(len(s), percent):
        x = s * _C
        place = x >> np.uint64(33)
        mixed = (x ^ (x >> np.uint64(29))) * _B
    for bound in size_classes(len(s), percent):
        # of linked sets in this class at most D shingles differ: |A u B| <= (|A| + |B|) / (1 + t), |A ^ B| <= (1 - t) |A u B|
        differ = 2 * (bound - 1) * (100 - percent) // (100 + percent)
        spare = max(2, int(0.15 * differ))
        k = differ + 1 + spare
        part = (place % np.uint64(k)).astype(np.int64)
        count = np.bincount(part, minlength=k)
        order = np.argsort(part, kind="stable")
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed[order], dtype=np.uint64)))
        ends = np.concatenate(([0], np.cumsum(count)))
        sums = sums[ends[1:]] - sums[ends[:-1]]
        light = count < 2
        kept = np.arange(k) if light.sum() > spare else np.flatnonzero(~light)
        v = (sums[kept] + kept.astype(np.uint64) * _A) * _C + np.uint64(bound * int(_B) % 2**64)
        out.append((v ^ (v >> np.uint64(32))) * _A)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def describe(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """doc_id, n_shingles, key (of the set), lead and signatures. Of equal sets in a partition the first alone leads and gives signatures."""
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            n, keys, leads, sigs = [], [], [], []
            for doc, t in zip(batch.column(0), batch.column(1), strict=True):
                s = shingles(t.as_py())
                n.append(len(s))
                keys.append(key := xxh3_128_digest(s.tobytes()) if len(s) else None)
                leads.append(new := doc.is_valid and key is not None and key not in seen)
                if new:
                    seen.add(key)
                sigs.append(signatures(s, percent).view(np.int64) if new else ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(leads, pa.bool_()), pa.array(sigs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "key", "lead", "sigs"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return own.mapInArrow(run, "doc_id long, n_shingles long, key binary, lead boolean, sigs array<long>")


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits at most from a column ``place`` of numbers from 0."""
    parts = places.selectExpr("place + 1 as p").groupBy(F.expr("bitmap_bucket_number(p)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    out = np.zeros((1 << bits) // 8 + 4096, np.uint8)
    for r in parts.toLocalIterator():
        at = (r["b"] - 1) * 4096  # buckets are counted from 1, bits from 0
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which places are set."""
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bits_for(n: int) -> int:
    """Bits of a bitmap for n entries: sixteen for each, between 2**20 and 2**28 (32 MB). A full bitmap lets more through, and loses nothing."""
    return min(28, max(20, (16 * n).bit_length()))


def having(described: DataFrame, met: DataFrame) -> DataFrame:
    """(id, size, sig) of the signatures that two sets have, and of few others: the rest is left out before it is moved."""
    bits = bits_for(met.count())
    known, mask = bitmap(met.select(F.col("sig").bitwiseAND((1 << bits) - 1).alias("place")), bits), (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sigs = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            hit = is_set(known, sigs & mask)
            row = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(sigs[hit])], ["id", "size", "sig"])

    return described.where("lead and size(sigs) > 0").select("doc_id", "n_shingles", "sigs").mapInArrow(run, "id long, size long, sig long")


def sets_of(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id and set (sorted 64-bit hashes) of the documents in ``ids``, and of few others. Rows that share an id give a set each."""
    bits = bits_for(ids.count())
    place = F.pmod(F.xxhash64("id"), F.lit(1 << bits)).alias("place")
    known = bitmap(ids.select(place), bits)
    own = docs.select(F.col(doc_id).cast("long").alias("id"), text_of(text).alias("text")).where("id is not null").select("*", place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.flatnonzero(is_set(known, batch.column(2).to_numpy(zero_copy_only=False)))
            if len(hit):
                some = batch.take(pa.array(hit))
                sets = [shingles(t.as_py()).tobytes() for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    return own.mapInArrow(run, "id long, set binary")


def leaf_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets, exactly.

    Each set is held against all others by the postings of its shingles, but for
    those that are in the first set's component by then: of two sets in different
    components at least one has met all others.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    begin = np.cumsum(sizes) - sizes
    _, number, count = np.unique(np.concatenate(sets) if m else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m, dtype=np.int32), sizes)
    posting = row[np.argsort(number, kind="stable")]
    at = np.cumsum(count) - count
    root = list(range(m))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []

    def meet(p: int) -> int:
        """Link p with all that link with it; how many do."""
        own = number[begin[p] : begin[p] + sizes[p]]
        own = own[count[own] > 1]
        n = count[own]
        place = np.arange(n.sum()) + np.repeat(at[own] - (np.cumsum(n) - n), n)
        inter = np.bincount(posting[place], minlength=m)
        inter[p] = 0
        near = np.flatnonzero((100 * inter >= percent * (sizes + sizes[p] - inter)) & (inter > 0))
        for q in near.tolist():
            x, y = find(p), find(q)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((p, q))
        return len(near)

    first = sorted({i * m // 4 for i in range(4)}) if m > 8 else [0][:m]
    met = {p: meet(p) for p in first}
    head = max(met, key=lambda p: met[p], default=0)
    for p in range(m):
        if p not in met and find(p) != find(head):
            meet(p)
    return out


NEAR = "region long, id long, size long, path array<long>, pivots array<long>, linked array<boolean>, inside array<boolean>, d array<double>, prefix array<long>"


def meet_pivots(percent: int):
    """For mapInArrow over region, id, size, path, set and pivots (id, set): each document's distances to the pivots, and its first shingles."""

    def hubs(sets: list[np.ndarray]) -> list[int]:
        """The pivots' groups by links among them."""
        root = list(range(len(sets)))
        for j in range(len(sets)):
            for i in range(j):
                n = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    a, b = root[i], root[j]
                    root = [a if r == b else r for r in root]
        return root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None
        for batch in batches:
            out = []
            for region, i, size, path, raw, pivots in zip(*batch.columns, strict=True):
                if region.as_py() != of:
                    of, known = region.as_py(), pivots.as_py()
                    ids, sets = [p["id"] for p in known], [np.frombuffer(p["set"], np.uint64) for p in known]
                    hub = hubs(sets)
                s, path = np.frombuffer(raw.as_py(), np.uint64), path.as_py()
                seen = np.zeros(len(s), np.int64)
                linked, d = [], []
                for p in sets:
                    shared = p[np.minimum(np.searchsorted(p, s), len(p) - 1)] == s
                    n = int(shared.sum())
                    seen += shared
                    linked.append(100 * n >= percent * (len(s) + len(p) - n))
                    d.append(1 - n / (len(s) + len(p) - n))
                inside = [any(y for y, g in zip(linked, hub, strict=True) if g == h) for h in hub]
                # what few pivots have comes first
                free = ~np.isin(s, np.array(path, np.int64).view(np.uint64)) if path else np.ones(len(s), bool)
                x, seen = s[free], seen[free]
                first = x[np.lexsort((x * _C, seen))[: len(s) + (-percent * len(s) // 100) + 1]]
                out.append((of, i.as_py(), size.as_py(), path, ids, linked, inside, d, first.view(np.int64)))
            columns = list(zip(*out, strict=True)) if out else [()] * 9
            long, many = pa.int64(), pa.list_
            types = [long, long, long, many(long), many(long), many(pa.bool_()), many(pa.bool_()), many(pa.float64()), many(long)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in NEAR.split(", ")])

    return run


def join_regions(
    members: DataFrame, sets: DataFrame, work: Workspace, percent: int = THRESHOLD, leaf: int = LEAF, leaf_shingles: int = LEAF_SHINGLES
) -> list[DataFrame]:
    """Links (a, b) of regions of any size. ``members`` has region, id and size (of the set); every two linked ids of a region get connected."""
    r = (100 - percent) / 100 + 1e-9
    links: list[DataFrame] = []
    regions = members.select("region", "id", "size", F.expr("cast(array() as array<bigint>) as path"))
    turn = 0

    def join_leaf(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_pylist()
        found = leaf_links([np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()], percent)
        return pa.table({"a": pa.array([ids[a] for a, _ in found], pa.int64()), "b": pa.array([ids[b] for _, b in found], pa.int64())})

    def joined(groups: DataFrame) -> DataFrame:
        # always by a shuffle: each set moves once for each region, whatever the size of the input
        return groups.select("region", "id").join(sets.hint("merge"), "id").groupBy("region").applyInArrow(join_leaf, "a long, b long")

    half, half_shingles = max(1, leaf // 2), max(1, leaf_shingles // 2)
    while True:
        sizes = regions.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).where("n > 1")
        sized = work.save(regions.join(sizes, "region"), f"regions{turn}")
        is_leaf = f"n <= {leaf} and total <= {leaf_shingles}"
        links.append(work.save(joined(sized.where(is_leaf)), f"leaf_links{turn}"))
        large = sized.where(f"not ({is_leaf})")
        if large.isEmpty():
            return links
        # new pivots: some by a hash that differs each turn, and the smallest set
        order = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("id", F.lit(turn)), "id"))
        chance = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 30)) < F.lit(64.0 * 2**30) / F.col("n")
        chosen = large.where(chance).withColumn("k", order).where(F.col("k") <= PIVOTS).select("region", "id")
        chosen = chosen.unionByName(large.groupBy("region").agg(F.min_by("id", F.struct("size", "id")).alias("id"))).distinct()
        pivots = chosen.join(sets, "id").groupBy("region").agg(F.sort_array(F.collect_list(F.struct("id", "set"))).alias("pivots"))  # PIVOTS + 1 at most
        near = large.join(sets, "id").join(pivots, "region").select("region", "id", "size", "path", "set", "pivots")
        near = work.save(near.mapInArrow(meet_pivots(percent), NEAR), f"near{turn}")
        to_pivot = near.select("id", F.explode(F.arrays_zip("pivots", "linked")).alias("x")).where("x.linked and id <> x.pivots")
        links.append(work.save(to_pivot.select(F.col("x.pivots").alias("a"), F.col("id").alias("b")), f"pivot_links{turn}"))
        # a pivot has met everyone; of a pivot's ball only the window towards the nearest document outside stays
        each = range(PIVOTS + 1)
        nearest = near.groupBy("region").agg(F.array(*[F.min(F.expr(f"if(get(inside, {k}), null, get(d, {k}))")) for k in each]).alias("m"))
        rest = near.where("not array_contains(pivots, id)").join(nearest, "region")
        rest = rest.where(f"not exists(arrays_zip(inside, d, m), x -> coalesce(x.inside, false) and (x.m is null or x.d < x.m - {r}D))")
        rest = rest.withColumn("to", F.expr(f"filter(sequence(0, size(d) - 1), k -> d[k] <= array_min(d) + {2 * r}D)"))
        rest = work.save(rest.select("region", "id", "size", "path", "inside", "to", "prefix"), f"rest{turn}")
        cells = ", ".join(f"c{k}" for k in each)
        how = rest.groupBy("region").agg(
            F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), *[F.count_if(F.array_contains("to", k)).alias(f"c{k}") for k in each],
            F.array(*[F.count_if(F.expr(f"coalesce(get(inside, {k}), false)")) for k in each]).alias("balls"),
        )
        how = how.selectExpr(
            "region", "n", f"greatest(n / {half}D, total / {half_shingles}D) as parts", "n - array_max(balls) as others", "cast(array_position(balls, array_max(balls)) as int) - 1 as ball",
            f"case when {is_leaf} then 'leaf' when {cells.replace(', ', ' + ')} <= 1.5 * n and greatest({cells}) <= 0.75 * n then 'cells' else 'dense' end as how",
        )
        how = work.save(how, f"how{turn}")
        dense = rest.join(how.where("how = 'dense'"), "region")
        # shared shingles or blocks, whichever moves fewer rows
        met = dense.select("region", F.explode("prefix").alias("k")).groupBy("region", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = met.groupBy("region").agg(F.sum("n").alias("moved"), F.max("n").alias("most"))
        ways = how.join(met, "region", "left").withColumn("cost", F.expr("n * ceil(parts * others / n) + others * ceil(parts)"))
        ways = ways.withColumn("how", F.expr("if(how = 'dense', if(moved is null or (moved <= cost and most <= 0.5 * n), 'shared', 'blocks'), how)"))
        rest = rest.join(work.save(ways, f"ways{turn}"), "region")
        whole = rest.where("how = 'leaf'").select("region", "id", "size", "path")
        parted = rest.where("how = 'cells'").select("region", "id", "size", "path", F.explode("to").alias("k"))
        parted = parted.select(F.xxhash64("region", "k", F.lit(turn)).alias("region"), "id", "size", "path")
        shared = rest.where("how = 'shared'").select("region", "id", "size", "path", F.explode("prefix").alias("k"))
        shared = shared.select(F.xxhash64("region", "k", F.lit(-1 - turn)).alias("region"), "id", "size", F.array_append("path", F.col("k")).alias("path"))
        blocks = rest.where("how = 'blocks' and others > 0").withColumns({"all": F.ceil("parts").cast("int"), "some": F.expr("cast(ceil(parts * others / n) as int)"), "h": F.xxhash64("id", F.lit(turn))})
        against = blocks.select("region", "id", F.expr("cast(pmod(h, all) as int)").alias("i"), F.explode(F.expr("sequence(0, some - 1)")).alias("j"))
        others = blocks.where("not inside[ball]").select("region", "id", F.explode(F.expr("sequence(0, all - 1)")).alias("i"), F.expr("cast(pmod(h, some) as int)").alias("j"))
        pairs = against.unionByName(others).select(F.xxhash64("region", "i", "j").alias("region"), "id").distinct()
        links.append(work.save(joined(pairs), f"block_links{turn}"))
        regions = whole.unionByName(parted).unionByName(shared)
        turn += 1


def components(links: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """id and component (the smallest id reachable) of every id in links (a, b), by alternating large-star and small-star steps until nothing changes.

    Each id's smallest neighbour is written before it meets the links, so that Spark can split an id with very many links.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}_least{turn}")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = work.save(small, f"{name}{turn}")
        work.drop(f"{name}_least{turn}")
        if turn > 1:
            work.drop(f"{name}{turn - 2}")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before, turn = state, turn + 1


def jaccard_components(docs: DataFrame, work: Workspace, doc_id: str = "doc_id", text: str = "text", percent: int = THRESHOLD, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    table = work.save(describe(docs, doc_id, text, percent), "described")
    signed = table.where("lead and size(sigs) > 0").select(F.col("doc_id").alias("id"), F.explode("sigs").alias("sig"))
    met = work.save(signed.groupBy("sig").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").select("sig", "pivot"), "met")
    # of equal sets one leading row alone takes part in regions and components; least is the smallest id of all of them
    rows = table.where("key is not null and doc_id is not null")
    sets_known = rows.groupBy("key").agg(F.min(F.expr("if(lead, doc_id, null)")).alias("first"), F.min("doc_id").alias("least"))
    sets_known = work.save(sets_known, "known")
    leads = rows.where("lead").select("doc_id", "key").join(sets_known, "key")
    again = leads.groupBy("doc_id").agg(F.min(F.expr("doc_id <> first")).alias("again")).where("again").select(F.col("doc_id").alias("id"))
    members = having(table, met).join(met, "sig").select(F.col("pivot").alias("region"), "id", "size").distinct()
    members = work.save(members.join(again, "id", "left_anti"), "members")
    work.drop("met")
    sets = work.save(sets_of(docs, members.select("id").distinct(), doc_id, text), "sets")
    found = join_regions(members, sets, work, percent, leaf)
    # an id with several sets links them
    of_id = rows.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("doc_id")
    several = rows.select("doc_id", "key").join(of_id, "doc_id", "left_semi").join(sets_known, "key").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    links = several
    for x in found:
        links = links.unionByName(x)
    parts = components(work.save(links, "links"), work)
    labelled = sets_known.join(parts, F.col("first") == F.col("id"), "left").select("key", "least", F.coalesce("component", "first").alias("component"))
    label = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    label = work.save(labelled.join(label, "component").select("key", "component_id"), "labelled")
    # a row without words goes with the other rows of its id, if there are some
    empty = table.where("key is null").select("doc_id", "n_shingles")
    of_id = rows.select("doc_id", "key").join(empty.select("doc_id").distinct(), "doc_id", "left_semi").join(label, "key").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = table.where("key is not null").select("doc_id", "n_shingles", "key").join(label, "key", "left").drop("key").unionByName(empty.join(of_id, "doc_id", "left"))
    return work.finish(out.select("doc_id", "n_shingles", F.expr("if(doc_id is null, null, coalesce(component_id, doc_id))").alias("component_id")), "result")


def _place(ids: np.ndarray, level: int, bits: int) -> np.ndarray:
    x = (ids.astype(np.int64).view(np.uint64) + np.uint64(level + 1) * _A) * _B
    return (((x ^ (x >> np.uint64(31))) * _C) >> np.uint64(64 - bits)).astype(np.int64)


class Among:
    """Exact membership of ids in one side of a table (id, side), without moving what is tested.

    A bitmap of the ids of the side also lets some others through; a second one
    holds those, and lets some of the first through, and so on until at most
    ``few`` are left, which are listed. ``bitmaps`` is None where the first would
    take more than ``most`` bits: then the caller has to join.
    """

    def __init__(self, table: DataFrame, few: int = 100_000, most: int = 1 << 28):
        self.bitmaps: list[tuple[np.ndarray, int]] | None = []
        self.listed = np.zeros(0, np.int64)
        while True:
            level = len(self.bitmaps)
            left = self._through(table.where(F.col("side") == (level % 2 == 0)).select("id"))
            n = left.count()
            if n <= few:
                self.listed = np.sort(left.toArrow().column(0).to_numpy())
                return
            bits = max(20, (16 * n).bit_length())
            if 1 << bits > most:
                self.bitmaps = None
                return
            place = left.mapInArrow(lambda bs, level=level, bits=bits: (pa.RecordBatch.from_arrays([pa.array(_place(b.column(0).to_numpy(), level, bits))], ["place"]) for b in bs), "place long")
            self.bitmaps.append((bitmap(place, bits), bits))

    def _through(self, ids: DataFrame) -> DataFrame:
        """The ids that all bitmaps let through."""
        levels = list(self.bitmaps)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(0).to_numpy()
                for level, (known, bits) in enumerate(levels):
                    x = x[is_set(known, _place(x, level, bits))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64())], ["id"])

        return ids.mapInArrow(run, "id long") if levels else ids

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        """Which of the ids, all of them in the table, are of the side."""
        out, left = np.zeros(len(ids), bool), np.arange(len(ids))
        for level, (known, bits) in enumerate(self.bitmaps):
            hit = is_set(known, _place(ids[left], level, bits))
            out[left[~hit]] = level % 2 == 1
            left = left[hit]
        out[left] = np.isin(ids[left], self.listed) == (len(self.bitmaps) % 2 == 0)
        return out


def select_rows(docs: DataFrame, doc_id: str, table: DataFrame, **bounds) -> DataFrame:
    """The rows of ``docs``, as they are, whose id is not null and of the side; ``table`` has every id once. Texts move only beyond the bounds of ``Among``."""
    among = Among(table, **bounds)
    if among.bitmaps is None:
        chosen = table.where("side").select(F.col("id").alias("chosen"))
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("own"))
        return rows.join(chosen, F.col("own") == F.col("chosen"), "left_semi").select("row.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(doc_id).cast(pa.int64())
            kept = among(own.fill_null(0).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(kept & own.is_valid().to_numpy(zero_copy_only=False)))

    return docs.mapInArrow(run, docs.schema)


def keep_one_of_each(docs: DataFrame, work: Workspace, doc_id: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """The rows of ``docs``, as they are, of each component's smallest id; of rows that share that id the first by text; all rows without an id."""
    parts = jaccard_components(docs, work, doc_id, text).where("doc_id is not null").groupBy(F.col("doc_id").alias("id"))
    ids = work.save(parts.agg(F.count(F.lit(1)).alias("n"), F.first(F.expr("doc_id = component_id")).alias("head")), "ids")
    out = select_rows(docs, doc_id, ids.select("id", F.expr("head and n = 1").alias("side")), **bounds).unionByName(docs.where(F.col(doc_id).isNull()))
    if ids.where("head and n > 1").isEmpty():
        return out
    found = select_rows(docs, doc_id, ids.select("id", F.expr("head and n > 1").alias("side")), **bounds)
    rows = found.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("own"), F.col(text).alias("text"))
    turn = F.row_number().over(Window.partitionBy("own").orderBy("text"))
    return out.unionByName(rows.withColumn("turn", turn).where("turn = 1").select("row.*"))

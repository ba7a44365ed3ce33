"""Exact similarity join of word-shingle sets in the Jaccard metric.

Unrelated documents stand at distance one from each other, so pivots that are documents tell
nothing about them: every window would take in everything.  The first cut therefore uses
pivots of a coarser metric, the sizes of symmetric differences inside slices of the shingle
space.  Two sets with |x & y| / |x | y| >= t differ in at most D = n * (1 - t) / t shingles (n:
size of the smaller), so of D + 1 slices one at least is equal: distance zero to the pivot
that is this slice's content.  A document stands in the region of each of its slice contents;
by size windows (n' <= n / t) it also visits the regions of all smaller size classes down to n * t.

Regions that share documents form a group, and every link lies inside one group.  A group that
fits a task is joined there: pivot documents create Voronoi regions, documents within twice the
radius of the border are put into both, regions are joined recursively, and a region whose
documents are all connected is done.  A larger group is cut again by other slices; where that
does not help (a large cluster of near copies), pivots are compared with all of the group's
documents in parallel until every document outside the largest cluster has been a pivot.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from riskweave.llm.common import documents, keep, windows

TASK_SHINGLES = 4_000_000          # a group up to this weight is joined in one task
CLASS_RATIO = 1.5                  # of the sizes in one class
SMALL = 32                         # documents compared pair by pair
PIVOTS = 8
BASE = "doc_id long, mark long, n_shingles long, node long, slices array<long>"
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


class Words:
    """Hashes of words, kept while a window is worked on."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > 200_000:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def shingles(text: str, k: int, hashes: Words) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct k-word shingles; fewer words are one shingle, none is empty."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h, size = hashes(words), min(k, len(words))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = mix(out * M3 + h[i:len(h) - size + 1 + i])
    return np.unique(out)


def node_of(x: np.ndarray) -> int:
    """64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).astype(np.int64))


class Slices:
    """Slice contents that two similar sets must share one of."""

    def __init__(self, num: int, den: int, salt: int = 0):
        self.num, self.den, self.salt = num, den, np.array([salt + 1], np.uint64)
        self.least = -(-num // (den - num))          # smaller sets have no similar set but themselves
        self.starts = [self.least]

    def size_class(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(int(self.starts[-1] * CLASS_RATIO) + 1)
        return next(i for i, s in enumerate(self.starts) if s > n) - 1

    def __call__(self, x: np.ndarray) -> list[int]:
        n = len(x)
        if n < self.least:
            return []
        own = self.size_class(n)
        out = self._of(x, own)
        while own and n * self.num <= (self.starts[own] - 1) * self.den:
            own -= 1
            out += self._of(x, own)
        return out

    def _of(self, x: np.ndarray, size_class: int) -> list[int]:
        """Contents of D + 1 slices, as hashes.

        Where a slice is empty, an equal content says nothing.  If only empty slices are equal, each
        of the other D differs by exactly one shingle, so the next slice of one set is that of the
        other less one shingle: its content and all its contents less one stand in for the empty slice.
        """
        self.size_class(self.starts[size_class])     # so that the class has an end
        m = (self.starts[size_class + 1] - 1) * (self.den - self.num) // self.num + 1
        spread = mix(x ^ mix(self.salt))
        at = (spread % np.uint64(m)).astype(np.int64)
        value = mix(spread + M1)
        total, count = np.zeros(m, np.uint64), np.bincount(at, minlength=m)
        np.add.at(total, at, value)
        mark = np.array([size_class], np.uint64) * M2 + self.salt
        place = np.arange(m, dtype=np.uint64)
        keys = mix(total * M3 + mix(place * M1 + mark))
        out = keys[count > 0].view(np.int64).tolist()
        for j in np.flatnonzero(count == 0).tolist():
            after = (j + 1) % m
            contents = np.concatenate([total[after:after + 1], total[after] - value[at == after]])
            out += mix(contents * M2 + mix(place[j:j + 1] * M3 + mark + M1)).view(np.int64).tolist()
        return out


def _base(batches: Iterable[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    hashes, slices = Words(), Slices(num, den)
    for window in windows(batches):
        sets = [shingles(t, k, hashes) for t in window.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [window.column("doc_id"), window.column("mark"), pa.array([len(x) for x in sets], pa.int64()), pa.array([node_of(x) for x in sets], pa.int64()),
             pa.array([slices(x) for x in sets], pa.list_(pa.int64()))], ["doc_id", "mark", "n_shingles", "node", "slices"])


# -- the join inside a task ----------------------------------------------------------
class Group:
    """Sets of one group; join() links all similar ones and leaves equal labels on what is connected."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        self.size = np.array([len(s) for s in sets])
        self.label = np.arange(len(sets))

    def similar(self, shared, a, b):
        return shared * self.den >= self.num * (self.size[a] + self.size[b] - shared)

    def link(self, a: int, b: int) -> None:
        if self.label[a] != self.label[b]:
            low, high = sorted((self.label[a], self.label[b]))
            self.label[self.label == high] = low

    def shared(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of one set with others."""
        own, flat = self.sets[pivot], np.concatenate([self.sets[i] for i in others])
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        return np.add.reduceat((own[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(self.size[others])[:-1]]))

    def compare(self, pivot: int, others: np.ndarray) -> None:
        """Link the pivot with those of the others that are similar and not yet connected to it."""
        size = self.size[pivot]
        fits = (self.size[others] * self.den >= self.num * size) & (size * self.den >= self.num * self.size[others])
        others = others[fits & (self.label[others] != self.label[pivot])]
        if len(others):
            for o in others[self.similar(self.shared(pivot, others), pivot, others)].tolist():
                self.link(pivot, o)

    def join(self, members: np.ndarray | None = None) -> None:
        members = np.arange(len(self.sets)) if members is None else members
        if len(np.unique(self.label[members])) < 2:
            return
        if len(members) <= SMALL:
            for i in range(len(members) - 1):
                self.compare(members[i], members[i + 1:])
            return
        members = members[np.lexsort((members, self.size[members]))]
        pivots = members[np.linspace(0, len(members) - 1, PIVOTS).astype(int)]
        near = np.empty((len(members), len(pivots)))
        for k, p in enumerate(pivots):
            shared = self.shared(p, members)
            near[:, k] = 1 - shared / (self.size[p] + self.size[members] - shared)
            for o in members[self.similar(shared, p, members)].tolist():
                self.link(p, o)
        home = near.argmin(1)
        reach = near.min(1) + 2 * (1 - self.num / self.den) + 1e-9
        for k in range(len(pivots)):
            own = home == k
            if own.any():
                # nothing of this region lies beyond its radius, so nothing farther than radius + threshold can match
                radius = near[own, k].max() + (1 - self.num / self.den) + 1e-9
                region = members[own | (near[:, k] <= np.minimum(reach, radius))]
                if len(region) <= 0.7 * len(members):
                    self.join(region)
                else:
                    self.indexed(region)

    def indexed(self, members: np.ndarray) -> None:
        """Join what pivots cannot tell apart: similar sets share one of the rarest shingles of each."""
        if len(np.unique(self.label[members])) < 2:
            return
        flat = np.concatenate([self.sets[i] for i in members])
        kinds, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(kinds), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(kinds))
        seen: dict[int, list[int]] = {}
        at = 0
        for i in members.tolist():
            n = self.size[i]
            own = np.sort(rank[inverse[at:at + n]])[:n - -(-n * self.num // self.den) + 1].tolist()
            at += n
            found = {j for r in own for j in seen.get(r, ()) if self.label[j] != self.label[i]}
            if found:
                self.compare(i, np.array(sorted(found)))
            for r in own:
                seen.setdefault(r, []).append(i)


def _join_groups(batches: Iterable[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (comp, text) in order of comp; a row (node, root) for every document."""
    hashes, current, sets = Words(), None, {}

    def done():
        names = list(sets)
        group = Group([sets[n] for n in names], num, den)
        group.join()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([names[i] for i in group.label], pa.int64())], ["node", "root"])

    for batch in batches:
        for comp, text in zip(batch.column("comp").to_pylist(), batch.column("text").to_pylist()):
            if comp != current and sets:
                yield done()
                sets = {}
            current = comp
            x = shingles(text, k, hashes)
            sets[node_of(x)] = x
    if sets:
        yield done()


# -- connected components --------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """node and comp (smallest node reachable) for every node of an edge table (a, b).

    Every round lowers each label to the smallest among the neighbours and then follows labels of
    labels; a round is a partial aggregation and two equi-joins, written to the shared folder.
    """
    both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    label = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp")), "labels")
    while True:
        low = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        lower = label.join(low, "node").select("node", "comp", F.least("comp", "low").alias("next"))
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = keep(lower.join(jump, "next").select("node", "comp", F.least("next", "far").alias("next")), "labels")
        changed = after.where("comp <> next").limit(1).count()
        label = after.select("node", F.col("next").alias("comp"))
        if not changed:
            return label


def _shared_slices(rows: DataFrame, within: str | None) -> DataFrame:
    """Edges that connect all documents of each region; rows: node, slices and maybe the group they stand in.

    Every document points at the first one of each of its regions.  Of these (no more than it has
    slices) the smallest takes the others, so a cluster of many regions keeps one edge a document
    and a few between its firsts.
    """
    of = ["key"] + ([within] if within else [])
    each = rows.select("node", F.explode("slices").alias("key"), *([within] if within else []))
    first = each.groupBy(*of).agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").drop("last")
    firsts = each.join(first, of).groupBy("node").agg(F.array_sort(F.collect_set("a")).alias("firsts"))
    return firsts.select(F.col("firsts")[0].alias("a"), F.explode(F.array_union(F.slice("firsts", 2, F.greatest(F.size("firsts") - 1, F.lit(1))), F.array("node"))).alias("b")).where("a <> b").distinct()


FILTER_BITS = 1 << 23


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ids (with doc_id and mark) and the text of that document and mark.

    A bit map over id hashes, at most FILTER_BITS / 64 rows whatever the number of ids, leaves out
    nearly all other documents before the texts are shuffled; with more ids than bits it leaves out
    little, and the join is the same.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    words = ids.select(bit("doc_id").alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    texts = documents(docs).withColumnRenamed("doc_id", "id").withColumn("bit", bit("id")).withColumn("own", text_mark())
    some = texts.join(F.broadcast(words), F.expr("bit div 64 = word")).where("(shiftright(bits, cast(bit % 64 as int)) & 1) = 1").select("id", "own", "text")
    return ids.join(some, (F.col("doc_id") == F.col("id")) & (F.col("mark") == F.col("own"))).drop("id", "own")


# -- large groups ------------------------------------------------------------------------
def _again(batches: Iterable[pa.RecordBatch], k: int, num: int, den: int, salt: int) -> Iterator[pa.RecordBatch]:
    hashes, slices = Words(), Slices(num, den, salt)
    for window in windows(batches):
        sets = [shingles(t, k, hashes) for t in window.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([window.column("comp"), pa.array(map(node_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64()),
                                          pa.array(map(slices, sets), pa.list_(pa.int64()))], ["comp", "node", "n_shingles", "slices"])


def _to_pivots(batches: Iterable[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (text, pivots: list of texts); a row (a, b) for every link between a document and a pivot."""
    hashes, cached = Words(), {}
    for window in windows(batches):
        found = []
        for text, pivots in zip(window.column("text").to_pylist(), window.column("pivots").to_pylist()):
            x = shingles(text, k, hashes)
            name = node_of(x)
            for p in pivots:
                if p not in cached:
                    if len(cached) > 4 * PIVOTS:
                        cached.clear()
                    cached[p] = shingles(p, k, hashes)
                y = cached[p]
                # sizes first: the distance to the empty set bounds the distance to the pivot
                if min(len(x), len(y)) * den >= num * max(len(x), len(y)):
                    shared = np.intersect1d(x, y, assume_unique=True).size
                    if shared * den >= num * (len(x) + len(y) - shared):
                        found.append((node_of(y), name))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def _by_pivots(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """node and root for groups too large for a task: rows of comp, node, text.

    In each round PIVOTS documents of every group, from outside its largest cluster and never
    used before, are compared with all documents of the group.  When none is left, every link
    between different clusters has been seen, because one of its ends was a pivot.
    """
    links, used, first = None, None, rows.select("comp", "node")
    label = first.select("comp", "node", F.col("node").alias("root"))
    while True:
        sizes = label.groupBy("comp", "root").count()
        largest = sizes.groupBy("comp").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
        outside = label.join(largest, "comp").where("root <> main").select("comp", "node")
        if used is not None:
            outside = outside.join(used, ["comp", "node"], "left_anti")
        # a bounded choice per group: the aggregate keeps the smallest hashes only
        chosen = keep(outside.groupBy("comp", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("slot")).agg(F.min_by("node", F.xxhash64("node")).alias("node")).select("comp", "node"), "pivots")
        if not chosen.limit(1).count():
            return label.select("node", "root")
        texts = rows.join(chosen, ["comp", "node"]).groupBy("comp").agg(F.collect_list("text").alias("pivots"))
        new = rows.join(texts, "comp").select("text", "pivots").mapInArrow(partial(_to_pivots, k=k, num=num, den=den), "a long, b long").where("a <> b")
        links = keep(new if links is None else links.unionByName(new), "links")
        used = chosen if used is None else keep(used.unionByName(chosen), "used")
        if links.limit(1).count():
            found = components(links)
            label = keep(first.join(found.withColumnRenamed("comp", "root"), "node", "left").select("comp", "node", F.coalesce("root", "node").alias("root")), "roots")


def similar_sets(docs: DataFrame, base: DataFrame, k: int, num: int, den: int, task: int = TASK_SHINGLES) -> DataFrame | None:
    """node and root for every document whose set may be similar to another set; None without any."""
    names = base.where("n_shingles > 0 and doc_id is not null")
    edges = keep(_shared_slices(names, None), "shared")
    if not edges.limit(1).count():
        return None
    group = components(edges)
    first = names.groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("r"), F.min("n_shingles").alias("n_shingles")).select("node", "r.doc_id", "r.mark", "n_shingles")
    members = keep(group.join(first, "node"), "members")
    roots, salt = [], 0
    while True:
        weight = members.groupBy("comp").agg(F.sum("n_shingles").alias("weight"), F.count("*").alias("n"))
        sized = keep(members.join(weight, "comp"), "sized")
        fits = sized.where((F.col("weight") <= task) & (F.col("n") > 1)).select("comp", "doc_id", "mark")
        rows = _texts_of(fits, docs).select("comp", "text").repartition("comp").sortWithinPartitions("comp")
        roots.append(keep(rows.mapInArrow(partial(_join_groups, k=k, num=num, den=den), "node long, root long"), "roots"))
        large = sized.where(F.col("weight") > task)
        left = large.count()
        if not left:
            break
        salt += 1
        full = keep(_texts_of(large.select("comp", "doc_id", "mark", "node"), docs), "large")
        cut = keep(full.select("comp", "text").mapInArrow(partial(_again, k=k, num=num, den=den, salt=salt), "comp long, node long, n_shingles long, slices array<long>"), "cut")
        again = _shared_slices(cut, "comp")
        group = components(again) if again.limit(1).count() else None
        before = large.select("node", "doc_id", "mark", "n_shingles")
        after = None if group is None else keep(group.join(before, "node").select("node", "comp", "doc_id", "mark", "n_shingles"), "members")
        kept = 0 if after is None else after.groupBy("comp").agg(F.sum("n_shingles").alias("w")).where(F.col("w") > task).count()
        if after is None:
            break
        biggest = lambda d: d.groupBy("comp").count().agg(F.max("count")).first()[0]
        if kept and biggest(after) > 0.7 * biggest(large):
            # no further cut comes from slices: what is large is truly alike
            roots.append(keep(_by_pivots(full.select("comp", "node", "text"), k, num, den), "roots"))
            break
        members = after
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return out


def text_mark():
    """64-bit hash of a row's text; a null text is empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, task: int = TASK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Sets: distinct k-word shingles of the whole text, lower-cased in A-Z, split at ASCII white
    space; a text with fewer words is one shingle, a null or empty one an empty set that links
    with nothing.  Two rows link when den * |x & y| >= num * |x | y|, and component_id is the
    smallest doc_id reachable.  Rows of equal text link, repeated ids among them.  A row with a
    null doc_id takes no part; its component_id is null.  Shingles and sets are known by 64-bit
    hashes; everything else is exact.
    """
    return grouped(docs, k, num, den, task).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, task: int = TASK_SHINGLES) -> DataFrame:
    """join() with the text_mark() of every row and root, the 64-bit name of its component (null where it takes no part).

    Rows of one doc_id with different texts may stand in different components, and components
    may have the same smallest doc_id; mark and root tell them apart.
    """
    if not 0 < num < den:
        raise ValueError("the threshold must lie between 0 and 1")
    base = keep(documents(docs).withColumn("mark", text_mark()).mapInArrow(partial(_base, k=k, num=num, den=den), BASE), "sets")
    roots = similar_sets(docs, base, k, num, den, task)
    rows = base.select("doc_id", "mark", "n_shingles", "node")
    own = rows.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("smallest"))
    if roots is None:
        named = own.select("node", F.col("node").alias("root"), F.col("smallest").alias("component_id"))
    else:
        rooted = keep(own.join(roots.groupBy("node").agg(F.min("root").alias("root")), "node", "left").select("node", "smallest", F.coalesce("root", "node").alias("root")), "rooted")
        lowest = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
        named = rooted.join(lowest, "root").select("node", "root", "component_id")
    return rows.join(named, "node", "left").select(
        "doc_id", "mark", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("root")).alias("root"), F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))

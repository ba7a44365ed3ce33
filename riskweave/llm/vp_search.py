"""Approximate nearest neighbours by cosine: a vantage-point tree per shard.

Vectors are compared as points of the unit sphere, where the Euclidean distance falls as the
cosine rises.  A node splits its points at the median distance to a vantage point.  A query
leaves a side out when the border is farther than factor * (distance of its k-th best so far);
with factor one that is the triangle inequality and the search is exact, below one it is faster
and may miss.  The same rule, with the same factor, chooses the shards.  All queries of a block go
down the tree together.  What a leaf offers is compared by its cosine on the original vectors.
"""

from __future__ import annotations

import pickle
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame, functions as F

from riskweave.llm.vectors import Space, distinct, merge, search, usable

FACTOR = 0.2
LEAF = 256
SHARD_ROWS, BLOCK_ROWS = 4096, 1024
SLACK = 1e-9


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by their largest entry first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b, one by one."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        plain = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
    odd = ~np.isfinite(plain)
    if odd.any():
        plain[odd] = np.einsum("ij,ij->i", units(a[odd]), units(b[odd]))
    return plain


def build(ids: np.ndarray, vectors: np.ndarray, k: int) -> bytes:
    """The tree of a shard: nested tuples (vantage, border, near, far), leaves as arrays of places."""
    points, owners, begin = distinct(ids, vectors, k)
    unit = units(points)
    spread = np.random.default_rng(len(ids))

    def grow(places: np.ndarray):
        if len(places) <= LEAF:
            return places
        vantage = places[spread.integers(len(places))]
        rest = places[places != vantage]
        d = np.linalg.norm(unit[rest] - unit[vantage], axis=1)
        border = float(np.median(d))
        near = d < border
        if not near.any() or near.all():
            return places                           # all equally far: no border parts them
        return int(vantage), border, grow(rest[near]), grow(rest[~near])

    return pickle.dumps((points, unit, owners, begin, grow(np.arange(len(points)))))


@lru_cache(maxsize=2)
def _load(index: bytes):
    return pickle.loads(index)


class Search:
    """The best k so far of a block of queries, and the way down the tree."""

    def __init__(self, index: bytes, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, k: int, factor: float):
        self.points, self.unit, self.owners, self.begin, self.tree = _load(index)
        self.ids, self.vectors, self.asked, self.k, self.factor = ids, vectors, units(vectors), k, factor
        self.bound = bounds.copy()                  # a score that k candidates are known to reach
        self.rows, self.found, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.computed = 0

    def offer(self, active: np.ndarray, places: np.ndarray, cosine: np.ndarray) -> None:
        self.computed += cosine.size
        at, p = np.nonzero(cosine >= self.bound[active][:, None] - SLACK)
        if not len(at):
            return
        row, place = active[at], places[p]
        score = cosines(self.vectors[row], self.points[place])
        many = self.begin[place + 1] - self.begin[place]
        each = np.repeat(np.arange(len(place)), many)
        owner = self.owners[np.repeat(self.begin[place], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        other = owner != self.ids[row[each]]
        touched = np.isin(self.rows, active)
        rows, found, scores = merge(np.concatenate([self.rows[touched], row[each][other]]), np.concatenate([self.found[touched], owner[other]]),
                                    np.concatenate([self.scores[touched], score[each][other]]), self.k)
        self.rows, self.found, self.scores = (np.concatenate([a[~touched], b]) for a, b in ((self.rows, rows), (self.found, found), (self.scores, scores)))
        full = np.flatnonzero(np.bincount(rows, minlength=len(self.ids)) == self.k)
        if len(full):
            last = np.searchsorted(rows, full, "right") - 1
            self.bound[full] = np.maximum(self.bound[full], scores[last])

    def visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            self.offer(active, node, self.asked[active] @ self.unit[node].T)
            return
        vantage, border, inner, outer = node
        cosine = self.asked[active] @ self.unit[vantage]
        self.offer(active, np.array([vantage]), cosine[:, None])
        d = np.sqrt(np.maximum(0.0, 2 - 2 * cosine))
        inside = d < border
        self.visit(inner, active[inside])
        self.visit(outer, active[~inside])
        # the other side, where the ball around the k-th best reaches over the border
        ball = np.sqrt(np.maximum(0.0, 2 - 2 * np.maximum(self.bound[active], -1.0)))
        crosses = np.abs(d - border) <= self.factor * ball + SLACK
        self.visit(outer, active[inside & crosses])
        self.visit(inner, active[~inside & crosses])


def look(index: bytes, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k rows of the shard for each query, its own row left out; what scores below the query's bound may be missing."""
    run = Search(index, ids, vectors, bounds, k, factor)
    run.visit(run.tree, np.arange(len(ids)))
    return ids[run.rows], run.found, run.scores


def _reach(vectors: np.ndarray, scores: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * scores))


def nearest(rows: DataFrame, every: int, k: int, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and cosine of the k nearest found, for each row whose id `every` divides.

    rows: vec_id, embedding.  Vectors null, empty, zero or with null or non-finite components take
    no part, nor do those of another length than the commonest.  The query's own id is left out; an id that
    several rows carry is one candidate with its best cosine.  Ties go to the smaller vec_id, however many
    there are.  Every row is indexed.
    """
    clean = usable(rows).where(F.exists("v", lambda x: x != 0))
    space = Space(units, units, _reach, partial(build, k=k), partial(look, k=k, factor=factor), "double")
    return search(clean, every, space, k, shard_rows, block_rows, factor)

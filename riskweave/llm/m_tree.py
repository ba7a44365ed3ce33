"""Exact top-k by integer inner product: an M-tree per shard, searched best first.

With M the largest norm of all rows, x' = (x, sqrt(M * M - |x|^2)) and q' = (q, 0), the distance
|q' - x'| falls exactly as the inner product rises, so the k highest products are the k nearest
points of a metric space.  Pages hold up to PAGE entries; an entry keeps its distance to the
page's parent and, above the leaves, a covering radius.  Before a distance is worked out, the
stored ones bound it: | d(q, parent) - d(entry, parent) | - radius.  Products themselves are
64-bit integers; bounds get a slack far above rounding, so no tie is lost.  Shards are balls of the
same space: their radii leave out, by the same inequality, shards that a query's k-th best does not reach.
"""

from __future__ import annotations

import heapq
import pickle
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame, functions as F

from riskweave.llm.vectors import Space, distinct, search, usable

PAGE = 64
SLACK = 1e-6
SHARD_ROWS, BLOCK_ROWS = 4096, 256


LARGEST = float(1 << 28)            # entries up to here keep products within 64 bits


def lift(points: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([points, np.sqrt(np.maximum(0.0, most - (points.astype(float) ** 2).sum(1)))[:, None]], 1)


def build(ids: np.ndarray, vectors: np.ndarray, most: float, k: int) -> bytes:
    """Pages of a shard: (is leaf, places of the entries, distances to the parent, radii, children)."""
    points, owners, begin = distinct(ids, vectors.astype(np.int64), k)
    lifted = lift(points, most)
    spread, pages = np.random.default_rng(len(ids)), []

    def apart(one: int, many: np.ndarray) -> np.ndarray:
        return np.linalg.norm(lifted[many] - lifted[one], axis=1)

    def page(places: np.ndarray, parent: int | None) -> int:
        own = len(pages)
        pages.append(None)
        to_parent = lambda p: np.zeros(len(p)) if parent is None else apart(parent, p)
        if len(places) <= PAGE:
            pages[own] = (True, places, to_parent(places), None, None)
            return own
        routes = np.sort(spread.choice(places, min(PAGE, -(-len(places) // PAGE) + 1), replace=False))
        far = np.stack([apart(r, places) for r in routes], 1)
        home = far.argmin(1)
        kept, radii, children = [], [], []
        for j, r in enumerate(routes):
            inside = home == j
            if inside.any():
                # a lone region would never get smaller, so it is cut into plain runs
                members = places[inside]
                parts = [members] if len(members) < len(places) else np.array_split(members, 2)
                for part in parts:
                    kept.append(r), radii.append(float(apart(r, part).max())), children.append(page(part, int(r)))
        kept = np.array(kept)
        pages[own] = (False, kept, to_parent(kept), np.array(radii), children)
        return own

    page(np.arange(len(points)), None)
    return pickle.dumps((points, owners, begin, pages))


@lru_cache(maxsize=2)
def _load(index: bytes):
    return pickle.loads(index)


def look(index: bytes, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, most: float, k: int) -> tuple[list, list, list]:
    """The k highest products of each query within the shard, its own row left out; what lies below the query's bound may be missing."""
    points, owners, begin, pages = _load(index)
    vectors = vectors.astype(np.int64)
    out_q, out_v, out_s = [], [], []
    for q, own, bound in zip(vectors, ids.tolist(), bounds.tolist()):
        square = float((q.astype(float) ** 2).sum())
        top: list[tuple[int, int]] = []             # heap of (score, -id): its first is the worst kept
        limit = _limit(square, most, bound)
        queue = [(0.0, 0, 0.0)]                     # least distance possible, page, distance to its parent
        while queue:
            low, number, to_parent = heapq.heappop(queue)
            if low > limit:
                break
            leaf, places, stored, radii, children = pages[number]
            reach = limit + (0.0 if leaf else radii)
            near = np.arange(len(places)) if number == 0 else np.flatnonzero(np.abs(to_parent - stored) <= reach + SLACK * (1 + to_parent))
            if not len(near):
                continue
            product = points[places[near]] @ q
            d = np.sqrt(np.maximum(0.0, square + most - 2.0 * product))
            if leaf:
                for t in np.lexsort((places[near], -product)):
                    score = int(product[t])
                    if len(top) == k and score < top[0][0]:
                        break
                    place = places[near[t]]
                    for i in owners[begin[place]:begin[place + 1]].tolist():
                        if i != own and (len(top) < k or (score, -i) > top[0]):
                            _take(top, score, i, k)
                if len(top) == k:
                    limit = min(limit, _limit(square, most, top[0][0]))
            else:
                least = np.maximum(0.0, d - radii[near])
                for t in np.flatnonzero(least <= limit + SLACK):
                    heapq.heappush(queue, (float(least[t]), children[near[t]], float(d[t])))
        for score, i in top:
            out_q.append(own), out_v.append(-i), out_s.append(score)
    return out_q, out_v, out_s


def _take(top: list[tuple[int, int]], score: int, i: int, k: int) -> None:
    """Put an id among the best; an id that is there already keeps its higher score."""
    for at, (held, own) in enumerate(top):
        if own == -i:
            if score > held:
                top[at] = (score, own)
                heapq.heapify(top)
            return
    (heapq.heappush if len(top) < k else heapq.heapreplace)(top, (score, -i))


def _limit(square: float, most: float, score: float) -> float:
    """The distance that a product stands for, rounded up."""
    if score == -np.inf:
        return np.inf
    worst = np.sqrt(max(0.0, square + most - 2.0 * score))
    return worst + SLACK * (1 + worst)


def _reach(vectors: np.ndarray, scores: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (vectors ** 2).sum(1) + most - 2 * scores))


def top_products(rows: DataFrame, every: int, k: int, scale: float = 1024.0, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and integer inner product of the k best, for each row whose id `every` divides.

    Components become floor(scale * x).  Vectors null, empty or with null or non-finite components take no
    part, nor do those of another length than the commonest or with entries beyond LARGEST / scale, whose
    products no long holds.  The query's own id is left out, ties go to the smaller vec_id, an id that several
    rows carry is one candidate with its highest product, and fewer candidates than k give fewer rows.  Exact.
    """
    clean = usable(rows, lambda x: F.floor(F.lit(scale) * x).cast("double"), LARGEST / scale)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    most = float(clean.agg(F.max(square)).first()[0] or 0.0)
    space = Space(partial(lift, most=most), partial(_flat, most=most), partial(_reach, most=most), partial(build, most=most, k=k), partial(look, most=most, k=k), "long")
    return search(clean, every, space, k, shard_rows, block_rows)


def _flat(vectors: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([vectors, np.zeros((len(vectors), 1))], 1)

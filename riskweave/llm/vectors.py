"""What both vector searches share: clean rows, shards around vantage points, and bounded rounds.

Rows are routed to the nearest of a few vantage points drawn from a sample; a shard is the ball around
one, with its radius.  A query looks into its own shard first.  The distance of its k-th best there
bounds the rest: only shards whose ball reaches into (factor times) that distance are asked in the second
round, and they get the bound along.  With factor one this is the triangle inequality, and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskweave.llm.common import keep

SAMPLE = 4096                      # rows that the vantage points are drawn from, so the most of them
DEALT = "vec_id long, v array<double>, shard int, apart double"


def usable(rows: DataFrame, transform: Callable[[Column], Column] = lambda x: x, most: float = float("inf")) -> DataFrame:
    """vec_id and v (doubles) of the rows whose vector has only finite components, none of them beyond `most`, and whose id is known.

    Of vectors of several lengths, those of the commonest (ties: the longer) take part.
    """
    v = F.transform("embedding", lambda x: transform(x.cast("double")))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")) | (F.abs(x.cast("double")) > most))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & (F.size("embedding") > 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    top = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return good.where(F.size("v") == top[0].d) if top else good.limit(0)


@dataclass
class Space:
    """How a search sees its vectors.

    point, asked: rows and queries as points whose Euclidean distance falls as the score rises;
    reach(queries, scores): the distance that a score stands for; build(ids, vectors): a shard's index;
    look(index, ids, vectors, bounds): (query, id, score) of the k best in the shard, which may leave out what scores below the bound.
    """

    point: Callable[[np.ndarray], np.ndarray]
    asked: Callable[[np.ndarray], np.ndarray]
    reach: Callable[[np.ndarray, np.ndarray], np.ndarray]
    build: Callable[[np.ndarray, np.ndarray], bytes]
    look: Callable[[bytes, np.ndarray, np.ndarray, np.ndarray], tuple]
    kind: str                      # of a score: double or long


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all of a from all of b."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _deal(batches: Iterable[pa.RecordBatch], space: Space, centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            d = apart(space.point(matrix(batch.column("v"))), centres)
            home = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(home, pa.int32()), pa.array(d[np.arange(len(home)), home])], ["vec_id", "v", "shard", "apart"])


def _index(batches: Iterable[pa.RecordBatch], space: Space) -> Iterator[pa.RecordBatch]:
    """One index a cell; rows come sorted by cell."""
    cell, held = None, []

    def out() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, v = rows.column("vec_id").combine_chunks(), rows.column("v").combine_chunks()
        index = space.build(ids.to_numpy(zero_copy_only=False), matrix(v))
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([index], pa.binary())], ["cell", "index"])

    for batch in batches:
        cells = batch.column("cell").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                if held and int(cells[a]) != cell:
                    yield out()
                    held = []
                cell = int(cells[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield out()


def _ask(batches: Iterable[pa.RecordBatch], space: Space, block: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, a cell's index before its queries, which are answered block by block."""
    cell, index = None, None
    for batch in batches:
        cells, is_query = batch.column("cell").to_numpy(zero_copy_only=False), ~batch.column("index").is_valid().to_numpy(zero_copy_only=False)
        change = np.flatnonzero((cells[1:] != cells[:-1]) | (is_query[1:] != is_query[:-1])) + 1
        cuts = [0, *change.tolist(), len(cells)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if not is_query[a]:
                cell, index = int(cells[a]), batch.column("index")[a].as_py()
                continue
            if cell != int(cells[a]):
                continue                                    # a cell without rows
            for i in range(a, b, block):
                some = batch.slice(i, min(block, b - i))
                q, v, s = space.look(index, some.column("vec_id").to_numpy(zero_copy_only=False), matrix(some.column("v")), some.column("bound").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64() if space.kind == "double" else pa.int64())], ["query_id", "vec_id", "score"])


def _reached(batches: Iterable[pa.RecordBatch], space: Space, centres: np.ndarray, radius: np.ndarray, first: np.ndarray, cells: np.ndarray, factor: float) -> Iterator[pa.RecordBatch]:
    """The cells, without the query's first one, whose shard the ball of its k-th best reaches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors, bound = matrix(batch.column("v")), batch.column("bound").to_numpy(zero_copy_only=False)
        ball = np.where(np.isfinite(bound), space.reach(vectors, np.where(np.isfinite(bound), bound, 0.0)), np.inf)
        gap = apart(space.asked(vectors), centres) - radius
        at, shard = np.nonzero(gap <= factor * ball[:, None] + 1e-6 * (1 + np.abs(gap)))
        many = cells[shard]
        row = np.repeat(at, many)
        cell = np.repeat(first[shard], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        other = cell != batch.column("cell").to_numpy(zero_copy_only=False)[row]
        take = pa.array(row[other])
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell[other], pa.int32()), batch.column("vec_id").take(take), batch.column("v").take(take), batch.column("bound").take(take)], ["cell", "vec_id", "v", "bound"])


ASKED = "cell int, vec_id long, v array<double>, bound double"


def search(rows: DataFrame, every: int, space: Space, k: int, shard_rows: int, block_rows: int, factor: float = 1.0) -> DataFrame:
    """The k best of every row whose id `every` divides: query_id, rank, vec_id, score.

    A shard of more than shard_rows rows (one direction may hold many) is cut into cells by a hash of the id.
    An id that several rows carry is one candidate, with its best score; as a query the smallest of its vectors stands for it.
    """
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], f"query_id long, rank int, vec_id long, score {space.kind}")
    spread = F.xxhash64("vec_id", F.lit(7))
    drawn = rows.where(spread.bitwiseAND(F.lit((1 << 32) - 1)) < F.lit(min(1 << 32, int((1 << 32) * SAMPLE / n) + 1))) if n > SAMPLE else rows
    sample = drawn.select("v").orderBy(spread, "v").limit(min(SAMPLE, max(1, -(-n // shard_rows)))).collect()
    centres = space.point(np.array([r.v for r in sample], float)) if sample else space.point(np.array([rows.first().v], float))
    dealt = keep(rows.mapInArrow(partial(_deal, space=space, centres=centres), DEALT), "dealt")
    sizes = {r.shard: (r.n, r.far) for r in dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("far")).collect()}
    cells = np.array([-(-sizes[s][0] // shard_rows) if s in sizes else 0 for s in range(len(centres))])
    radius = np.array([sizes[s][1] if s in sizes else -np.inf for s in range(len(centres))])
    first = np.cumsum(cells) - cells
    base, many = (F.element_at(F.array(*map(F.lit, x.tolist())), F.col("shard") + 1) for x in (first, np.maximum(cells, 1)))
    placed = dealt.withColumn("cell", (base + F.pmod(F.xxhash64("vec_id"), many)).cast("int")).drop("shard", "apart")
    total = int(cells.sum())
    index = keep(placed.repartitionById(total, F.col("cell")).sortWithinPartitions("cell", "vec_id").mapInArrow(partial(_index, space=space), "cell int, index binary"), "index")
    one = placed.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("q"))
    queries = keep(one.select("q.cell", "vec_id", "q.v", F.lit(float("-inf")).alias("bound")), "queries")
    found = f"query_id long, vec_id long, score {space.kind}"

    def ask(asked: DataFrame) -> DataFrame:
        both = index.select("cell", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("v"), F.lit(None).cast("double").alias("bound"), "index")
        both = both.unionByName(asked.select("cell", "vec_id", "v", "bound").withColumn("index", F.lit(None).cast("binary")))
        dealt_out = both.repartitionById(total, F.col("cell")).sortWithinPartitions("cell", F.col("index").isNull(), "vec_id")
        return dealt_out.mapInArrow(partial(_ask, space=space, block=block_rows), found)

    near = keep(ask(queries), "near")
    kth = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    bound = F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(F.lit(float("-inf")))
    bounded = queries.drop("bound").join(kth, "vec_id", "left").select("cell", "vec_id", "v", bound.alias("bound"))
    further = bounded.mapInArrow(partial(_reached, space=space, centres=centres, radius=radius, first=first, cells=cells, factor=factor), ASKED)
    best = near.unionByName(ask(further)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def distinct(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vectors; the k + 1 smallest ids of each, one after the other; where each one's ids begin (and, last, their number)."""
    kinds, inverse = np.unique(vectors, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([inverse.ravel(), ids], 1), axis=0)
    begin = np.flatnonzero(np.append(True, pairs[1:, 0] != pairs[:-1, 0]))
    nth = np.arange(len(pairs)) - np.repeat(begin, np.diff(np.append(begin, len(pairs))))
    kept = pairs[nth <= k]
    return kinds, kept[:, 1], np.searchsorted(kept[:, 0], np.arange(len(kinds) + 1))


def merge(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct ids of each row: rows, ids and scores, best first, ties to the smaller id."""
    order = np.lexsort((-scores, ids, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    once = np.append(True, (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])) if len(rows) else np.zeros(0, bool)
    rows, ids, scores = rows[once], ids[once], scores[once]
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    begin = np.searchsorted(rows, rows)
    top = np.arange(len(rows)) - begin < k
    return rows[top], ids[top], scores[top]

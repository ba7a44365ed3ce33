"""Whitening of vectors by Jacobi-Davidson, with the covariance never formed.

The fit list is every distinct integer vector floor(scale * c) once, held as blocks of rows.  The
only access to its covariance is the product of a few vectors with it: each block centres its rows
exactly, multiplies twice and gives a d x m sum; sums are added up by place on Spark, so a product
brings d * m numbers to the driver whatever the number of rows.

Jacobi-Davidson: Rayleigh-Ritz in a growing orthonormal subspace gives the leading pairs; a pair
whose residual has reached double precision is locked, in falling order.  Each of the others asks
for a correction t, orthogonal to the locked vectors and to the leading Ritz vectors, from
(I - QQ') (V - theta I) (I - QQ') t = -r, solved roughly by inner MINRES; all corrections of
a round run side by side, so one inner step is one distributed product.  The subspace grows by them
and restarts from its best Ritz vectors when it is full.  Locked pairs are measured once more
with a fresh product, and sent back if they do not hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskweave.llm.common import keep

SCALE = 256.0
BLOCK = 4096                       # rows of one matrix
BLOCKS = "rows int, x binary"
LIMIT = float(1 << 62)
EPS = np.finfo(float).eps


def usable(rows: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id, x (long entries) of the rows that take part."""
    whole = F.transform("embedding", lambda c: F.floor(F.lit(scale) * c.cast("double")))
    fits = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(F.lit(scale) * c.cast("double")) < LIMIT) & ~F.isnan(c))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(fits, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def commonest_length(rows: DataFrame) -> int | None:
    """The length that most vectors have (ties: the longer)."""
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return top[0].d if top else None


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(batches: Iterable[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def block(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["rows", "x"])

    for batch in batches:
        x = _matrix(batch.column("x"), d)
        for i in range(0, len(x), BLOCK):
            held.append(x[i:i + BLOCK])
            if sum(map(len, held)) >= BLOCK:
                yield block(np.concatenate(held))
                held = []
    if held:
        yield block(np.concatenate(held))


def _sums(batches: Iterable[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Exact sum of every dimension, as decimal text, and the number of rows as dimension -1."""
    total, n = np.zeros(d, object), 0
    for x in _matrices(batches, d):
        part = np.abs(x).max(initial=0)
        total += x.sum(0).astype(object) if float(part) * len(x) < LIMIT else x.astype(object).sum(0)
        n += len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(n), *map(str, total)], pa.string())], ["place", "total"])


def _matrices(batches: Iterable[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for x in batch.column("x"):
            yield np.frombuffer(x.as_buffer(), np.int64).reshape(-1, d)


@dataclass
class Centre:
    """Number and sum of the fit list; differences from its mean without rounding before the last step."""

    n: int
    total: list[int]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where they suffice, Python's elsewhere."""
        s = max(map(abs, self.total), default=0)
        if float(np.abs(x).max(initial=0)) * self.n + s < LIMIT:
            return x * np.int64(self.n) - np.array(self.total, np.int64)
        return x.astype(object) * self.n - np.array(self.total, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(float) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2 over the dimensions, exact; None where 64 bits cannot hold it."""
        y = self.scaled(x)
        if y.dtype != object and (y.astype(float) ** 2).sum(1).max(initial=0) < LIMIT:
            return (y * y).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in (sum(int(c) ** 2 for c in row) for row in y)]


def _partials(batches: Iterable[pa.RecordBatch], d: int, work: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sum over the partition's blocks of an array, one row an entry."""
    total = None
    for x in _matrices(batches, d):
        part = work(x).ravel()
        total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["place", "value"])


def _summed(blocks: DataFrame, d: int, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    parts = blocks.mapInArrow(partial(_partials, d=d, work=work), "place int, value double")
    got = parts.groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(int(np.prod(shape)))
    for r in got:
        out[r["place"]] = r["value"]
    return out.reshape(shape)


def _times(x: np.ndarray, centre: Centre, v: np.ndarray) -> np.ndarray:
    c = centre.centred(x)
    return c.T @ (c @ v)


def _squares(x: np.ndarray, centre: Centre) -> np.ndarray:
    return (centre.centred(x) ** 2).sum(keepdims=True)


def _gram(x: np.ndarray, centre: Centre, u: np.ndarray) -> np.ndarray:
    z = centre.centred(x) @ u
    return np.concatenate([z.sum(0)[None], z.T @ z])


def orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Columns of new made orthonormal to the basis and to each other; those that add nothing are left out."""
    out = basis
    for t in new.T:
        size = np.linalg.norm(t)
        if not np.isfinite(size) or size == 0:
            continue
        t = t / size
        for _ in range(3):
            t = t - out @ (out.T @ t)
            left = np.linalg.norm(t)
            if left < 1e-10:
                break
            t = t / left
        else:
            out = np.concatenate([out, t[:, None]], 1)
    return out[:, basis.shape[1]:]


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Rough solutions of symmetric systems A_j x_j = b_j, one a column, in lockstep: one product a step.

    product(block, columns) applies A_j to column j for those still active.  A column stops when its residual
    has fallen by `enough`.
    """
    d, m = right.shape
    x = np.zeros((d, m))
    beta = np.linalg.norm(right, axis=0)
    live = beta > 0
    safe = np.where(live, beta, 1.0)
    old, v = np.zeros((d, m)), right / safe
    eta, first = beta.copy(), beta.copy()
    c0 = c1 = np.ones(m)
    s0 = s1 = np.zeros(m)
    w0, w1, last = np.zeros((d, m)), np.zeros((d, m)), np.zeros(m)
    for _ in range(steps):
        active = np.flatnonzero(live)
        if not len(active):
            break
        p = np.zeros((d, m))
        p[:, active] = product(v[:, active], active)
        alpha = (v * p).sum(0)
        p = p - alpha * v - last * old
        following = np.linalg.norm(p, axis=0)
        delta = c1 * alpha - c0 * s1 * last
        rho1 = np.hypot(delta, following)
        rho2, rho3 = s1 * alpha + c0 * c1 * last, s0 * last
        live &= rho1 > 1e-300
        rho1 = np.where(live, rho1, 1.0)
        c0, s0, c1, s1 = c1, s1, np.where(live, delta / rho1, c1), np.where(live, following / rho1, s1)
        w0, w1 = w1, (v - rho3 * w0 - rho2 * w1) / rho1
        x = x + np.where(live, c1 * eta, 0.0) * w1
        eta = np.where(live, -s1 * eta, eta)
        live &= (np.abs(eta) > enough * first) & (following > 1e-14 * safe)
        old, v, last = v, np.where(following > 0, p / np.where(following > 0, following, 1.0), 0.0), following
    return x


@dataclass
class Pairs:
    """Leading eigenpairs, falling; vectors as columns; residual norms of a fresh product."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, scale: float, steps: int = 6, enough: float = 0.05, rounds: int = 200, seed: int = 11) -> Pairs:
    """The k leading eigenpairs of a symmetric positive semidefinite operator of size d by Jacobi-Davidson.

    product(block) applies it; scale is a bound of its size (its trace).  A residual counts as double
    precision at 16 * eps * sqrt(d) times the largest eigenvalue; where rounding in the products keeps it
    above, a pair is taken when its residual has not fallen any more in three rounds.
    """
    k, done, count = min(k, d), 0, 0

    def times(block: np.ndarray) -> np.ndarray:
        nonlocal count
        count += 1
        return product(block)

    most = min(d, max(4 * k + 8, 24))
    basis = orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, k + 4))), np.zeros((d, 0)))
    image = times(basis)
    stale, best = 0, np.inf
    for _ in range(rounds):
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, ::-1]
        values = values[::-1]
        ritz, moved = basis @ turn, image @ turn
        rest = moved - ritz * values
        sizes = np.linalg.norm(rest[:, :k], axis=0)
        goal = 16 * EPS * np.sqrt(d) * max(values[0], scale * EPS)
        while done < k and sizes[done] <= goal:
            done += 1                                   # locked: no further correction
        open_ = np.arange(done, k)
        if len(open_):
            worst = sizes[open_].max()
            stale, best = (0, worst) if worst < best * 0.5 else (stale + 1, best)
        if not len(open_) or stale >= 3 and best <= 1e4 * goal:
            held = times(ritz[:, :k])                   # a fresh product: what the subspace remembers may have drifted
            values_k = (ritz[:, :k] * held).sum(0)
            sizes = np.linalg.norm(held - ritz[:, :k] * values_k, axis=0)
            if (sizes <= 64 * goal).all() or stale >= 3:
                order = np.argsort(-values_k, kind="stable")
                return Pairs(values_k[order], ritz[:, :k][:, order], sizes[order], count)
            done, basis, image = 0, ritz[:, :k], held
            continue
        if basis.shape[1] + len(open_) > most:          # restart from the best Ritz vectors
            few = min(basis.shape[1], k + 4)
            basis, image = ritz[:, :few], moved[:, :few]
        aside = ritz[:, :k]                             # locked vectors and the leading Ritz vectors

        def clean(t: np.ndarray) -> np.ndarray:
            t = t - aside @ (aside.T @ t)
            return t - aside @ (aside.T @ t)

        correction = minres(lambda t, columns: clean(times(t) - t * values[open_[columns]]), -clean(rest[:, open_]), steps, enough)
        new = orthonormal(correction, basis)
        if not new.shape[1]:                            # the subspace holds all corrections: only rounding is left
            new = orthonormal(np.random.default_rng(count).standard_normal((d, 1)), basis)
        if new.shape[1]:
            basis, image = np.concatenate([basis, new], 1), np.concatenate([image, times(new)], 1)
        elif basis.shape[1] >= d:
            image = times(basis)
    raise ArithmeticError("eigenpairs did not settle")


@dataclass
class Model:
    """What whitens: centre, directions already divided by the root of their eigenvalue, and the measures."""

    d: int
    centre: Centre
    pairs: Pairs
    explained: list[float]
    identity_error: float


def fit(rows: DataFrame, components: int) -> Model | None:
    """The model of usable rows (vec_id, x), all of one length; None without rows.

    Directions along which nothing varies (below 1e-12 of the trace) have no whitened value and are left out.
    """
    d = commonest_length(rows)
    if d is None:
        return None
    distinct = rows.where(F.size("x") == d).select("x").distinct()
    blocks = keep(distinct.mapInArrow(partial(_blocks, d=d), BLOCKS), "blocks")
    sums = blocks.select("x").mapInArrow(partial(_sums, d=d), "place int, total string")
    sums = {r.place: int(r.total) for r in sums.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    centre = Centre(sums[-1], [sums[i] for i in range(d)])
    x = blocks.select("x")
    n = centre.n
    trace = float(_summed(x, d, partial(_squares, centre=centre), (1,))[0]) / n
    if trace == 0:
        return Model(d, centre, Pairs(np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0), [], 0.0)
    product = lambda v: _summed(x, d, partial(_times, centre=centre, v=v), v.shape) / n
    pairs = leading(product, d, components, trace)
    real = pairs.values > 1e-12 * trace
    pairs = Pairs(pairs.values[real], pairs.vectors[:, real], pairs.residuals[real], pairs.products)
    unit = pairs.vectors / np.sqrt(pairs.values)
    m = unit.shape[1]
    measured = _summed(x, d, partial(_gram, centre=centre, u=unit), (m + 1, m)) / n
    covariance = measured[1:] - np.outer(measured[0], measured[0])
    return Model(d, centre, pairs, (pairs.values / trace).tolist(), float(np.abs(covariance - np.eye(m)).max(initial=0.0)))


WHITENED = "vec_id long, n long, deviation long, whitened array<double>"


def _whiten(batches: Iterable[pa.RecordBatch], d: int, centre: Centre, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(i, BLOCK)
            x = _matrix(rows.column("x"), d)
            z = centre.centred(x) @ unit
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * unit.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("vec_id"), pa.array([centre.n] * len(x), pa.int64()), pa.array(centre.deviation(x), pa.int64()), whitened], ["vec_id", "n", "deviation", "whitened"])


def whiten(rows: DataFrame, components: int = 4, scale: float = SCALE) -> DataFrame:
    """vec_id, n, deviation and whitened (one value a component), with explained and identity_error, of every usable row.

    rows: vec_id, embedding.  Vectors null, empty, with null or non-finite entries or with entries beyond 64
    bits once scaled take no part, nor do those of another length than the commonest (ties: the longer).
    Rows with a null id are whitened too, repeated rows each.  Fewer dimensions or fewer directions
    of variation give fewer components; no variation at all gives none.  deviation is null where 64
    bits cannot hold it.
    """
    clean = usable(rows, scale)
    model = fit(clean, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], WHITENED + ", explained array<double>, identity_error double")
    unit = model.pairs.vectors / np.sqrt(model.pairs.values)
    out = clean.where(F.size("x") == model.d).mapInArrow(partial(_whiten, d=model.d, centre=model.centre, unit=unit), WHITENED)
    explained = F.array(*map(F.lit, model.explained)).cast("array<double>")
    return out.withColumn("explained", explained).withColumn("identity_error", F.lit(model.identity_error))

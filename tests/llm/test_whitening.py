"""Whitening against a dense eigenvalue solver and exact integers."""

import numpy as np
import pytest
from pyspark.sql import types as T

from riskweave.llm import whitening
from riskweave.llm.queries import op12_jacobi_davidson

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("n", T.StringType()), T.StructField("x", T.StringType())])


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "s", "t") for i, v in vectors], ROWS)


@pytest.mark.parametrize("d,k,values", [
    (64, 4, None), (30, 4, [5.0] * 5 + [1.0] * 25), (3, 4, None), (10, 4, [1.0] * 10), (64, 4, np.linspace(1, 1.3, 64)), (40, 4, [1e6, 1.0, 0.99] + [0.5] * 37), (20, 2, [1.0] + [0.0] * 19)])
def test_jacobi_davidson_reaches_double_precision(d, k, values):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = np.sort(rng.random(d) if values is None else np.array(values))[::-1]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    found = whitening.leading(lambda v: a @ v, d, k, float(np.trace(a)))
    k = min(k, d)
    assert np.abs(found.values - e[:k]).max() < 1e-13 * e[0] * d
    assert (found.residuals < 64 * 16 * 2.3e-16 * np.sqrt(d) * e[0]).all()
    assert np.abs(found.vectors.T @ found.vectors - np.eye(k)).max() < 1e-13


def test_minres_solves_several_systems_side_by_side():
    rng = np.random.default_rng(1)
    matrices = [(lambda m: m + m.T)(rng.standard_normal((12, 12))) for _ in range(3)]
    right = rng.standard_normal((12, 3))
    x = whitening.minres(lambda t, columns: np.stack([matrices[c] @ t[:, i] for i, c in enumerate(columns)], 1), right, 60, 1e-12)
    for j, m in enumerate(matrices):
        assert np.linalg.norm(m @ x[:, j] - right[:, j]) < 1e-7


def dense(x, k):
    distinct = np.unique(x, axis=0)
    c = distinct - distinct.mean(0)
    e, w = np.linalg.eigh(c.T @ c / len(distinct))
    return distinct, e[::-1][:k], (x - distinct.mean(0)) @ w[:, ::-1][:, :k] / np.sqrt(e[::-1][:k]), e.sum()


def test_query_equals_the_dense_solver(spark, small):
    got = op12_jacobi_davidson(spark, small).toPandas().sort_values(["vec_id", "component"])
    rows = spark.read.parquet(f"{small}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(256 * np.array(rows.embedding.tolist(), float)).astype(np.int64)
    distinct, e, z, trace = dense(x, 4)
    mine = got.whitened.to_numpy().reshape(-1, 4)
    assert np.abs(mine - z * np.sign((mine * z).sum(0))).max() < 1e-10
    assert got.vec_id.tolist() == np.repeat(rows.vec_id, 4).tolist() and got.component.tolist() == [1, 2, 3, 4] * len(rows)
    exact = [sum((len(distinct) * int(c) - int(s)) ** 2 for c, s in zip(row, distinct.sum(0))) for row in x]
    assert got.deviation.tolist() == np.repeat(exact, 4).tolist() and set(got.n) == {len(distinct)}
    assert np.abs(got.explained.to_numpy().reshape(-1, 4) - e / trace).max() < 1e-12
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-12


def test_copies_count_once_and_unusable_rows_go(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(80)]
    copies = [(1000 + i, good[3][1]) for i in range(200)] + [good[5], (None, good[6][1])]
    bad = [(300, None), (301, []), (302, [None] + [1.0] * 5), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (305, [1.0, 2.0]), (306, [3e38] * 6)]
    got = whitening.whiten(table(spark, good + copies + bad)).collect()
    assert len(got) == len(good) + len(copies) and {r.n for r in got} == {80}
    x = np.floor(256 * np.array([v for _, v in good], float)).astype(np.int64)
    z = dense(x, 4)[2]
    mine = {r.vec_id: r.whitened for r in got}
    one = np.array([mine[i] for i in range(80)])
    assert np.abs(one - z * np.sign((one * z).sum(0))).max() < 1e-10
    assert mine[1000] == mine[3]


def test_little_or_no_variation(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None)])).count() == 0
    same = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened) for r in same] == [(1, 0, []), (1, 0, [])]
    line = whitening.whiten(table(spark, [(1, [1.0, 2.0, 0.0]), (2, [2.0, 4.0, 0.0]), (3, [3.0, 6.0, 0.0])])).collect()
    assert all(len(r.whitened) == 1 and abs(r.explained[0] - 1) < 1e-12 for r in line)


def test_deviation_is_exact_or_null(spark):
    rows = [(1, [2.0 ** 40]), (2, [-(2.0 ** 40)]), (3, [0.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(table(spark, rows)).collect()}
    assert got == {1: None, 2: None, 3: 0}            # (3 * 2 ** 48) ** 2 is beyond a long
    centre = whitening.Centre(3, [5])
    assert centre.deviation(np.array([[10 ** 9], [-(10 ** 9)]])) == [(3 * 10 ** 9 - 5) ** 2, None if (3 * 10 ** 9 + 5) ** 2 >= 1 << 63 else (3 * 10 ** 9 + 5) ** 2]

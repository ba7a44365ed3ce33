"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import types as T

from riskweave.llm import m_tree, vp_search

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType()), T.StructField("rank", T.IntegerType())])


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "s", 0) for i, v in vectors], ROWS)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 12))
    x = [(i, (centres[i % 6] + 0.4 * rng.standard_normal(12)).astype(np.float32).tolist()) for i in range(900)]
    same = [1.0] * 12
    x += [(i, same) for i in range(900, 1200)]                                   # copies: ties
    return x + [(2000, None), (2050, []), (2100, [0.0] * 12), (2150, [None] + [1.0] * 11), (2200, [float("nan")] * 12), (2250, [float("inf")] * 12), (None, same)]


def clean(vectors):
    ok = [(i, v) for i, v in vectors if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    return np.array([i for i, _ in ok]), np.array([np.float32(v) for _, v in ok], float)


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_m_tree_is_exact(spark, vectors):
    ids, x = clean(vectors)
    whole = np.floor(1024 * x).astype(np.int64)
    want = {}
    for q in np.flatnonzero(ids % 100 == 0):
        s = whole @ whole[q]
        want[int(ids[q])] = [(k + 1, int(ids[j]), int(s[j])) for k, j in enumerate([j for j in np.lexsort((ids, -s)) if j != q][:10])]
    for size in (4096, 250):
        assert rows_of(m_tree.top_products(table(spark, vectors), 100, 10, shard_rows=size, block_rows=5)) == want


def test_vantage_points(spark, vectors):
    ids, x = clean(vectors)
    ids, x = ids[(x != 0).any(1)], x[(x != 0).any(1)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = np.round(unit @ unit[q], 12)
        want[int(ids[q])] = [int(ids[j]) for j in np.lexsort((ids, -s)) if j != q][:5]
    exact = rows_of(vp_search.nearest(table(spark, vectors), 50, 5, factor=1.0, shard_rows=400, block_rows=10))
    assert {q: [v for _, v, _ in r] for q, r in exact.items()} == want
    quick = rows_of(vp_search.nearest(table(spark, vectors), 50, 5))
    hits = sum(len({v for _, v, _ in quick[q]} & set(w)) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    at = {int(i): k for k, i in enumerate(ids)}
    for q, r in quick.items():
        for _, v, s in r:
            assert abs(s - unit[at[q]] @ unit[at[v]]) < 1e-9


def test_few_and_no_rows(spark):
    few = table(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5])])
    assert [tuple(r) for r in m_tree.top_products(few, 100, 10).collect()] == [(0, 1, 1, 512 * 1024)]
    assert [(r.query_id, r.vec_id) for r in vp_search.nearest(few, 50, 5).collect()] == [(0, 1)]
    for search in (m_tree.top_products, vp_search.nearest):
        assert search(table(spark, []), 100, 10).count() == 0


def test_equal_cosines_go_to_the_smaller_id(spark):
    """Thirty multiples of one direction: all score one, and the first five are asked for."""
    rows = [(i, [2.0 ** (i % 15) * c for c in (1.0, 2.0, 3.0, 4.0)]) for i in range(30)] + [(100, [4.0, 3.0, 2.0, 1.0])]
    for size in (4096, 4):
        got = rows_of(vp_search.nearest(table(spark, rows), 50, 5, factor=1.0, shard_rows=size))
        assert [v for _, v, _ in got[0]] == [1, 2, 3, 4, 5] and {s for _, _, s in got[0]} == {1.0}


def test_an_id_that_several_rows_carry(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0])]
    for size in (4096, 1):
        assert [(r, v) for r, v, _ in rows_of(vp_search.nearest(table(spark, rows), 50, 5, factor=1.0, shard_rows=size))[0]] == [(1, 1), (2, 2), (3, 3)]
        got = rows_of(m_tree.top_products(table(spark, rows), 50, 10, shard_rows=size))[0]
        assert [(r, v) for r, v, _ in got] == [(1, 1), (2, 2), (3, 3)] and got[0][2] == 1024 * 1024


def test_lengths_and_sizes_that_do_not_fit(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 1.0, 1.0]), (3, [3e38, 3e38]), (4, [0.5, 0.0])]
    near = rows_of(vp_search.nearest(table(spark, rows), 50, 5, factor=1.0))[0]
    assert [v for _, v, _ in near] == [4, 1, 3]                       # huge entries have a direction
    assert [v for _, v, _ in rows_of(m_tree.top_products(table(spark, rows), 50, 10))[0]] == [1, 4]      # but no product


def test_far_shards_are_not_asked(spark, tmp_path):
    """With rows in tight, far groups, a query meets its own group alone."""
    from riskweave.llm import vectors as vc
    rng = np.random.default_rng(5)
    centres = np.eye(8)
    x = [(i, (centres[i % 8] * 10 + 0.01 * rng.standard_normal(8)).tolist()) for i in range(1600)]
    asked = []
    whole = vc._reached

    def counted(*args, **kwargs):
        for out in whole(*args, **kwargs):
            asked.append(out.num_rows)
            yield out
    space = vc.Space(vp_search.units, vp_search.units, vp_search._reach, None, None, "double")
    unit = vp_search.units(np.array([v for _, v in x]))
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0]), pa.array([x[0][1]], pa.list_(pa.float64())), pa.array([0.9999])], ["cell", "vec_id", "v", "bound"])
    radius = np.array([np.linalg.norm(unit[k::8] - centres[k], axis=1).max() for k in range(8)])
    list(counted([batch], space, centres, radius, np.arange(8), np.ones(8, int), 1.0))
    assert sum(asked) == 0
    want = np.argsort(-(unit @ unit[0]), kind="stable")[1:6].tolist()
    assert [v for _, v, _ in rows_of(vp_search.nearest(table(spark, x), 400, 5, factor=1.0, shard_rows=200))[0]] == want


def test_recall_on_a_table(spark):
    from riskweave.llm.queries import op2_vp_search, op9_m_tree
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = rows_of(op2_vp_search(spark, folder))
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        want = [int(ids[j]) for j in np.argsort(-(unit @ unit[q])) if j != q][:5]
        hits += len({v for _, v, _ in got[int(ids[q])]} & set(want))
    assert hits >= 0.9 * 5 * len(got) and len(got) == 10
    assert op9_m_tree(spark, folder).count() == 50

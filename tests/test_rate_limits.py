"""Anchored windows in slices against a plain walk over the requests."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.streaming import rate_limits as rl
from tests.test_streams import T0, stream

REQUESTS = "id bigint, ip string, ts timestamp"


def walk(rows, rule):
    """{id: (count, allowed)} by the rule's own words."""
    out, state = {}, {}
    for i, key, us in sorted(rows, key=lambda r: (str(r[1]), rl.UNTIMED if r[2] is None else r[2], r[0])):
        if key not in state:
            state[key] = [0, None if us is None else us + rule.window_us]
        elif us is not None and (state[key][1] is None or (us > state[key][1] if rule.counted else us >= state[key][1])):
            state[key] = [0, us + rule.window_us]
        allowed = state[key][0] < rule.limit
        if allowed or rule.counted:
            state[key][0] += 1
        out[i] = (state[key][0], allowed)
    return out


def requests(n, seed, keys=("a", "b", "c", None), hot="a", span=4000):
    rnd = random.Random(seed)
    return [(i, hot if rnd.random() < 0.6 else rnd.choice(keys), None if rnd.random() < 0.02 else rnd.randrange(span)) for i in range(n)]


@pytest.mark.parametrize("counted", [True, False])
def test_array_operations_equal_the_walk(counted):
    for seed in range(60):
        rule = rl.Rule(3, random.Random(seed).choice([1, 7, 50, 900, 5000]), counted)
        rows = sorted((str(k), rl.UNTIMED if us is None else us, i) for i, k, us in requests(80, seed, span=random.Random(seed + 1).choice([5, 300, 4000])))
        names = sorted({k for k, _, _ in rows})
        segment, us = np.array([names.index(k) for k, _, _ in rows]), np.array([u for _, u, _ in rows])
        done = rl.count(segment, us, np.full(len(names), rl.OPEN), np.full(len(names), -1), rule)
        want = walk([(i, k, None if u == rl.UNTIMED else u) for k, u, i in rows], rule)
        assert [(int(r) if counted else min(int(r), 3), bool(r <= 3)) for r in done.rank] == [want[i] for _, _, i in rows]
        # cut anywhere, the step function of the second part gives the same end as the whole
        one = us[segment == 0]
        for cut in range(1, len(one)):
            head = rl.count(np.zeros(cut, np.int64), one[:cut], np.array([rl.OPEN]), np.array([-1]), rule)
            tail = rl.count(np.zeros(len(one) - cut, np.int64), one[cut:], head.expiry, head.count, rule)
            assert np.concatenate([head.rank, tail.rank]).tolist() == done.rank[segment == 0].tolist()
            until, expiries, counts = rl.transition(one[cut:], rule)
            at = int(np.searchsorted(np.array(until, np.int64), head.expiry[0], "right" if counted else "left"))
            got = (expiries[at], counts[at]) if at < len(until) else (int(head.expiry[0]), int(head.count[0]) + len(one) - cut)
            assert got == (int(tail.expiry[0]), int(tail.count[0]))


@pytest.mark.parametrize("counted", [True, False])
def test_slices_of_a_hot_key(spark, counted):
    rule = rl.Rule(4, 60, counted)
    rows = requests(900, 3)
    df = spark.createDataFrame([(i, "null" if k is None else f"={k}", rl.UNTIMED if u is None else u) for i, k, u in rows], "id long, key string, us long")
    ranked, ends = rl.windows_of(df, rule, slice_rows=40)
    got = {r.id: (r["count"], r.allowed) for r in rl.outcomes(ranked, rule).collect()}
    assert got == walk(rows, rule)
    assert {r.key for r in ends.collect()} == {"=a", "=b", "=c", "null"} and ends.count() == 4
    # the hot key is dealt over at least as many tasks as its rows fill slices
    hot = df.repartitionByRange(-(-900 // 40), *rl.ORDER).withColumn("part", F.spark_partition_id()).where("key = '=a'")
    assert hot.select("part").distinct().count() >= 10


@pytest.mark.parametrize("counted", [True, False])
def test_batches_reversed_split_and_repeated(spark, tmp_path, counted):
    rule = rl.Rule(2, 3600 * 1_000_000, counted)
    rows = [(i, f"ip{i % 2}" if i % 7 else None, T0 + dt.timedelta(seconds=700 * i) if i != 11 else None) for i in range(24)]
    micro = lambda t: None if t is None else int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    want = walk([(i, k, micro(t)) for i, k, t in rows], rule)
    for n, chunks in enumerate(([rows], [rows[8:16], rows[16:], rows[:8]], [rows[i::3][::-1] for i in range(3)])):
        s = stream(spark, tmp_path / str(n), chunks, REQUESTS)
        got = rl.rate_limit(s, 2, 3600, counted, slice_rows=5).collect()
        assert {r.id: (r["count"], r.allowed) for r in got} == want and len(got) == 24
        assert {r.id for r in got if r.ip is None} == {0, 7, 14, 21}
    path = str(tmp_path / "again")
    handler, half = rl.count_batch(path, rule, 5), [rl.keyed(spark.createDataFrame(c, REQUESTS)) for c in (rows[:12], rows[12:])]
    for batch_id in (0, 1, 1):
        handler(half[batch_id], batch_id)
    assert {r.id: (r["count"], r.allowed) for r in rl.told(spark, path, rule).collect()} == want

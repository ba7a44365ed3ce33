"""Positions and pages from slices against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import analytics as an
from riskweave.operators.order_statistics import ordered

def order():
    return [F.desc_nulls_last("score"), F.asc("id")]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    return [(rnd.choice(["hot"] * 6 + ["b", "c"]), rnd.choice([None, 1.0, 2.0, 2.0, 3.5]), f"id{i:05d}") for i in range(3000)] + [("one", 1.0, "x")]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "scan string, score double, id string").repartition(7)


def lists(rows):
    out = {}
    for scan, score, i in sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else float("-inf")), r[2])):
        out.setdefault(scan, []).append(i)
    return out


def test_positions(table, rows):
    got = {(r.scan, r.position): r.id for r in ordered(table, ["scan"], order(), slice_rows=100).positions().collect()}
    assert got == {(scan, n + 1): i for scan, ids in lists(rows).items() for n, i in enumerate(ids)}


def test_pages_and_bookmarks(spark, table, rows):
    found, want = ordered(table, ["scan"], order(), slice_rows=100), lists(rows)
    for number in (1, 3, 40, 200):
        got = {}
        for r in found.page(number, 10).collect():
            got.setdefault(r.scan, {})[r.position] = r.id
            assert (r.page, r.total, r.total_pages) == (number, len(want[r.scan]), -(-len(want[r.scan]) // 10))
        assert got == {s: {p + 1: ids[p] for p in range((number - 1) * 10, min(number * 10, len(ids)))} for s, ids in want.items() if len(ids) > (number - 1) * 10}
    marks = spark.createDataFrame([("hot", want["hot"][1499]), ("b", want["b"][-2]), ("c", "unknown")], "scan string, id string")
    got = sorted((r.scan, r.position, r.id) for r in found.after(marks, "id", 5).collect())
    assert got == [("b", len(want["b"]), want["b"][-1])] + [("hot", p + 1, want["hot"][p]) for p in range(1500, 1505)]


def test_without_a_scope_and_without_rows(table, rows):
    all_ids = [i for _, _, i in sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else float("-inf")), r[2]))]
    got = ordered(table, [], order(), slice_rows=200).page(11, 100).collect()
    assert sorted((r.position, r.id) for r in got) == list(zip(range(1001, 1101), all_ids[1000:1100])) and {r.total for r in got} == {3001}
    assert ordered(table.limit(0), ["scan"], order()).positions().count() == 0 and ordered(table.limit(0), [], order()).page(1, 5).count() == 0


def test_a_deep_page_sorts_no_list_in_one_task(spark):
    """Page 10,000 of a scan that holds nearly all rows: slices of bounded size, no window over the rows."""
    many = spark.range(210_000).select(F.when(F.col("id") % 100 == 0, "cold").otherwise("hot").alias("scan"), F.col("id"), (F.col("id") * 7919 % 1000).alias("score"))
    deep = an.page_per_scope(many, "scan", [F.desc("score"), F.asc("id")], 10_000, 20)
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort [score" not in plan
    got = sorted((r.position, r.id) for r in deep.collect())
    hot = sorted((i for i in range(210_000) if i % 100), key=lambda i: (-(i * 7919 % 1000), i))
    assert got == [(p + 1, hot[p]) for p in range(199_980, 200_000)]
    cut = ordered(many, ["scan"], [F.desc("score"), F.asc("id")], slice_rows=20_000)
    sizes = [r["count"] for r in cut.rows.groupBy("_slice").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 60_000

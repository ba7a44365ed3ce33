"""Joins of many rows with many: all pairs, spread over the tasks."""

from collections import Counter

from pyspark.sql import functions as F

from riskweave.operators import detection as d, governance as go
from riskweave.operators.spread_join import spread_join


def test_all_pairs_with_repeated_rows_and_null_keys(spark):
    left = [(k, i) for k, n in (("a", 25), ("b", 1), ("c", 4)) for i in range(n)] + [("a", 3), (None, 1)]
    right = [(k, i) for k, n in (("a", 13), ("b", 3), ("x", 2)) for i in range(n)] + [("a", 5), (None, 1)]
    out = spread_join(spark.createDataFrame(left, "k string, l int"), spark.createDataFrame(right, "k string, r int"), ["k"], ["l"], ["r"], 4, 3)
    assert Counter(map(tuple, out.select("k", "l", "r").collect())) == Counter((k, a, b) for k, a in left for h, b in right if k == h and k is not None)


def test_one_hot_version_costs_many_tasks(spark):
    deps = spark.range(9000).select(F.concat(F.lit("s"), "id").alias("scan_id"), F.lit("f").alias("file_path"), F.lit("npm").alias("ecosystem"), F.lit("p").alias("package"), F.lit("1").alias("version"))
    advisories = spark.range(1500).select(F.lit("npm").alias("ecosystem"), F.lit("p").alias("package"), F.lit("1").alias("version"), F.col("id").alias("rank"), F.col("id").cast("string").alias("vuln_id")).coalesce(1)
    found = d.match_advisories(deps.coalesce(1), advisories).select("scan_id", "nth")
    got = found.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.max("nth").alias("nth")).collect()
    assert len(got) > 1 and sum(r.n for r in got) == 9000 * 1500 and max(r.nth for r in got) == 1500


def test_texts_of_one_side_are_made_below_the_join(spark):
    deps = spark.createDataFrame([("s", "package.json", "npm", "p", "1", "^1", "x"), ("t", "requirements.txt", "PyPI", "q", "2", "2", "y")],
                                 "scan_id string, file_path string, ecosystem string, package string, version string, declared string, snippet string")
    advisories = spark.createDataFrame([("npm", "p", "1", 1.0, "V1", None), ("npm", "p", "1", 1.0, None, "two"), ("PyPI", "q", "2", 0.0, "V3", "three")],
                                       "ecosystem string, package string, version string, rank double, vuln_id string, summary string")
    found = d.advisory_findings(deps, advisories)
    got = sorted(tuple(r) for r in found.select("scan_id", "rule_id", "title", "source", "poc", "secure_example", "why_vulnerable", "seq.file_path", "seq.hit_ord").collect())
    assert [r[:4] for r in got] == [("s", "V1", "Vulnerable dependency", "p@^1"), ("s", "dependency-vulnerability", "two", "p@^1"), ("t", "V3", "three", "q==2")]
    assert [r[4:] for r in got] == [("V1", '"p": "<patched_version>"', "OSV returned advisory V1 for p@^1.", "0:p:1", 2),
                                    ("See advisory", '"p": "<patched_version>"', "OSV returned advisory unknown for p@^1.", "0:p:1", 1),
                                    ("V3", "q==<patched_version>", "OSV returned advisory V3 for q==2.", "1:q:2", 1)]
    plan = found.select("scan_id", "rule_id", "title", "source")._jdf.queryExecution().executedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(plan) if "Join" in line)
    assert not any("concat_ws" in line for line in plan[:join]) and any("concat_ws" in line for line in plan[join:])


def test_notices_of_a_deleted_project_are_told_once(spark):
    deleted = spark.createDataFrame([(1, "one", 7, "u1", "u9"), (1, "one", 7, "u1", "u9"), (2, "two", 7, None, "u2"), (3, "x", 7, "u5", "u9"), (3, "x", 8, "u1", "u9"), (None, "n", 8, "u4", "u4")],
                                    "project_id int, name string, organization_id int, created_by string, actor_id string")
    members = spark.createDataFrame([(7, "u1"), (7, "u1"), (7, "u2"), (7, "u9"), (7, None), (8, "u1"), (8, "u4")], "organization_id int, user_id string")
    out = go.project_deleted_notifications(deleted, members)
    got = Counter((r.user_id, r.message) for r in out.collect())
    assert got == Counter([("u1", "one was deleted."), ("u2", "one was deleted."), (None, "one was deleted."), ("u1", "two was deleted."), ("u9", "two was deleted."), (None, "two was deleted."),
                           ("u1", "x was deleted."), ("u2", "x was deleted."), ("u4", "x was deleted."), ("u5", "x was deleted."), (None, "x was deleted."), ("u1", "n was deleted.")])
    plain = go.project_deleted_notifications(deleted.filter("project_id = 2"), members)._jdf.queryExecution().optimizedPlan().toString()
    assert "Deduplicate" not in plain

"""Reports of narrow rows: the same lines, and no text below a join."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from riskweave.operators import order_statistics
from riskweave.plans import registry
from riskweave.sources import external_reports as xr, reports as rp
from riskweave.views import Views

_ITEMS = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
          "l_returnflag string, l_linestatus string, l_shipdate timestamp")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Four findings for each of 30 scans, some of them twice, two scans without any seq."""
    root, day = tmp_path_factory.mktemp("rows"), dt.datetime(1995, 1, 1)
    rows = [(o, 7 * o + n, 3 * o + n, n, float(n * 11), 100.0 * n, 0.05, "ANR"[n % 3], "FO"[o % 2], day + dt.timedelta(n % 2)) for o in range(30) for n in range(1, 5)]
    rows += rows[:6] + [(40, n, n, n, 1.0, None, 0.0, "A", "F", day) for n in (1, 2)] + [(41, None, 1, 1, 1.0, 1.0, 0.0, "A", "F", day)]
    spark.createDataFrame(rows, _ITEMS).write.parquet(f"{root}/lineitem.parquet")
    return Views(spark, str(root))


def _scans(spark):
    return spark.range(45).select(F.col("id").alias("scan_id"), F.lit("done").alias("status"), F.lit("Low").alias("risk_level"), F.lit(5.0).alias("risk_percent"),
                                  F.lit("paste").alias("source_type"), F.lit("[]").alias("source_value"))


@pytest.mark.parametrize("report", [
    lambda s, f, **k: rp.service_json(s, f, "now", **k), lambda s, f, **k: rp.executive_json(s, f, "u", "now", **k), lambda s, f, **k: rp.service_sarif(s, f, "now", **k),
    lambda s, f, **k: rp.dashboard_sarif(s, f, **k), lambda s, f, **k: rp.executive_json(s, f, "u", "now", short=True, **k)])
def test_narrow_rows_give_the_same_lines(spark, folder, report):
    whole = sorted(map(str, report(_scans(spark), folder.scan_findings).collect()))
    assert sorted(map(str, report(_scans(spark), folder.finding_rows, texts=folder.finding_texts).collect())) == whole


def test_rules_without_a_first_finding_keep_their_scan(folder):
    shown = lambda df: sorted(map(str, df.select("scan_id", "rule", "rule_index", "f.title", "f.severity").collect()))
    narrow = rp.rules_registry(folder.finding_rows, folder.finding_texts)
    assert shown(narrow) == shown(rp.rules_registry(folder.scan_findings))
    assert {(r["scan_id"], r["f"]) for r in narrow.where("first_seq is null").collect()} == {(40, None), (41, None)}


def test_texts_are_made_behind_the_join(spark, folder, request):
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.debug.maxToStringFields"))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = rp.service_json(_scans(spark), folder.finding_rows, "now", texts=folder.finding_texts)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    join = next(i for i, line in enumerate(lines) if "Join Inner" in line)
    assert any("Fix rule" in line for line in lines[:join]) and not any("Fix rule" in line for line in lines[join:])


def test_results_are_those_of_the_report(spark, folder):
    whole = rp.service_sarif(_scans(spark), folder.scan_findings, "now").where("section = 3")
    assert sorted(map(str, rp.sarif_results(folder.finding_rows, folder.finding_texts).collect())) == sorted(map(str, whole.collect()))


def test_empty_traces_are_no_related_locations(spark, folder):
    lines = rp.sarif_results(folder.scan_findings.withColumn("dataflow_trace", F.lit(" [ ] "))).select("line")
    assert lines.where(F.col("line").contains("relatedLocations")).count() == 0
    lines = rp.sarif_results(folder.scan_findings.withColumn("dataflow_trace", F.lit(' [ {"line": 2}]')))
    assert lines.where(F.col("line").contains('"text":"Step 0"')).count() == lines.count()


def test_trivy_items_are_rows_before_they_are_worked_out(spark):
    text = '{"Results":[{"Vulnerabilities":[{"VulnerabilityID":"CVE-1"},{"VulnerabilityID":"CVE-2","Title":"T"}],"Misconfigurations":[{"ID":"D"}]},{"Target":"t","Secrets":[{"RuleID":"k"}]},{}]}'
    found = xr.trivy_findings(spark.createDataFrame([("s", text), ("t", "{"), ("u", None)], "scan_id string, report string"))
    assert not re.search(r"lambda", found._jdf.queryExecution().optimizedPlan().toString())
    got = [tuple(r) for r in found.orderBy("scan_id", "seq").select("rule_id", "title", "file_path", "seq.rule_ord", "seq.hit_ord").collect()]
    assert got == [("CVE-1", "CVE-1", "", 0, 0), ("CVE-2", "T", "", 0, 1), ("D", "Configuration issue", "", 2, 0), ("k", "Secret detected", "t", 1, 0)]


@pytest.mark.parametrize("name", ["o1_deep_page_per_severity", "o1_deep_page_global"])
def test_deep_pages_stage_what_they_show(spark, small, monkeypatch, name):
    seen = []
    monkeypatch.setattr(order_statistics, "stage", lambda df, what: seen.append((what, set(df.columns))) or df.localCheckpoint())
    registry.callables()[name](spark, small).count()
    assert dict(seen)["slices"] == {"id", "severity", "cvss4_score", "created_at", "_slice", "_place"}


def test_findings_of_projects_are_made_behind_their_join(spark, tmp_path):
    day = dt.datetime(1995, 1, 1)
    rows = [(o, 7 * o + n, 3 * o + n, n, float(n * 11), 100.0 * n, 0.05, "ANR"[n % 3], "FO"[o % 2], day + dt.timedelta(n)) for o in (1, 2, 3, 4) for n in (1, 2)]
    spark.createDataFrame(rows + rows[:1] + [(None, 1, 1, 1, 1.0, 1.0, 0.0, "A", "F", day), (3, None, 1, 1, 1.0, None, 0.0, "A", "F", day)], _ITEMS).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 9), (2, 9), (2, 9), (3, None), (None, 8)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    v = Views(spark, str(tmp_path))
    assert v.project_findings.columns == v.findings.columns
    assert sorted(map(str, v.project_findings.collect())) == sorted(map(str, v.findings.collect())) and v.findings.count() == 3 + 4 + 3
    lines = registry.QUERIES["j1_carry_forward"](v)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(re.match(r"[ :+-]*", line).group())
    below = [i for i, line in enumerate(lines) if re.search(r"Join Inner", line)]
    assert len(below) == 2
    for i in below:
        end = next((k for k in range(i + 1, len(lines)) if depth(lines[k]) <= depth(lines[i])), len(lines))
        assert not any("AS dedupe_hash" in line or " AS id" in line for line in lines[i:end])


def test_what_is_counted_and_named_is_shuffled_in_few_rows(spark, folder, monkeypatch):
    seen = {}
    monkeypatch.setattr(rp, "stage", lambda df, what: seen.setdefault(what, df.localCheckpoint()))
    items = folder.lineitem.count()
    twice = _scans(spark).union(_scans(spark).where("scan_id in (3, 44)")).union(_scans(spark).limit(1).withColumn("scan_id", F.lit(None).cast("long")))
    out = rp.executive_json(twice, folder.finding_rows, "u", "now", texts=folder.finding_texts)
    # two cells a finding at most, and the head is written from the staged counts without a join
    assert seen["cells"].count() <= 2 * items and seen["cells"].agg(F.sum("n")).first()[0] == 2 * items
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    heads = {r["scan_id"]: r["n"] for r in out.where("section = 0").groupBy("scan_id").agg(F.count("*").alias("n")).collect()}
    assert None not in heads and heads[1] == 1 and heads[3] == 4 and heads[44] == 4 and len(heads) == 45
    assert out.where("section = 1 and scan_id = 3").count() == 2 * folder.lineitem.where("l_orderkey = 3").count()
    cells = rp.report_cells(folder.scan_findings)
    assert cells.count() == cells.select("scan_id", "kind", "key", "state").distinct().count()
    # the position stands once beside a rule's first row, and goes into the results for the first rule alone
    rp.service_sarif(_scans(spark), folder.finding_rows, "now", texts=folder.finding_texts)
    assert "seq" not in seen["rules"].schema["r"].dataType.names
    joined = rp.sarif_results(folder.finding_rows, folder.finding_texts)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (rule_index" in joined

"""Physical plans of the registered queries: no pairwise joins, no row-wise Python."""

import re

import pytest

from riskweave.plans import registry

QUERIES = registry.callables()
PYTHON = {"s1_source_tree", "s1_pruned_tree", "s3_archive_expansion", "s3_archive_files", "w4_archive_limits"}
RUNS_ON_CALL = {"full_scan_risk", "scan_job_findings", "scan_job_outcome", "s16_findings_write", "s17_event_append"} | {n for n in QUERIES if n[:2] in ("t1", "t2", "t3", "t4", "t5", "t6")}
TOP_K = ["a4_file_heatmap", "a5_engine_counts", "a6_owasp_counts", "a13_badge_summary", "w2_risk_trend", "w3_review_candidates",
         "o1_page_per_scan", "j1_carry_forward"]


def plan(spark, small, name):
    return QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_no_pairwise_join_and_no_python_rows(spark, small):
    for name in QUERIES:
        if name in RUNS_ON_CALL:
            continue
        text = plan(spark, small, name)
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert word not in text, (name, word)
        if name not in PYTHON:
            for word in ("ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "MapInArrow"):
                assert word not in text, (name, word)


@pytest.mark.parametrize("name", TOP_K)
def test_rank_limits_are_pushed_below_the_shuffle(spark, small, name):
    text = plan(spark, small, name)
    below = text.split("Exchange", 1)[1]
    assert "WindowGroupLimit" in text and "Partial" in below, name


def test_scan_prunes_columns_and_pushes_filters(spark, small):
    text = plan(spark, small, "p2_findings_filter")
    assert "l_comment" not in text and "l_tax" not in text and "PushedFilters" in text


@pytest.mark.parametrize("name", ["s11_executive_json", "s12_service_sarif", "s13_dashboard_sarif"])
def test_a_report_reads_the_findings_twice(spark, small, name, monkeypatch):
    """Once for everything that is counted or named, once for the lines of the findings themselves."""
    from riskweave.sources import reports
    reads, staged = [0], reports.stage

    def scans(df):
        return sum("Relation" in line and "l_suppkey" in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())

    def stage(df, label):
        reads[0] += scans(df)
        return staged(df, label)
    monkeypatch.setattr(reports, "stage", stage)
    last = registry.callables()[name](spark, small)
    reads[0] += scans(last)
    assert reads[0] == 2


def test_the_overview_has_one_public_subquery(spark, small):
    plan = registry.callables()["a10_dashboard_overview"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"Subquery subquery#(\d+)", plan))) <= 1


def _report_findings(spark, scans, each):
    from pyspark.sql import functions as F
    base = spark.range(scans * each).select((F.col("id") % scans).alias("scan_id"), F.lpad(F.col("id").cast("string"), 10, "0").alias("seq"))
    texts = {n: F.concat(F.lit(n), (F.xxhash64("seq", F.lit(n)) % 3).cast("string")) for n in (
        "id", "rule_id", "scan_category", "engine", "title", "vuln_type", "verification_status", "cwe_id", "owasp_category", "file_path", "code_snippet", "evidence", "poc",
        "remediation", "source", "sink", "dedupe_hash")}
    return base.withColumns({**texts, "severity": F.lit("High"), "status": F.lit("open"), "cvss4_score": F.lit(1.0), "confidence": F.lit(0.5),
                             **{n: F.lit(1) for n in ("line_number", "line_start", "line_end")}})


def test_a_report_deals_its_wide_rows_once_and_sorts_none(spark):
    from pyspark.sql import functions as F
    from riskweave.sources import reports
    findings = _report_findings(spark, 50, 4)
    scans = findings.select("scan_id").distinct().select("scan_id", *[F.lit("x").alias(n) for n in ("status", "risk_level", "source_type", "source_value")], F.lit(1.0).alias("risk_percent"))
    wide = [line for line in reports.executive_json(scans, findings, "u", "t")._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert any("ShuffledHashJoin" in line for line in wide) and not any("SortMergeJoin" in line for line in wide)


def test_a_finding_makes_four_cells_and_one_position(spark):
    from riskweave.sources import reports
    cells = reports.report_cells(_report_findings(spark, 30, 1))
    assert cells.count() == 4 * 30 and cells.where("first is not null").count() == 30
    assert set(cells.columns) == {"scan_id", "kind", "key", "state", "n", "first"}


def test_the_outcome_of_a_scan_job_broadcasts_no_row_for_every_scan(spark, monkeypatch):
    from riskweave.plans import queries_corpus as qc
    done = spark.createDataFrame([(1, "completed", "Low", 5.0, 7000), (2, "completed", "High", 60.0, 7000)], "scan_id long, status string, risk_level string, risk_percent double, duration_ms long")
    events = done.selectExpr("scan_id", "'done ' || risk_level AS message")
    notices = spark.createDataFrame([('{"scanId":"2"}', "u")], "payload string, user_id string")
    monkeypatch.setattr(qc, "_job", lambda v: {"scans": done, "events": events, "notifications": notices})
    out = qc.job_outcome(None)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.scan_id, r.message, r.notified) for r in out.collect()) == [(1, "done Low", None), (2, "done High", "u")]

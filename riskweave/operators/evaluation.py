"""Accuracy against labelled ground truth, and the CI gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweave.functions import scoring as sc, text as tx


# J10 ----------------------------------------------------------------------
def match_truth(truth: DataFrame, findings: DataFrame) -> DataFrame:
    """Ground truth with has_match: same test case and same normalised CWE."""
    seen = (
        findings.select(tx.test_case_id(F.col("file_path")).alias("_case"), tx.normalise_cwe(F.col("cwe_id")).alias("_cwe"))
        .filter("_case is not null").distinct().withColumn("_hit", F.lit(True))
    )
    on = (F.upper("test_case_id") == F.col("_case")) & (F.col("cwe_id") == F.col("_cwe"))
    return truth.join(seen, on, "left").withColumn("has_match", F.coalesce("_hit", F.lit(False))) \
        .drop("_case", "_cwe", "_hit")


# A14 ----------------------------------------------------------------------
def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def accuracy(truth: DataFrame, findings: DataFrame) -> DataFrame:
    """TP, FP, FN, TN, precision, recall, F1 per CWE and overall ('ALL').

    The overall row sums the per-CWE counts, so the truth is aggregated once.  Without
    a position column the category of a CWE is its alphabetically first one.
    """
    matched = match_truth(truth, findings)
    real, hit = F.col("is_vulnerable"), F.col("has_match")
    first = F.min_by("category", "position") if "position" in truth.columns else F.min("category")
    per_cwe = matched.groupBy(F.col("cwe_id").alias("cwe")).agg(
        first.alias("category"),
        F.count_if(real & hit).alias("tp"), F.count_if(~real & hit).alias("fp"),
        F.count_if(real & ~hit).alias("fn"), F.count_if(~real & ~hit).alias("tn"),
        F.count(F.lit(1)).alias("total"))
    counts = ["tp", "fp", "fn", "tn", "total"]
    both = per_cwe.rollup("cwe").agg(
        F.grouping("cwe").alias("g"), F.min("category").alias("category"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return (
        both.withColumns({
            "cwe": F.when(F.col("g") == 1, "ALL").otherwise(F.col("cwe")),
            "category": F.when(F.col("g") == 1, "Overall").otherwise(F.col("category")),
            "precision": p, "recall": r,
        })
        .withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .select("cwe", "category", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "total")
    )


# S15 ----------------------------------------------------------------------
def accuracy_report(metrics: DataFrame) -> DataFrame:
    """One JSON document {overall, per_cwe[]}; its size is bounded by the number of CWEs."""
    row = F.struct("cwe", "category", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "total")
    doc = metrics.agg(
        F.max(F.when(F.col("cwe") == "ALL", row)).alias("overall"),
        F.array_sort(F.collect_list(F.when(F.col("cwe") != "ALL", row))).alias("per_cwe"))
    return doc.select(F.to_json(F.struct("overall", "per_cwe")).alias("report"))


# A15 ----------------------------------------------------------------------
def ci_gate(findings: DataFrame, scans: DataFrame, fail_on: str = "critical,high") -> DataFrame:
    """Errors, warnings and the verdict of every scan."""
    level = sc.sarif_level(F.col("severity"), "dashboard")
    counts = findings.groupBy("scan_id").agg(
        F.count_if(level == "error").alias("errors"), F.count_if(level == "warning").alias("warnings"))
    on_errors = "critical" in fail_on or "high" in fail_on
    on_warnings = "medium" in fail_on
    failed = (F.lit(on_errors) & (F.col("errors") > 0)) | (F.lit(on_warnings) & (F.col("warnings") > 0))
    return (scans.select("scan_id").join(counts, "scan_id", "left")
            .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("errors", "warnings")})
            .withColumn("verdict", F.when(failed, "fail").otherwise("pass")))

"""Triage: heuristics, reviewer verdicts, confidence floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskweave import fixed_values as fv
from riskweave.functions import scoring as sc, text as tx
from riskweave.schemas import missing


# R1 -----------------------------------------------------------------------
def heuristic_verdict() -> Column:
    """struct(status, confidence) for a finding that is still unverified."""
    c = F.col
    text = sc.blob(c("title"), c("vuln_type"), c("code_snippet"), c("source"), c("sink"))
    sourced, sunk = c("source") != "", c("sink") != ""

    def result(status, confidence):
        return F.struct(F.lit(status).alias("status"), confidence.alias("confidence"))

    placeholder = (c("scan_category") == "Secret scan") & sc.contains_any(
        F.lower(F.coalesce("evidence", F.lit(""))), fv.PLACEHOLDER_WORDS)
    likely = "false_positive_likely"
    return (
        F.when(sc.contains_any(text, ["injection", "sqli", "command"]) & sourced & sunk,
               result("needs_review", c("confidence")))
        .when(sc.contains_any(text, ["injection", "xss", "ssrf"]) & ~sourced,
              result(likely, F.least(c("confidence"), F.lit(0.55))))
        .when(placeholder, result(likely, F.least(c("confidence"), F.lit(0.40))))
        .otherwise(result("needs_review", c("confidence")))
    )


def heuristic_triage(findings: DataFrame) -> DataFrame:
    open_ = F.col("verification_status") == "unverified"
    return findings.withColumn("_v", F.when(open_, heuristic_verdict())).withColumns({
        "verification_status": F.coalesce("_v.status", "verification_status"),
        "confidence": F.coalesce("_v.confidence", "confidence"),
    }).drop("_v")


# W3 -----------------------------------------------------------------------
def review_candidates(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """The unverified findings in a reviewer's order; all of them, or the first `limit` per scan.

    A limit is pushed below the shuffle, so a scan of any size sends only that many rows per task.
    """
    rank = W.partitionBy("scan_id").orderBy(
        sc.severity_rank(F.col("severity")).desc(), F.desc("confidence"), F.asc("seq"))
    ranked = findings.filter("verification_status = 'unverified'").withColumn("review_rank", F.row_number().over(rank))
    return ranked if limit is None else ranked.filter(F.col("review_rank") <= limit)


# F34 ----------------------------------------------------------------------
def review_queue(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidates with the text a reviewer gets."""
    return review_candidates(findings, limit).select(
        "scan_id", "seq", "review_rank", tx.reviewer_prompt(F.col).alias("prompt"))


# R2 -----------------------------------------------------------------------
_TEXTS = ["why_vulnerable", "exploitability", "false_positive_reason", "remediation", "secure_example", "pentest_hint"]


def apply_verdicts(findings: DataFrame, verdicts: DataFrame, keys: list[str] | None = None,
                   limit: int | None = None) -> DataFrame:
    """Every verdict on an unverified finding; findings without one fall back to the heuristics.

    With a limit, the first `limit` candidates of each scan count as sent to the reviewer:
    verdicts beyond them are not used, and a candidate without an answer needs review.

    verdicts: keys + confidence_delta, verification_status and the six texts.
    """
    keys = keys or ["scan_id", "seq"]
    v = verdicts.select(*keys, F.lit(True).alias("_judged"),
                        F.col("confidence_delta").alias("_delta"), F.col("verification_status").alias("_status"),
                        *[F.col(t).alias(f"_{t}") for t in _TEXTS])
    if limit is None:
        judged = v.withColumn("_candidate", F.lit(True))
    else:
        # only candidates are judged, so verdicts meet the short candidate list first
        judged = review_candidates(findings, limit).select(*keys, F.lit(True).alias("_candidate")).join(v, keys, "left")
    delta = F.least(F.greatest(F.coalesce("_delta", F.lit(0.0)), F.lit(-0.30)), F.lit(0.10))
    status = F.when(F.col("_status").isin("needs_review", "false_positive_likely"), F.col("_status")) \
        .otherwise("needs_review")
    candidate = F.coalesce("_candidate", F.lit(False)) & (F.col("verification_status") == "unverified")
    use = candidate & F.coalesce("_judged", F.lit(False))
    applied = findings.join(judged, keys, "left").withColumns({
        "confidence": F.when(use, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + delta)))
        .otherwise(F.col("confidence")),
        "verification_status": F.when(candidate, F.when(use, status).otherwise("needs_review"))
        .otherwise(F.col("verification_status")),
        **{t: F.when(use, F.coalesce(missing(F.col(f"_{t}")), F.col(t))).otherwise(F.col(t)) for t in _TEXTS},
    }).drop("_candidate", "_judged", "_delta", "_status", *[f"_{t}" for t in _TEXTS])
    return heuristic_triage(applied)


# R3 -----------------------------------------------------------------------
def floor_confidence(findings: DataFrame) -> DataFrame:
    return findings.withColumn("confidence", F.greatest("confidence", F.lit(fv.CONFIDENCE_FLOOR)))


# R4 -----------------------------------------------------------------------
LOW_CONFIDENCE = 0.30


def path_review(findings: DataFrame) -> DataFrame:
    """Second reviewer without a model: test and mock paths are likely noise."""
    path = F.lower(F.coalesce("file_path", F.lit("")))
    noisy = path.contains("test") | path.contains("mock")
    return findings.withColumns({
        "verification_status": F.when(noisy, "false_positive_likely")
        .when(F.col("verification_status") == "unverified", "needs_review").otherwise(F.col("verification_status")),
        "confidence": F.when(noisy, F.lit(LOW_CONFIDENCE)).otherwise(F.col("confidence")),
    })


def evidence_review(findings: DataFrame) -> DataFrame:
    """Second reviewer with a model at hand: placeholder evidence and cloud keys."""
    sample = F.coalesce("evidence", F.lit("")).contains("example.com")
    cloud = F.col("title").contains("AWS Access Key")
    return findings.withColumns({
        "pentest_hint": F.when(cloud, fv.AWS_REVIEW_HINT).otherwise(F.col("pentest_hint")),
        "verification_status": F.when(sample, "false_positive_likely").when(cloud, "needs_review")
        .otherwise(F.col("verification_status")),
        "confidence": F.when(sample, F.lit(LOW_CONFIDENCE)).otherwise(F.col("confidence")),
    })

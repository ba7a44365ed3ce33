"""Risk score of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskweave import fixed_values as fv
from riskweave.functions import scoring as sc


# A1 -----------------------------------------------------------------------
def scan_risk(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """(scan_id, risk_level, risk_percent).

    One aggregation with partial sums.  The weighted sum is rounded to six decimals
    before it meets the floors and bands, so the order of partial sums cannot move a
    scan across a limit.  With `scans`, scans without findings get the empty-scan risk.
    """
    rank = sc.severity_rank(F.col("severity"))
    per_scan = findings.groupBy("scan_id").agg(
        F.sum(sc.severity_weight(F.col("severity")) * F.col("confidence")).alias("weighted"),
        F.max(rank).alias("top_rank"),
        F.max((F.col("scan_category") == "Secret scan") & (F.col("verification_status") == "verified")).alias("live"),
    )
    bonus = F.when(F.col("live"), fv.VERIFIED_SECRET_BONUS).otherwise(0.0)
    capped = F.least(F.round(F.col("weighted") + bonus, 6), F.lit(100.0))
    floor = sc.lookup(F.col("top_rank"), dict(fv.RISK_FLOORS), 0.0)
    scored = per_scan.select("scan_id", F.greatest(capped, floor).alias("risk_percent"))
    level, percent = fv.EMPTY_SCAN_RISK
    if scans is None:
        return scored.withColumn("risk_level", sc.risk_band(F.col("risk_percent")))
    return scans.select("scan_id").join(scored, "scan_id", "left").select(
        "scan_id",
        F.when(F.col("risk_percent").isNull(), level).otherwise(sc.risk_band(F.col("risk_percent"))).alias("risk_level"),
        F.coalesce("risk_percent", F.lit(percent)).alias("risk_percent"),
    )

"""State carried across the scans of a project."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from riskweave import fixed_values as fv
from riskweave.schemas import missing

KEY = ["project_id", "dedupe_hash"]


# J1 -----------------------------------------------------------------------
def latest_states(history: DataFrame) -> DataFrame:
    """Per project and fingerprint: the newest state, and the newest of another scan.

    Rows are first reduced to one per scan, then to two per fingerprint with a rank
    limit below the shuffle; whichever scan asks, one of the two is not its own.
    """
    state = F.struct("created_at", "id", "status", "assignee_id", "verification_status")
    per_scan = history.groupBy(*KEY, "scan_id").agg(F.max(state).alias("s"))
    order = W.partitionBy(*KEY).orderBy(F.desc("s"))
    two = per_scan.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= 2)
    pick = lambda n: F.max(F.when(F.col("nth") == n, F.struct("scan_id", "s")))
    return two.groupBy(*KEY).agg(pick(1).alias("last"), pick(2).alias("other"))


def carry_forward(findings: DataFrame, history: DataFrame) -> DataFrame:
    """New findings with assignee, verification and status taken over from history."""
    old = F.when(F.col("last.scan_id") != F.col("scan_id"), F.col("last.s")).otherwise(F.col("other.s"))
    joined = findings.drop("status", "assignee_id").join(latest_states(history), KEY, "left").withColumn("_old", old)
    status = (
        F.when(F.col("_old.status") == "fixed", "reopened")
        .when(F.col("_old.status").isin(*fv.KEPT_STATUSES), F.col("_old.status"))
        .otherwise("open")
    )
    return joined.withColumns({
        "status": status,
        "previous_status": F.col("_old.status"),
        "assignee_id": F.col("_old.assignee_id"),
        "verification_status": F.when(F.col("_old").isNotNull(), F.col("_old.verification_status"))
        .otherwise(F.col("verification_status")),
    }).drop("last", "other", "_old")


# J2 -----------------------------------------------------------------------
def flag_previous_false_positives(findings: DataFrame, history: DataFrame) -> DataFrame:
    """True where another scan of the project dismissed the same fingerprint.

    The lowest and highest dismissing scan decide: one of them differs from the
    finding's own scan exactly when some other scan dismissed it.
    """
    dismissed = (
        history.filter((F.col("status") == "false_positive") & missing(F.col("dedupe_hash")).isNotNull())
        .groupBy(*KEY).agg(F.min("scan_id").alias("_low"), F.max("scan_id").alias("_high"))
    )
    other = (F.col("_low") != F.col("scan_id")) | (F.col("_high") != F.col("scan_id"))
    return (findings.join(dismissed, KEY, "left")
            .withColumn("previously_false_positive", F.coalesce(other, F.lit(False))).drop("_low", "_high"))


# W7 -----------------------------------------------------------------------
def current_badges(publications: DataFrame, flavour: str = "service") -> DataFrame:
    """Every published badge with its state: only the newest of a scan stays active.

    publications: token, scan_id, published_at.
    """
    newest = publications.groupBy("scan_id").agg(F.max(F.struct("published_at", "token")).alias("n"))
    days = fv.BADGE_DAYS[flavour]
    return publications.join(newest, "scan_id").select(
        "token", "scan_id", "published_at",
        F.when(F.col("token") == F.col("n.token"), "true").otherwise("false").alias("is_active"),
        (F.col("published_at") + F.make_dt_interval(F.lit(days))).alias("expires_at"))


# P17 ----------------------------------------------------------------------
def badge_lookup(requests: DataFrame, badges: DataFrame, as_of) -> DataFrame:
    """requests(token) -> outcome ok, gone or not_found."""
    outcome = (
        F.when(F.coalesce(F.col("is_active"), F.lit("false")) != "true", "not_found")
        .when(F.col("expires_at") < as_of, "gone").otherwise("ok")
    )
    found = badges.select("token", "scan_id", "is_active", "expires_at")
    return requests.join(found, "token", "left").withColumn("outcome", outcome)

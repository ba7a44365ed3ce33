"""Checks on requests, uploads and updates; the stale sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweave import fixed_values as fv
from riskweave.functions import text as tx
from riskweave.operators.governance import scan_notifications
from riskweave.schemas import missing


# P9 -----------------------------------------------------------------------
def _internal_ipv4(host: Column) -> Column:
    """Private, loopback, link-local, multicast or reserved IPv4 literals."""
    octet = lambda n: F.try_element_at(F.split(host, r"\."), F.lit(n)).try_cast("int")
    a, b = octet(1), octet(2)
    literal = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    inside = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
    )
    return literal & F.coalesce(inside, F.lit(False))


def repo_url_problem(url: Column) -> Column:
    """Reason code of a repository URL, null when it is fine.  No name is resolved."""
    scheme = F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    allowed = F.lit(False)
    for prefix in fv.ALLOWED_URL_PREFIXES:
        allowed = allowed | url.startswith(prefix)
    return (
        F.when(F.lower(scheme) != "https", "not_https").when(host == "", "no_host")
        .when(_internal_ipv4(host) | (F.lower(host) == "localhost"), "internal_host")
        .when(~allowed, "prefix_not_allowed")
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """requests(source_type, source_value, guest) -> reason (null = accepted) and code."""
    value = F.coalesce("source_value", F.lit(""))
    limit = F.when(F.col("guest"), fv.MAX_GUEST_BYTES).otherwise(fv.MAX_SOURCE_BYTES)
    too_big = F.octet_length(value) > limit
    url_problem = F.when(F.col("source_type") == "repo_url", repo_url_problem(value))
    reason = (
        F.when(~F.coalesce(F.col("source_type"), F.lit("")).isin(*fv.SOURCE_TYPES), "unsupported_type")
        .when(tx.strip(value) == "", "empty_value")
        # guests are measured before the URL is looked at, project requests after
        .when(F.col("guest") & too_big, "too_large")
        .when(url_problem.isNotNull(), url_problem)
        .when(too_big, "too_large")
    )
    return requests.withColumn("reason", reason).withColumn(
        "code", F.when(F.col("reason").isNull(), 200).when(F.col("reason") == "too_large", 413).otherwise(400))


# P10 ----------------------------------------------------------------------
def validate_uploads(uploads: DataFrame) -> DataFrame:
    """uploads(upload_id, file_name, size) -> reason and object key."""
    name = F.lower("file_name")
    archive = name.endswith(".zip") | name.endswith(".tar.gz") | name.endswith(".tgz")
    base = F.regexp_extract("file_name", r"([^/]*)$", 1)
    reason = F.when(F.col("size") > fv.MAX_UPLOAD_BYTES, "too_large").when(~archive, "unsupported_archive")
    return uploads.withColumn("reason", reason).withColumn(
        "object_key", F.when(F.col("reason").isNull(),
                             F.concat(F.lit("uploads/"), F.col("upload_id").cast("string"), F.lit("-"), base)))


# P19 ----------------------------------------------------------------------
def validate_updates(updates: DataFrame) -> DataFrame:
    """updates(status, verification_status, comment) -> reason and the stored comment."""
    s, v = missing(F.col("status")), missing(F.col("verification_status"))
    comment = tx.strip(F.coalesce("comment", F.lit("")))
    reason = (
        F.when(s.isNotNull() & ~s.isin(*fv.FINDING_STATUSES), "invalid_status")
        .when(v.isNotNull() & ~v.isin(*fv.VERIFICATION_STATUSES), "invalid_verification")
        .when(s.isNull() & v.isNull(), "nothing_to_update")
        .when(F.length(comment) > fv.COMMENT_LIMIT, "too_long")
    )
    return updates.withColumn("reason", reason).withColumn("stored_comment", comment)


# P18 ----------------------------------------------------------------------
def is_stale(as_of: Column, limits: dict[str, int] | None = None) -> Column:
    limits = limits or fv.STALE_SECONDS
    us = 1000000
    queued = (F.col("status") == "queued") & (tx.micros_between(as_of, F.col("created_at")) > limits["queued"] * us)
    running = (F.col("status") == "running") & (tx.micros_between(as_of, F.col("started_at")) > limits["running"] * us)
    return F.coalesce(queued | running, F.lit(False))


def stale_sweep(scans: DataFrame, as_of: Column, existing_notifications: DataFrame
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(failed scans, events, notifications) of one sweep at as_of."""
    message = F.when(F.col("status") == "queued", fv.STALE_MESSAGES["queued"]).otherwise(fv.STALE_MESSAGES["running"])
    failed = scans.filter(is_stale(as_of)).withColumn("error_message", message).withColumns(
        {"status": F.lit("failed"), "completed_at": as_of})
    events = failed.select("scan_id", F.lit("failed").alias("event_type"),
                           F.col("error_message").alias("message"), as_of.alias("created_at"))
    return failed, events, scan_notifications(failed, existing_notifications)

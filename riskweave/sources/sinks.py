"""Writers: findings, events, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweave.sources.keyed_table import BUCKETS, KeyedTable

LAYERS = 16


# S16 ----------------------------------------------------------------------
def findings_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedTable:
    return KeyedTable(spark, path, ["scan_id"], buckets)


def write_findings(findings: DataFrame, scans: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Replace the findings of the given scans in one commit; running it again gives the same table.

    A write costs what its scans hold, not what the table holds; other scans of a bucket are not touched, and
    writers on different scans do not lose each other's rows.  Scans without findings become empty.
    Every LAYERS writes the layers are merged.
    """
    table = findings_table(findings.sparkSession, path, buckets)
    version = table.replace(findings, scans)
    if version % LAYERS == 0:
        table.compact()
    return version


# S17 ----------------------------------------------------------------------
def append_scan_events(events: DataFrame, path: str) -> None:
    """Add progress events, filed by day."""
    (events.withColumn("event_date", F.to_date("created_at")).write.mode("append")
     .partitionBy("event_date").parquet(path))


# S10 .. S14 ---------------------------------------------------------------
def write_reports(lines: DataFrame, path: str) -> None:
    """Report lines as text, one folder per scan, part files in reading order.

    The sort is by range over scan, section and position, so a large report is written
    by many tasks; its files concatenated by name are the document.
    """
    ordered = lines.repartitionByRange(F.col("scan_id"), F.col("section"), F.col("at")) \
        .sortWithinPartitions("scan_id", "section", "at")
    ordered.select("scan_id", F.col("line").alias("value")).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").text(path)


# S14 ----------------------------------------------------------------------
def readable(resolved: DataFrame) -> DataFrame:
    """Requests whose token may read the report, and its scan: no other report need be made for them."""
    return resolved.filter("outcome = 'ok'").select("request_id", "scan_id")


def ci_reports(resolved: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of the reports a token may read: resolved(request_id, scan_id, outcome)."""
    return lines.join(readable(resolved), "scan_id")


# S15 ----------------------------------------------------------------------
def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

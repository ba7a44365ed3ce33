"""Named tables of the data model over a storage root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.sources.keyed_table import KeyedTable

TABLES = [
    "scans", "findings", "scan_events", "finding_events", "audit_events", "notifications",
    "scanner_policies", "projects", "organizations", "organization_members", "users",
    "organization_invites", "admin_support_access", "api_tokens", "public_badges", "uploaded_assets",
]


# S9 -----------------------------------------------------------------------
def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(name)
    path = f"{root.rstrip('/')}/{name}"
    return KeyedTable(spark, path, ["scan_id"]).read() if name == "findings" else spark.read.parquet(path)


def register(spark: SparkSession, root: str, names: list[str] | None = None) -> None:
    """Make the tables available to spark.sql under their names."""
    for name in names or TABLES:
        table(spark, root, name).createOrReplaceTempView(name)


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int,
               parts: int, **options) -> DataFrame:
    """The same table from a relational database, read in parallel key ranges."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high,
                           numPartitions=parts, properties=options)


def is_true(col):
    """Flags kept as the texts 'true' and 'false'."""
    return col == "true"

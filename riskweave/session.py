"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# AQE carries the skew handling of every equi-join: a shuffle partition that one
# hot key has blown up is read by several tasks.  Without the force flag AQE
# leaves a skewed join alone whenever a later aggregate could reuse its layout.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # texts and archive bodies travel to Python in batches of bounded size; each is held twice on either side
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session the caller owns."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for staged tables and stream checkpoints, named by spark.checkpoint.dir.

    On one machine it may be unset, and a temporary folder of this process takes its place.
    On a cluster that would lose rows without an error, so there it has to be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own_folder()
    return root.rstrip("/")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="riskweave-")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a costly intermediate once and read it back, columns still prunable.

    Used where several branches of a plan need the same rows: it keeps the corpus at
    one read and survives the loss of executors.
    """
    path = f"{checkpoint_root(df.sparkSession)}/stage/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Structured Streaming jobs over event logs, request logs and arriving source files.

Late data: the stale reaper and the phase rates state their watermark delay; rows later than it are
dropped by Spark, and a state that has been closed stays closed.  For the status feed (status_feed) and the
rate limits (rate_limits) no row is too late: what comes behind is worked out again, so neither the cut
into batches nor their order matters.  Notices and scores keep what they know in keyed tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskweave import fixed_values as fv
from riskweave.functions import text as tx
from riskweave.operators import detection as d, enrichment as en
from riskweave.operators.dedupe import deduplicate
from riskweave.operators.risk import scan_risk
from riskweave.session import checkpoint_root, stage
from riskweave.sources.keyed_table import KeyedTable
from riskweave.sources.sinks import LAYERS
from riskweave.streaming.status_feed import TERMINAL, status_of

def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over what is there, into files of the shared folder."""
    spark = stream.sparkSession
    base = f"{checkpoint_root(spark)}/streams/{name}-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


# T1 -----------------------------------------------------------------------
def latest_status(events: DataFrame) -> DataFrame:
    """Newest status per scan; update mode on a stream, an aggregate on a table."""
    status = status_of(F.col("event_type"))
    return events.withColumn("status", status).filter("status is not null").groupBy("scan_id").agg(
        F.max(F.struct("created_at", "id", "status")).alias("s")).select("scan_id", "s.created_at", "s.status")


def keep_latest(path: str):
    """foreachBatch writer of an update stream: the newest row per scan, in a table kept by scan."""
    def write(batch: DataFrame, batch_id: int) -> None:
        table = KeyedTable(batch.sparkSession, path, ["scan_id"])
        if table.replace(stage(batch, "latest")) % LAYERS == 0:
            table.compact()
    return write


# T3 -----------------------------------------------------------------------
_LIMIT_US = {k: v * 1000000 for k, v in fv.STALE_SECONDS.items()}


def _reaper(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, since = state.get if state.exists else (None, 0)
    out = []
    if state.hasTimedOut:
        out.append((key[0], pd.Timestamp(since + _LIMIT_US[status], unit="us"), fv.STALE_MESSAGES[status]))
        state.remove()
    else:
        rows = pd.concat(list(batches)).sort_values(["us", "id"])
        # each event beside the one before it: a gap may already have been too long
        at = np.concatenate([[since], rows["us"].to_numpy(np.int64)])
        told = [status, *rows["status"]]
        limit = np.array([_LIMIT_US.get(s, np.iinfo(np.int64).max) for s in told])
        for i in np.flatnonzero(at[1:] - at[:-1] > limit[:-1]).tolist():
            out.append((key[0], pd.Timestamp(int(at[i] + limit[i]), unit="us"), fv.STALE_MESSAGES[told[i]]))
        status, since = told[-1], int(at[-1])
        if status in _LIMIT_US:
            state.update((status, int(since)))
            due_ms = (since + _LIMIT_US[status]) // 1000 + 1
            state.setTimeoutTimestamp(int(max(due_ms, state.getCurrentWatermarkMs() + 1)))
        elif state.exists:
            state.remove()
    yield pd.DataFrame(out, columns=["scan_id", "failed_at", "message"])


def stale_scans(events: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """Scans without progress: 180 s after queueing, 1800 s while running.

    Event time with a watermark; a scan whose time ran out is reported once per silence,
    and events that come after it open a new watch.
    """
    key = dict(events.dtypes)["scan_id"]
    rows = events.withColumn("status", status_of(F.col("event_type"))).filter("status is not null")
    timed = rows.select("scan_id", "id", F.col("created_at").cast("timestamp").alias("at"), "status").withWatermark("at", delay)
    return timed.withColumn("us", F.unix_micros("at")).groupBy("scan_id").applyInPandasWithState(
        _reaper, f"scan_id {key}, failed_at timestamp, message string", "status string, since bigint", "append",
        GroupStateTimeout.EventTimeTimeout)


# T4 -----------------------------------------------------------------------
NOTICE = ["user_id", "type", "scan_id"]


def notification_stream(events: DataFrame, scans: DataFrame) -> DataFrame:
    """user_id, type, scan_id, at of every event that calls for a notice; scans is a table."""
    done = events.filter(F.col("event_type").isin(*TERMINAL)).withColumn("at", F.col("created_at").cast("timestamp"))
    who = scans.filter("triggered_by is not null and scan_id is not null").select("scan_id", F.col("triggered_by").alias("user_id"))
    return done.join(who, "scan_id").select(
        "user_id", F.when(F.col("event_type") == "completed", "scan_completed").otherwise("scan_failed").alias("type"), "scan_id", "at")


def tell_once(path: str):
    """foreachBatch handler: one notice per user, type and scan, however far its events lie apart.

    What has been told is a keyed table.  A batch looks up its own notices in the buckets they fall in, adds the
    new ones with their batch and earliest event, and leaves the others; a repeated batch finds its notices told.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        told = KeyedTable(batch.sparkSession, path, NOTICE)
        asked = stage(batch.groupBy(*NOTICE).agg(F.min("at").alias("at")), "notices").withColumn("batch_id", F.lit(batch_id))
        fresh = asked.join(told.read(asked), NOTICE, "left_anti") if told.manifest() else asked
        if told.replace(fresh) % LAYERS == 0:
            told.compact()
    return run


def run_batches(stream: DataFrame, name: str, handler) -> None:
    """Hand over what is there, batch by batch."""
    checkpoint = f"{checkpoint_root(stream.sparkSession)}/streams/{name}-{uuid.uuid4().hex}/checkpoint"
    stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# T5 -----------------------------------------------------------------------
def incremental_findings(files: DataFrame, strict: bool = False) -> DataFrame:
    """Stateless detection of arriving files: the batch detectors on a stream.

    A stream is not staged, so each detector runs its own family alone, not those of the others too.
    """
    return en.union_engines(d.js_sink_findings(files, strict), d.pattern_findings(files, strict), d.secret_findings(files, strict))


def score_batch(heads: DataFrame, path: str, sink=None, source: str = ""):
    """foreachBatch handler: the scans a batch touched are enriched, folded and scored whole.

    Raw findings are kept by scan in path/raw; a batch reads the buckets of the scans it touches, not what
    earlier batches found elsewhere, and findings of different batches chain and fold as if they had come at
    once.  Rows carry their batch (with several streams, `source` tells them apart), so a repeated batch replaces
    itself.  heads: scan_id, source_type, source_value; a scan without a head is scored with empty ones.
    Folded findings and risks go to path/findings and path/risk, kept by scan too; sink(findings, risk, batch_id)
    is called with those of the touched scans.
    """
    def run(found: DataFrame, batch_id: int) -> None:
        spark = found.sparkSession
        table = lambda name: KeyedTable(spark, f"{path}/{name}", ["scan_id"])
        batch = f"{source}{batch_id}"
        mine = stage(found.withColumn("batch", F.lit(batch)), "batch")
        touched = mine.select("scan_id").distinct()
        if table("raw").manifest():
            # scans in which only the former run of this batch found something are not touched any more
            mine = stage(mine.unionByName(table("raw").read(touched).where(F.col("batch") != batch)), "touched")
        ready = en.enrich(en.correlate(mine.drop("batch")).join(heads, "scan_id", "left").fillna("", ["source_type", "source_value"]))
        kept = stage(deduplicate(stage(ready, "enriched")), "kept")
        risk = stage(scan_risk(kept, touched), "risk")
        for name, rows in (("raw", mine), ("findings", kept), ("risk", risk)):
            if table(name).replace(rows, touched) % LAYERS == 0:
                table(name).compact()
        if sink is not None:
            sink(kept, risk, batch_id)
    return run


# T6 -----------------------------------------------------------------------
def phase_rates(events: DataFrame, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events per phase and tumbling window; a window is told once the watermark passes it."""
    timed = events.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", length), tx.event_phase(F.col("event_type")).alias("phase")).agg(
        F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"), "phase", "n")

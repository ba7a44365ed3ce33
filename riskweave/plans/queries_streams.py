"""Streaming jobs run over what a data folder holds, then read back as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from riskweave.plans.queries_corpus import rule_hits_sql
from riskweave.plans.registry import query
from riskweave.session import checkpoint_root
from riskweave.sources.keyed_table import KeyedTable
from riskweave.streaming import jobs, rate_limits, status_feed
from riskweave.views import VIEWS, Views


def _files(v: Views, base: str) -> DataFrame:
    """A base table as a file stream.  The byte limit bounds a micro-batch."""
    return (v.spark.readStream.schema(v.base(base).schema).option("maxBytesPerTrigger", 512 << 20)
            .parquet(f"{v.sf_dir}/{base}.parquet*"))


def _stream(v: Views, view: str, base: str) -> DataFrame:
    """A view over one base table, with that table read as a file stream."""
    return v.spark.sql(VIEWS[view], **{base: _files(v, base)})


_STATUS = "CASE event_type WHEN 'sast_scan_started' THEN 'running' ELSE event_type END"


@query("t1_latest_status", f"""SELECT scan_id, created_at, status FROM (SELECT *, {_STATUS} AS status,
  row_number() OVER (PARTITION BY scan_id ORDER BY created_at DESC, id DESC) AS r FROM scan_events) WHERE r = 1""")
def t1_latest(v: Views) -> DataFrame:
    run = f"{checkpoint_root(v.spark)}/streams/t1-{uuid.uuid4().hex}"
    q = (jobs.latest_status(_stream(v, "scan_events", "events")).writeStream.outputMode("update")
         .foreachBatch(jobs.keep_latest(f"{run}/out")).option("checkpointLocation", f"{run}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return KeyedTable(v.spark, f"{run}/out", ["scan_id"]).read()


@query("t1_status_changes", f"""WITH e AS (SELECT *, {_STATUS} AS status FROM scan_events),
w AS (SELECT *, lag(status) OVER o AS before, coalesce(sum(CASE WHEN status IN ('completed', 'failed') THEN 1 ELSE 0 END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
  FROM e WINDOW o AS (PARTITION BY scan_id ORDER BY created_at, id))
SELECT scan_id, created_at, status FROM w WHERE ended = 0 AND (before IS NULL OR before <> status)""")
def t1_changes(v: Views) -> DataFrame:
    fed = jobs.run_available(status_feed.status_feed(_stream(v, "scan_events", "events")), "t1")
    return status_feed.settled(fed, v.scan_events).select("scan_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "status")


@query("t2_guest_rate_limit", """WITH RECURSIVE e AS (SELECT id, ip, epoch_us(ts) AS us, row_number() OVER (PARTITION BY ip ORDER BY ts, id) AS i FROM requests),
r AS (SELECT id, ip, i, CAST(1 AS BIGINT) AS n, us + 3600000000 AS expiry FROM e WHERE i = 1
  UNION ALL SELECT e.id, e.ip, e.i, CASE WHEN e.us > r.expiry THEN 1 ELSE r.n + 1 END, CASE WHEN e.us > r.expiry THEN e.us + 3600000000 ELSE r.expiry END
  FROM r JOIN e ON e.ip = r.ip AND e.i = r.i + 1)
SELECT id, ip, n AS count, greatest(5 - n, 0) AS remaining, n <= 5 AS allowed FROM r""")
def t2(v: Views) -> DataFrame:
    return rate_limits.rate_limit(_stream(v, "requests", "events"))


@query("t2_key_rate_limit", """WITH RECURSIVE e AS (SELECT id, ip, epoch_us(ts) AS us, row_number() OVER (PARTITION BY ip ORDER BY ts, id) AS i FROM requests),
r AS (SELECT id, ip, i, CAST(1 AS BIGINT) AS n, us + 86400000000 AS expiry, true AS ok FROM e WHERE i = 1
  UNION ALL SELECT e.id, e.ip, e.i, CASE WHEN e.us >= r.expiry THEN 1 ELSE least(r.n + 1, 2) END, CASE WHEN e.us >= r.expiry THEN e.us + 86400000000 ELSE r.expiry END,
    e.us >= r.expiry OR r.n < 2 FROM r JOIN e ON e.ip = r.ip AND e.i = r.i + 1)
SELECT id, ip, n AS count, 2 - n AS remaining, ok AS allowed FROM r""")
def t2_key(v: Views) -> DataFrame:
    return rate_limits.rate_limit(_stream(v, "requests", "events"), 2, 86400, count_rejected=False)


@query("t3_stale_reaper", f"""WITH e AS (SELECT scan_id, id, epoch_us(created_at) AS us, {_STATUS} AS status FROM scan_events),
w AS (SELECT *, lead(us) OVER (PARTITION BY scan_id ORDER BY us, id) AS next, CASE status WHEN 'queued' THEN 180000000 WHEN 'running' THEN 1800000000 END AS lim,
  (SELECT max(us) FROM e) - 300000000 AS mark FROM e)
SELECT scan_id, make_timestamp(us + lim) AS failed_at, CASE status WHEN 'queued' THEN 'Scan timeout: Stuck in queue for more than 3 minutes.' ELSE 'Scan timeout: Stuck in running for more than 30 minutes.' END AS message
FROM w WHERE lim IS NOT NULL AND (next > us + lim OR (next IS NULL AND mark // 1000 > (us + lim) // 1000))""")
def t3(v: Views) -> DataFrame:
    out = jobs.run_available(jobs.stale_scans(_stream(v, "scan_events", "events")), "t3")
    return out.withColumn("failed_at", F.col("failed_at").cast("timestamp_ntz"))


@query("t4_notification_stream", """SELECT DISTINCT triggered_by AS user_id, CASE event_type WHEN 'completed' THEN 'scan_completed' ELSE 'scan_failed' END AS type, e.scan_id
  FROM scan_events e JOIN scans s ON e.scan_id = s.scan_id WHERE event_type IN ('completed', 'failed') AND triggered_by IS NOT NULL""")
def t4(v: Views) -> DataFrame:
    told = f"{checkpoint_root(v.spark)}/streams/t4-{uuid.uuid4().hex}/told"
    jobs.run_batches(jobs.notification_stream(_stream(v, "scan_events", "events"), v.scans), "t4", jobs.tell_once(told))
    return KeyedTable(v.spark, told, jobs.NOTICE).read().select("user_id", "type", "scan_id")


@query("t5_incremental_detection", rule_hits_sql())
def t5(v: Views) -> DataFrame:
    """The batch detectors over the streams of both source tables."""
    arriving = v.spark.sql(VIEWS["source_files"], documents=_files(v, "documents"), pages=_files(v, "pages"))
    found = jobs.run_available(jobs.incremental_findings(arriving), "t5")
    return found.select("scan_id", "file_path", "rule_id", F.col("line_start").alias("line"))


@query("t5_scored_batches", f"""SELECT scan_id, rule_id, count(*) AS n FROM ({rule_hits_sql()}) GROUP BY ALL""")
def t5_scored(v: Views) -> DataFrame:
    """Documents and pages arrive after each other; what is kept of their scans is what both found."""
    path = f"{checkpoint_root(v.spark)}/streams/t5-{uuid.uuid4().hex}"
    heads = v.scans.limit(0).select(F.col("scan_id").cast("string").alias("scan_id"), "source_type", "source_value")
    for source, half in zip(("documents", "pages"), VIEWS["source_files"].split("UNION ALL")):
        arriving = v.spark.sql(half, **{source: _files(v, source)})
        jobs.run_batches(jobs.incremental_findings(arriving), f"t5-{source}", jobs.score_batch(heads, path, source=source))
    raw, risk = KeyedTable(v.spark, f"{path}/raw", ["scan_id"]).read(), KeyedTable(v.spark, f"{path}/risk", ["scan_id"]).read()
    return raw.join(risk, "scan_id").groupBy("scan_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("t6_phase_rates", """WITH e AS (SELECT time_bucket(INTERVAL '1' HOUR, created_at) AS w, CASE WHEN event_type IN ('running', 'sast_scan_started') THEN 'started'
  WHEN event_type = 'failed' THEN 'failed' WHEN event_type = 'completed' THEN 'completed' ELSE 'other' END AS phase FROM scan_events)
SELECT w AS window_start, phase, count(*) AS n FROM e WHERE w + INTERVAL '1' HOUR <= (SELECT max(created_at) FROM scan_events) - INTERVAL '10' MINUTE GROUP BY ALL""")
def t6(v: Views) -> DataFrame:
    return jobs.run_available(jobs.phase_rates(_stream(v, "scan_events", "events")), "t6")

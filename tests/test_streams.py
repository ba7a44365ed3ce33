"""Streams replayed in several batches and orders agree with their batch meaning."""

import datetime as dt

import pytest

from riskweave.operators import detection as d
from riskweave.sources.keyed_table import KeyedTable
from riskweave.streaming import jobs, rate_limits, status_feed
from tests import fixtures as fx

T0 = dt.datetime(2024, 1, 1)


def stream(spark, tmp_path, chunks, schema):
    folder = tmp_path / "in"
    for i, rows in enumerate(chunks):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{i}"))
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
            .parquet(str(folder)))


def test_rate_limit_golden(spark, tmp_path):
    secs = [0, 10, 3600, 3601, 3605, 9000]
    rows = [(i, "ip", T0 + dt.timedelta(seconds=s)) for i, s in enumerate(secs)]
    s = stream(spark, tmp_path, [rows[:2], rows[2:5], rows[5:]], "id bigint, ip string, ts timestamp")
    got = {r.id: r["count"] for r in rate_limits.rate_limit(s).collect()}
    assert [got[i] for i in range(6)] == [1, 2, 3, 1, 2, 1]


def test_sixth_request_is_rejected(spark, tmp_path):
    rows = [(i, "ip", T0 + dt.timedelta(seconds=i)) for i in range(6)]
    s = stream(spark, tmp_path, [rows], "id bigint, ip string, ts timestamp")
    got = {r.id: (r.allowed, r.remaining) for r in rate_limits.rate_limit(s).collect()}
    assert got == {0: (True, 4), 1: (True, 3), 2: (True, 2), 3: (True, 1), 4: (True, 0), 5: (False, 0)}


EVENTS = "id bigint, scan_id string, event_type string, created_at timestamp"


def at(sec):
    return T0 + dt.timedelta(seconds=sec)


def feed(spark, folder, chunks, delay="1 hour", keep_hours=24.0):
    """The changes that hold after the chunks, and the progress of each batch."""
    s = stream(spark, folder, chunks, EVENTS)
    q = (status_feed.status_feed(s, delay, keep_hours).writeStream.format("parquet").option("path", str(folder / "out"))
         .option("checkpointLocation", str(folder / "checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    fed = spark.read.parquet(str(folder / "out"))
    events = spark.createDataFrame([r for c in chunks for r in c], EVENTS)
    got = sorted((r.scan_id, r.created_at, r.status) for r in status_feed.settled(fed, events).collect())
    want = sorted((r.scan_id, r.created_at, r.status) for r in status_feed.changes(events).collect())
    return got, want, fed, q.recentProgress


STORY = [(1, "s", "queued", at(0)), (2, "s", "queued", at(5)), (3, "s", "running", at(9)), (4, "s", "completed", at(20)), (5, "s", "running", at(30)),
         (6, "t", "running", at(1)), (7, "t", "failed", at(2)), (8, "u", "queued", at(3)), (9, "u", "running", at(4000)), (10, "u", "queued", at(4001)), (11, "u", "other", at(4002))]


@pytest.mark.parametrize("delay", ["1 second", "2 hours"])
@pytest.mark.parametrize("cut", ["whole", "reversed", "one by one", "one by one, reversed", "halves swapped"])
def test_status_feed_whatever_the_batches(spark, tmp_path, delay, cut):
    chunks = {"whole": [STORY], "reversed": [STORY[::-1]], "one by one": [[r] for r in STORY], "one by one, reversed": [[r] for r in STORY[::-1]],
              "halves swapped": [STORY[5:], STORY[:5]]}[cut]
    got, want, fed, _ = feed(spark, tmp_path, chunks, delay)
    assert got == want and [s for k, _, s in got if k == "s"] == ["queued", "running", "completed"]
    if delay == "1 second" and cut == "one by one, reversed":
        assert fed.where("sign = 0").count() > 0                 # the late side was needed


def test_withdrawn_changes_cancel(spark, tmp_path):
    got, want, fed, _ = feed(spark, tmp_path, [[STORY[1]], [STORY[0]]])
    assert got == want == [("s", at(0), "queued")]
    assert sorted((r.id, r.sign) for r in fed.collect()) == [(1, 1), (2, -1), (2, 1)]


def test_state_falls_back_after_the_end(spark, tmp_path):
    day = 86400
    scans = [[(3 * i, f"s{i}", "queued", at(i)), (3 * i + 1, f"s{i}", "running", at(i + 60)), (3 * i + 2, f"s{i}", "completed", at(i + 120))] for i in range(40)]
    batches = [[e for s in scans for e in s], [(900, "live", "queued", at(2 * day))], [(901, "live", "running", at(4 * day))], [(902, "live", "running", at(6 * day)), (903, "s1", "running", at(6 * day))]]
    got, want, _, progress = feed(spark, tmp_path, batches, keep_hours=12)
    rows = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert got == want and max(rows) >= 40 and rows[-1] <= 12


def test_an_event_without_a_time_goes_to_the_late_side(spark, tmp_path):
    rows = [(1, "s", "queued", at(0)), (2, "s", "running", None)]
    fed = jobs.run_available(status_feed.status_feed(stream(spark, tmp_path, [rows], EVENTS)), "t")
    assert [r.id for r in fed.where("sign = 0").collect()] == [2]
    assert sorted((r.id, r.status) for r in status_feed.settled(fed, spark.createDataFrame(rows, EVENTS)).collect()) == [(1, "queued"), (2, "running")]


def test_stale_reaper(spark, tmp_path):
    rows = [(1, "a", "queued", at(0)), (2, "b", "running", at(0)), (3, "c", "queued", at(0)), (4, "c", "running", at(100)), (5, "c", "completed", at(900))]
    late = [(6, "z", "completed", at(9000))]
    s = stream(spark, tmp_path, [rows[:3], rows[3:], late], EVENTS)
    got = {r.scan_id: (r.failed_at - T0).total_seconds() for r in jobs.run_available(jobs.stale_scans(s), "t").collect()}
    assert got == {"a": 180.0, "b": 1800.0}


def test_incremental_detection_equals_batch(spark, tmp_path):
    tree = {"app.js": fx.NODE, "app.py": fx.FLASK, "config.py": fx.SECRETS, "x.js": "a\neval(b)\n"}
    rows = [("s", p, t) for p, t in tree.items()]
    s = stream(spark, tmp_path, [rows[:1], rows[1:]], "scan_id string, file_path string, content string")
    key = lambda r: (r.engine, r.rule_id, r.file_path, r.line_start, r.context_function)
    got = sorted(map(key, jobs.run_available(jobs.incremental_findings(s), "t").collect()))
    files = fx.files(spark, s=tree)
    want = [r for f in (d.js_sink_findings, d.pattern_findings, d.secret_findings) for r in f(files).collect()]
    assert got == sorted(map(key, want)) and got


def test_score_batch_hands_over_findings_and_risk(spark, tmp_path):
    seen = {}
    files = fx.files(spark, s={"app.js": fx.NODE})
    heads = fx.heads(spark, ("s", "paste", ""))

    def sink(found, risk, batch_id):
        seen[batch_id] = (found.count(), risk.first().risk_level)

    jobs.score_batch(heads, str(tmp_path / "raw"), sink)(d.pattern_findings(files), 3)
    assert seen == {3: (1, "Critical")}


def test_batches_of_one_scan_are_scored_as_one(spark, tmp_path):
    """A second batch is scored with the first; a repeated one changes nothing; other scans stay out."""
    seen = {}
    parts = [fx.files(spark, s={"app.js": fx.NODE}), fx.files(spark, s={"lib/other.js": fx.NODE}, t={"x.js": fx.NODE})]
    heads = fx.heads(spark, ("s", "paste", ""))
    whole = {}

    def sink(into):
        def store(found, risk, batch_id):
            into[batch_id] = (sorted((r.scan_id, r.file_path, r.seq, r.severity) for r in found.collect()), sorted(map(tuple, risk.collect())))
        return store

    run = jobs.score_batch(heads, str(tmp_path / "raw"), sink(seen))
    for k, part in enumerate(parts):
        run(d.pattern_findings(part), k)
    jobs.score_batch(heads, str(tmp_path / "all"), sink(whole))(d.pattern_findings(parts[0].unionByName(parts[1])), 0)
    assert seen[1] == whole[0] and len(seen[0][0]) < len(seen[1][0])
    run(d.pattern_findings(parts[0]), 0)
    assert seen[0][0] == [r for r in whole[0][0] if r[0] == "s"]


def test_notifications_once(spark, tmp_path):
    year = 366 * 86400
    rows = [(1, "s", "completed", at(0)), (2, "s", "completed", at(5)), (3, "s", "failed", at(9)), (4, "n", "failed", at(9)), (5, "s", "completed", at(year)), (6, "s", "failed", None)]
    scans = spark.createDataFrame([("s", "u"), ("n", None)], "scan_id string, triggered_by string")
    for k, chunks in enumerate(([rows[:1], rows[1:4], rows[4:]], [[r] for r in rows[::-1]])):
        path = str(tmp_path / f"told{k}")
        candidates = jobs.notification_stream(stream(spark, tmp_path / str(k), chunks, EVENTS), scans)
        jobs.run_batches(candidates, "t", jobs.tell_once(path))
        told = KeyedTable(spark, path, jobs.NOTICE)
        got = sorted((r.user_id, r.type) for r in told.read().collect())
        assert got == [("u", "scan_completed"), ("u", "scan_failed")]
        first = {r.type: r.batch_id for r in told.read().collect()}
        # a batch that comes again tells nothing anew
        again = spark.createDataFrame([("u", "scan_failed", "s", at(1)), ("u", "scan_completed", "s", at(1))], "user_id string, type string, scan_id string, at timestamp")
        jobs.tell_once(path)(again, 99)
        assert {r.type: r.batch_id for r in told.read().collect()} == first


def test_a_batch_reads_only_the_scans_it_touches(spark, tmp_path):
    """Bytes read follow the touched scans, however many batches came before."""
    handler = jobs.score_batch(fx.heads(spark, ("s", "paste", "")), str(tmp_path / "state"))
    many = fx.files(spark, **{f"s{i}": {"app.js": fx.NODE} for i in range(30)})
    handler(d.pattern_findings(many), 0)
    handler(d.pattern_findings(fx.files(spark, s1={"more.js": fx.NODE})), 1)
    raw = KeyedTable(spark, str(tmp_path / "state" / "raw"), ["scan_id"])
    newest = spark.read.parquet(f"{tmp_path}/state/raw/rows/layer={raw.manifest().layers[-1]}")
    assert {r.scan_id for r in newest.select("scan_id").distinct().collect()} == {"s1"}
    touched = raw.read(spark.createDataFrame([("s1",)], "scan_id string"))
    opened = {f for f in touched.inputFiles()}
    assert {r.scan_id for r in touched.collect()} == {"s1"} and touched.where("file_path = 'more.js'").count() and opened
    assert KeyedTable(spark, str(tmp_path / "state" / "risk"), ["scan_id"]).read().count() == 30

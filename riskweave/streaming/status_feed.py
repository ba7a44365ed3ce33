"""The status feed as a keyed stream: a scan's status whenever it differs from the one told before.

The state of a scan is what the watermark has settled (its last status, or its end) and the events
that are still open to company.  A batch tells changes at once; where an event arrives out of order,
what it makes untrue is taken back: every change is a row with sign 1, its withdrawal one with
sign -1, and the changes that hold are those whose signs add up to one, in any order of reading.
An event-time timer settles open events when the watermark passes them.  A scan that has ended keeps
a mark for `keep` of event time, then a second timer clears it, so the state follows running scans.
Events behind the watermark (or without a time) cannot be placed any more.  They leave by the late
side, sign 0, and `settled` works their scans out again from the event table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATUS_OF = {"queued": "queued", "running": "running", "sast_scan_started": "running",
             "completed": "completed", "failed": "failed"}
TERMINAL = ("completed", "failed")
FED = "us long, id long, status string, sign int"
FED_ROW = Row("scan_id", "us", "id", "status", "sign")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def status_of(event_type):
    out = None
    for kind, status in STATUS_OF.items():
        out = F.when(event_type == kind, status) if out is None else out.when(event_type == kind, status)
    return out


def changes_after(before: str | None, events: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Events in order whose status differs from the one before, up to the first that ends the scan."""
    out = []
    for event in events:
        if event[2] != before:
            out.append(event)
            before = event[2]
            if before in TERMINAL:
                break
    return out


KEPT = "status string, ended long, due long, open array<struct<us: long, id: long, status: string>>"


def _in_order(events: list[tuple]) -> list[tuple]:
    """By time, then id (null first), then status."""
    return sorted(events, key=lambda e: (e[0], e[1] is not None, e[1] or 0, e[2]))


class Feed(StatefulProcessor):
    """Rows in, rows out.  Every call to the state is a round trip for each scan, so all that is kept of a scan is one value,
    its timer's time included: a batch reads it once, and writes it and moves the timer only where they change."""

    def __init__(self, keep_us: int):
        self.keep_us = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", KEPT)

    def _state(self) -> tuple:
        """Settled status, time of its end, the timer, events still open."""
        status, ended, due, held = self.kept.get() or (None, None, None, None)
        return status, ended, due, [tuple(e) for e in held or ()]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        before = status, ended, _, held = self._state()
        told = changes_after(status, held)
        fresh, late = [], []
        for r in rows:
            if r.us is not None and r.us >= mark:
                fresh.append((r.us, r.id, r.status))
            else:
                late.append((r.us, r.id, r.status, 0))
        out = late
        if ended is None:
            held = _in_order(held + fresh)
            now = changes_after(status, held)
            out = [(*e, 1) for e in set(now).difference(told)] + [(*e, -1) for e in set(told).difference(now)] + late
            self._settle(before, status, held, mark)
        return iter([FED_ROW(key[0], *e) for e in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        status, ended, _, held = self._state()
        if ended is not None and ended + self.keep_us <= mark:
            self.kept.clear()
        else:
            # the timer that brought us here is spent
            self._settle((status, ended, None, held), status, held, mark, ended)
        return iter([])

    def _settle(self, before: tuple, status: str | None, held: list, mark: int, ended: int | None = None) -> None:
        """Take in what lies behind the watermark, keep the rest, set the next timer."""
        for event in changes_after(status, [e for e in held if e[0] < mark]):
            status = event[2]
            ended = event[0] if status in TERMINAL else ended
        still_open = [e for e in held if e[0] >= mark] if ended is None else []
        due = ended + self.keep_us if ended is not None else still_open[-1][0] if still_open else None
        due = None if due is None else max(due, mark) // 1000 + 1
        if due != before[2]:
            if before[2] is not None:
                self.handle.deleteTimer(before[2])
            if due is not None:
                self.handle.registerTimer(due)
        if (status, ended, due, still_open) != before:
            self.kept.update((status, ended, due, still_open))

    def close(self) -> None:
        pass


def status_feed(events: DataFrame, delay: str = "1 hour", keep_hours: float = 24) -> DataFrame:
    """Changes and their withdrawals: scan_id, us, id, status, sign.  events: a stream of id, scan_id, event_type, created_at.

    delay: how long an event may lag behind the newest one and still be placed; keep_hours: how long an ended
    scan is remembered.  Neither changes what `settled` gives, only how much state is held and how much goes to the late side.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    key = dict(events.dtypes)["scan_id"]
    rows = events.withColumn("status", status_of(F.col("event_type"))).where("status is not null")
    timed = rows.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", delay)
    slim = timed.select("scan_id", F.unix_micros("at").alias("us"), F.col("id").cast("long").alias("id"), "status")
    return slim.groupBy("scan_id").transformWithState(Feed(int(keep_hours * 3600e6)), f"scan_id {key}, {FED}", "append", "eventTime")


def changes(events: DataFrame) -> DataFrame:
    """The same from a table: scan_id, created_at, id, status of every change until the scan's end."""
    rows = events.withColumn("status", status_of(F.col("event_type"))).where("status is not null")
    order = Window.partitionBy("scan_id").orderBy(F.asc_nulls_last("created_at"), "id")
    ended = F.max(F.col("status").isin(*TERMINAL)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    seen = rows.withColumn("before", F.lag("status").over(order)).withColumn("ended", F.coalesce(ended, F.lit(False)))
    return seen.where(~F.col("ended") & ~F.col("before").eqNullSafe(F.col("status"))).select(
        "scan_id", F.col("created_at").cast("timestamp").alias("created_at"), F.col("id").cast("long").alias("id"), "status")


def settled(fed: DataFrame, events: DataFrame) -> DataFrame:
    """scan_id, created_at, id, status of the changes that hold, from what the feed has told so far.

    Withdrawn changes cancel out.  A scan's story ends at its first end, also where its mark had been cleared
    before a later event came.  Scans on the late side are worked out from the event table, and only those.
    """
    late = fed.where("sign = 0").select("scan_id").distinct()
    told = fed.where("sign <> 0").groupBy("scan_id", "us", "id", "status").agg(F.sum("sign").alias("sign")).where("sign > 0")
    end = told.where(F.col("status").isin(*TERMINAL)).groupBy("scan_id").agg(F.min(F.struct("us", "id")).alias("end"))
    held = (told.join(late, "scan_id", "left_anti").join(end, "scan_id", "left")
            .where(F.col("end").isNull() | (F.struct("us", "id") <= F.col("end")))
            .select("scan_id", F.timestamp_micros("us").alias("created_at"), "id", "status"))
    return held.unionByName(changes(events.join(late, "scan_id", "left_semi")))

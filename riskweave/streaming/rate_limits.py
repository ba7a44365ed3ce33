"""Rate limits in windows that a key's own first request opens, parallel inside a key.

A window opens at a request and takes in what follows for its length; the first request behind it
opens the next one.  So every request has a jump pointer, the request that would open the next window
if a window opened here, and the windows of a key are the chain of pointers from its first request.

Requests are dealt by range over (key, time, id), so a hot key is spread over as many slices as its rows
need.  In a slice, pointers and chains of all keys are worked out together by array operations, chains by
doubling.  What a slice does to a key that comes in from the slice before depends on the open window alone:
the request that opens the first window of its own decides which window is open at the end.  This step
function, with equal outcomes merged, is the slice's transition function; composing it over the slices of
a key gives each of them the window it starts with, and those rows are counted again from there.

As a stream, the open window of every key is kept in a table; a batch starts from it.  Requests that come
behind what has been counted send their keys, and those alone, back to the filed requests.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from riskweave import fixed_values as fv
from riskweave.session import checkpoint_root, stage
from riskweave.sources.keyed_table import KeyedTable
from riskweave.sources.sinks import LAYERS

SLICE_ROWS = 500_000
OPEN = np.iinfo(np.int64).min      # no window is open
UNTIMED = np.iinfo(np.int64).max   # a request without a time: last of its key, opens no window but the very first
ORDER = ["key", "us", "id"]


@dataclass(frozen=True)
class Rule:
    """limit requests in a window; counted: whether rejected ones count and the last instant still belongs to the window."""

    limit: int = fv.GUEST_LIMIT
    window_us: int = fv.GUEST_WINDOW_SECONDS * 1_000_000
    counted: bool = True


def jumps(segment: np.ndarray, us: np.ndarray, rule: Rule) -> np.ndarray:
    """Place of the request that opens the next window if one opens at each row; the number of rows where none does.

    Rows are in order; segment numbers their keys from 0.
    """
    n = len(us)
    timed = us != UNTIMED
    ends = us[timed] + rule.window_us
    values = np.unique(np.concatenate([us[timed], ends]))
    wide = len(values) + 1
    at = segment * wide + np.where(timed, np.searchsorted(values, us), wide - 1)
    out = np.full(n, n)
    found = np.searchsorted(at, segment[timed] * wide + np.searchsorted(values, ends), "right" if rule.counted else "left")
    inside = np.minimum(found, n - 1)
    same = (found < n) & (segment[inside] == segment[timed]) & timed[inside]
    out[timed] = np.where(same, found, n)
    return out


def chain(jump: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which rows the pointers reach from the starts, the starts included."""
    n = len(jump)
    step, reached = np.append(jump, n), np.zeros(n + 1, bool)
    reached[starts] = True
    while True:
        before = int(reached[:n].sum())
        reached[step[np.flatnonzero(reached)]] = True
        if int(reached[:n].sum()) == before:
            return reached[:n]
        step = step[step]


def last_of_chain(jump: np.ndarray) -> np.ndarray:
    """The row at which the chain from each row ends."""
    n = len(jump)
    step = np.where(jump < n, jump, np.arange(n))
    while True:
        further = step[step]
        if (further == step).all():
            return step
        step = further


@dataclass
class Counted:
    """Rank of every row in its window, and each key's open window at the end."""

    rank: np.ndarray
    expiry: np.ndarray
    count: np.ndarray


def count(segment: np.ndarray, us: np.ndarray, expiry: np.ndarray, entered: np.ndarray, rule: Rule) -> Counted:
    """Rows in order, by key; expiry and entered: of each key's window at the start (OPEN and -1: no request before)."""
    n = len(us)
    place = np.arange(n)
    begin = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
    size = np.diff(np.append(begin, n))
    jump = jumps(segment, us, rule)
    within = (us != UNTIMED) & ((us <= expiry[segment]) if rule.counted else (us < expiry[segment]))
    first = begin + np.add.reduceat(within.astype(np.int64), begin)
    inside = np.minimum(first, n - 1)
    opens = (first < begin + size) & ((us[inside] != UNTIMED) | (entered < 0))
    first = np.where(opens, first, begin + size)
    anchor = chain(jump, first[opens])
    opened = np.maximum.accumulate(np.where(anchor, place, -1))
    before = place < first[segment]
    rank = np.where(before, np.maximum(entered, 0)[segment] + place - begin[segment] + 1, place - opened + 1)
    last = begin + size - 1
    opener = us[np.maximum(opened[last], 0)]
    end = np.where(opens, np.where(opener == UNTIMED, OPEN, opener + np.where(opener == UNTIMED, 0, rule.window_us)), expiry)
    return Counted(rank, end, rank[last])


def transition(us: np.ndarray, rule: Rule) -> tuple[list[int], list[int], list[int]]:
    """The step function of one key's rows: for a first own window opened up to a time, the expiry and the count at the end."""
    timed = int((us != UNTIMED).sum())
    if not timed:
        return [], [], []
    last = last_of_chain(jumps(np.zeros(len(us), np.int64), us, rule))[:timed]
    tail = np.flatnonzero(np.append(last[1:] != last[:-1], True))
    return us[tail].tolist(), (us[last[tail]] + rule.window_us).tolist(), (len(us) - last[tail]).tolist()


SLICED = ("part int, first boolean, id long, key string, us long, rank long, "
          "summary boolean, rows long, expiry long, count long, until array<long>, expiries array<long>, counts array<long>, entry long, entered long")


def _segments(keys: pa.Array) -> tuple[np.ndarray, list]:
    """Numbers of the keys in order of appearance, and the keys; rows of a key stand together."""
    coded = keys.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _slice(batches: Iterable[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Counts of one slice as if every key started here or from its kept window, and a summary a key."""
    table = pa.Table.from_batches(batches)
    if not table.num_rows:
        return
    part = TaskContext.get().partitionId()
    column = lambda name: table.column(name).combine_chunks()
    segment, names = _segments(column("key"))
    us = column("us").to_numpy(zero_copy_only=False)
    begin = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
    entry, entered = (column(c).to_numpy(zero_copy_only=False)[begin] for c in ("expiry", "entered"))
    done = count(segment, us, entry, entered, rule)
    n, k = len(us), len(names)
    whole, none = pa.nulls, lambda m: pa.nulls(m, pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, part), pa.int32()), pa.array(segment == 0), column("id"), column("key"), column("us"), pa.array(done.rank), pa.array(np.zeros(n, bool)),
         *[whole(n, pa.int64())] * 3, *[none(n)] * 3, *[whole(n, pa.int64())] * 2], _NAMES)
    steps = transition(us[segment == 0], rule)
    lead = lambda values: pa.array([values] + [None] * (k - 1), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(k, part), pa.int32()), pa.array(np.arange(k) == 0), whole(k, pa.int64()), pa.array(names, pa.string()), whole(k, pa.int64()), whole(k, pa.int64()), pa.array(np.ones(k, bool)),
         pa.array(np.bincount(segment), pa.int64()), pa.array(done.expiry), pa.array(done.count), *map(lead, steps), pa.array(entry), pa.array(entered)], _NAMES)


_NAMES = [c.split()[0] for c in SLICED.split(", ")]


def _compose(slices: pd.DataFrame, counted: bool) -> pd.DataFrame:
    """The window that each slice of one key starts with, and (part -1) the one open at its end."""
    slices = slices.sort_values("part")
    out, expiry, entered = [], None, None
    for s in slices.itertuples():
        if expiry is None:
            expiry, entered = s.expiry, s.count              # counted from the kept window already
            continue
        out.append((s.part, s.key, expiry, entered))
        at = int(np.searchsorted(np.asarray(s.until, np.int64), expiry, "right" if counted else "left"))
        if at < len(s.until):
            expiry, entered = int(s.expiries[at]), int(s.counts[at])
        else:
            entered += s.rows
    out.append((-1, slices["key"].iloc[0], expiry, entered))
    return pd.DataFrame(out, columns=["part", "key", "expiry", "entered"])


def _recount(batches: Iterable[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice, each slice of one key, counted from the window it starts with."""
    held: list[pa.Table] = []

    def out() -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(held).combine_chunks()
        column = lambda name: rows.column(name).combine_chunks()
        us = column("us").to_numpy(zero_copy_only=False)
        done = count(np.zeros(len(us), np.int64), us, *(column(c).to_numpy(zero_copy_only=False)[:1] for c in ("expiry", "entered")), rule)
        yield pa.RecordBatch.from_arrays([column("id"), column("key"), column("us"), pa.array(done.rank)], ["id", "key", "us", "rank"])

    for batch in batches:
        parts = batch.column("part").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[-1].column("part")[-1].as_py() != int(parts[a]):
                yield from out()
                held = []
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield from out()


def windows_of(requests: DataFrame, rule: Rule, open_windows: DataFrame | None = None, slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows, windows): id, key, us, rank in its window of every request; and each key's open window, key, expiry, count.

    requests: id, key, us (UNTIMED for none).  open_windows: key, expiry, count at the start.
    """
    rows = requests.select("id", "key", "us")
    if open_windows is None:
        rows = rows.withColumns({"expiry": F.lit(int(OPEN)), "entered": F.lit(-1).cast("long")})
    else:
        kept = open_windows.select("key", "expiry", F.col("count").alias("entered"))
        rows = rows.join(kept, "key", "left").withColumns({"expiry": F.coalesce("expiry", F.lit(int(OPEN))), "entered": F.coalesce("entered", F.lit(-1).cast("long"))})
    slices = max(1, -(-rows.count() // slice_rows))
    dealt = rows.repartitionByRange(slices, *ORDER).sortWithinPartitions(*ORDER)
    sliced = stage(dealt.mapInArrow(partial(_slice, rule=rule), SLICED), "slices")
    summaries = sliced.where("summary")
    spread = summaries.groupBy("key").count().where("count > 1").select("key")
    entries = stage(
        summaries.join(spread, "key", "left_semi").groupBy("key").applyInPandas(partial(_compose, counted=rule.counted), "part int, key string, expiry long, entered long"), "entries")
    # a slice holds the end of at most one key that came from the slice before
    again = entries.where("part >= 0").select("part", "expiry", "entered")
    lead = sliced.where("not summary and first").select("part", "id", "key", "us", "rank")
    moved = (lead.drop("rank").join(again, "part").repartition(slices, "part").sortWithinPartitions("part", "us", "id")
             .mapInArrow(partial(_recount, rule=rule), "id long, key string, us long, rank long"))
    stay = lead.join(again.select("part"), "part", "left_anti").drop("part")
    ranked = sliced.where("not summary and not first").select("id", "key", "us", "rank").unionByName(stay).unionByName(moved)
    ends = (summaries.join(spread, "key", "left_anti").select("key", "expiry", "count")
            .unionByName(entries.where("part < 0").select("key", "expiry", F.col("entered").alias("count"))))
    return ranked, ends


def outcomes(ranked: DataFrame, rule: Rule) -> DataFrame:
    """id, ip, count, remaining, allowed."""
    counted = F.col("rank") if rule.counted else F.least("rank", F.lit(rule.limit))
    name = F.when(F.col("key") != "null", F.substr("key", F.lit(2)))
    return ranked.select("id", name.alias("ip"), counted.cast("long").alias("count"),
                         F.greatest(F.lit(rule.limit) - counted, F.lit(0)).cast("long").alias("remaining"), (F.col("rank") <= rule.limit).alias("allowed"))


def keyed(requests: DataFrame) -> DataFrame:
    """id, key, us of requests(id, ip, ts); a request without an address has a key of its own."""
    key = F.coalesce(F.concat(F.lit("="), F.col("ip").cast("string")), F.lit("null"))
    us = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(int(UNTIMED)))
    return requests.select(F.col("id").cast("long").alias("id"), key.alias("key"), us.alias("us"))


def count_batch(path: str, rule: Rule, slice_rows: int = SLICE_ROWS):
    """foreachBatch handler over keyed requests.

    path/requests files every batch, path/windows keeps each key's open window and the newest request
    counted, path/outcomes holds the counts of each batch.  A batch that comes again lies behind what has
    been counted, so its keys are counted anew from the filed requests, with the same result.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/requests/batch={batch_id}")
        mine = spark.read.schema(batch.schema).parquet(f"{path}/requests/batch={batch_id}")
        table = KeyedTable(spark, f"{path}/windows", ["key"])
        newest = mine.groupBy("key").agg(F.min("us").alias("from_us"), F.max("us").alias("to_us"))
        if table.manifest():
            touched = stage(newest.join(table.read(newest), "key", "left"), "touched")
            behind = touched.where("from_us <= last_us").select("key")
            filed = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(f"{path}/requests")
            ahead = mine.join(behind, "key", "left_anti")
            rows, ends = windows_of(ahead, rule, touched.where("last_us is not null").join(behind, "key", "left_anti"), slice_rows)
            if not behind.isEmpty():
                more, more_ends = windows_of(filed.join(behind, "key", "left_semi"), rule, None, slice_rows)
                rows, ends = rows.unionByName(more), ends.unionByName(more_ends)
            newest = touched.select("key", "to_us", "last_us")
        else:
            rows, ends = windows_of(mine, rule, None, slice_rows)
            newest = newest.select("key", "to_us", F.lit(None).cast("long").alias("last_us"))
        rows.write.mode("overwrite").parquet(f"{path}/outcomes/batch={batch_id}")
        kept = ends.join(newest, "key").select("key", "expiry", "count", F.greatest("to_us", "last_us").alias("last_us"))
        if table.replace(stage(kept, "windows")) % LAYERS == 0:
            table.compact()
    return run


def told(spark, path: str, rule: Rule) -> DataFrame:
    """The newest count of every request."""
    rows = spark.read.parquet(f"{path}/outcomes")
    return outcomes(rows.groupBy("id", "key").agg(F.max_by("rank", "batch").alias("rank")), rule)


def rate_limit(requests: DataFrame, limit: int = fv.GUEST_LIMIT, window_seconds: int = fv.GUEST_WINDOW_SECONDS, count_rejected: bool = True, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Run over the requests (a stream of id, ip, ts) that are there: id, ip, count, remaining, allowed of each.

    count_rejected=True: rejected calls count, the window ends strictly after its length.
    count_rejected=False: they do not count, the window ends at its length.
    Equal in any cut of the requests into batches.  An id belongs to one request of an address.
    """
    spark = requests.sparkSession
    rule = Rule(limit, window_seconds * 1_000_000, count_rejected)
    base = f"{checkpoint_root(spark)}/streams/limits-{uuid.uuid4().hex}"
    (keyed(requests).writeStream.foreachBatch(count_batch(base, rule, slice_rows)).option("checkpointLocation", f"{base}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return told(spark, base, rule)

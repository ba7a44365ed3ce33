"""Removal of word passages that an earlier document holds, by seed and extend.

Words are runs outside ASCII white space.  A window is `window` consecutive words of one document;
it is a repeat when the same window starts in a document with a smaller id.

Seeds: the anchor of a window is the leftmost of its `gram`-word sequences with the smallest hash
(winnowing), so equal windows have equal anchors at equal places, and an anchor stands for a run
of consecutive windows, one anchor for about sixteen words.  Documents are joined on anchors; an
anchor that only one document holds is dropped there, with most of the corpus.

Extension: all windows of an anchor together span its words and those to both sides.  Occurrences
that agree on the whole span are one class; all but those of its smallest document are repeats,
whatever their number, without a comparison.  Only where an anchor has several classes is one
class able to share a part of its windows with another; for those the smallest document's windows
are compared one by one, each with the smallest document that holds it.  So a passage in millions of
documents costs them one aggregated row each, and pairs of occurrences are never formed.

Maximal repeats are the unions of repeated windows.  Words, anchors and windows are known by hashes:
words and anchors by 64 bits, windows by 128.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from riskweave.llm.common import documents, hot_join, keep, windows

WINDOW, GRAM = 50, 20
MARKED = ["doc_id", "mark"]
ANCHORS = "doc_id long, mark long, first int, run int, anchor long, span long"
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ROWS = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """64-bit hashes of words; known ones are kept up to a bound."""

    def __init__(self, most: int = 300_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class Spans:
    """Hashes of any run of words: sums of word hash times base ** place, shifted back to place 0 (mod 2 ** 64)."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes) + 1
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
        self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, pow(base, -1, 1 << 64), np.uint64)]))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1])])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.back[start]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def anchors_of(hashes: np.ndarray, begins: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of documents laid end to end: document, first window, number of windows, hash of the anchor, hash of the span.

    hashes: of all words; begins: place of each document's first word and, last, the number of words.
    """
    n, wide = len(hashes), window - gram + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    spans = Spans(hashes, BASES[0])
    place = np.arange(n - gram + 1)
    grams = mixed(spans(place, place + gram))
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    starts = np.arange(n - window + 1)
    starts = starts[starts + window <= begins[owner[starts] + 1]]
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(grams, wide)
    at = np.concatenate([view[starts[i:i + ROWS]].argmin(1) for i in range(0, len(starts), ROWS)]) + starts
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[starts[1:]] != owner[starts[:-1]])
    head = np.flatnonzero(new)
    run = np.diff(np.append(head, len(starts)))
    first, seed = starts[head], at[head]
    shape = (run * (2 * window) + (seed - first)).astype(np.uint64)
    whole = mixed(spans(first, first + run - 1 + window) ^ mixed(shape))
    return owner[first], first - begins[owner[first]], run, grams[seed], whole


def _anchors(batches: Iterable[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    hashes = Words()
    for rows in windows(batches):
        words = [words_of(t) for t in rows.column("text").to_pylist()]
        begins = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        doc, first, run, anchor, span = anchors_of(hashes([w for doc in words for w in doc]), begins, window, gram)
        at = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id").take(at), rows.column("mark").take(at), pa.array(first, pa.int32()), pa.array(run, pa.int32()),
             pa.array(anchor.view(np.int64)), pa.array(span.view(np.int64))], ["doc_id", "mark", "first", "run", "anchor", "span"])


def _places(spans: list[dict]) -> np.ndarray:
    return np.concatenate([np.arange(s["first"], s["first"] + s["run"]) for s in spans])


def _single_windows(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Both hashes of every window of the listed runs."""
    hashes = Words()
    for rows in windows(batches):
        parts: list[tuple] = []
        for i, (text, spans) in enumerate(zip(rows.column("text").to_pylist(), rows.column("spans").to_pylist())):
            h, p = hashes(words_of(text)), _places(spans)
            parts.append((np.full(len(p), i), p, Spans(h, BASES[0])(p, p + window), Spans(h, BASES[1])(p, p + window)))
        doc, place, one, two = (np.concatenate(column) for column in zip(*parts))
        at = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id").take(at), rows.column("mark").take(at), pa.array(place, pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
            ["doc_id", "mark", "first", "one", "two"])


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, so that rows of one id with different texts stay apart."""
    return documents(docs).withColumn("mark", F.xxhash64("text"))


def _listed(spans: DataFrame) -> DataFrame:
    """One row a document: its runs.  Repeated rows of a document find the same runs once."""
    return spans.select(*MARKED, "first", "run").distinct().groupBy(*MARKED).agg(F.collect_list(F.struct("first", "run")).alias("spans"))


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, mark (hash of the text), first, run: runs of windows that start in a document with a smaller id too.

    docs: doc_id, text.  Rows without an id have no order and take no part; rows of one id are not
    earlier than each other.  Exact for every number of copies.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must lie between one and window")
    rows = marked(docs).where("doc_id is not null")
    anchors = keep(rows.mapInArrow(partial(_anchors, window=window, gram=gram), ANCHORS), "anchors")
    held = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    seeds = keep(held.where("lo < hi").select("anchor", "n"), "seeds")
    shared = keep(hot_join(anchors, seeds, ["anchor"], anchors.count(), "left_semi"), "shared")
    classes = keep(shared.groupBy("anchor", "span").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "classes")
    contested = classes.groupBy("anchor").agg(F.min("lo").alias("least"), F.max("lo").alias("most")).where("least < most").select("anchor", F.lit(True).alias("contested"))
    judged = classes.join(contested, "anchor", "left").where("hi > lo or contested").select("anchor", "span", "lo", F.coalesce("contested", F.lit(False)).alias("contested"))
    found = keep(shared.join(judged, ["anchor", "span"]).where("doc_id > lo or contested").select(*MARKED, "first", "run", (F.col("doc_id") > F.col("lo")).alias("repeat")), "found")
    single = keep(
        rows.join(_listed(found.where("not repeat")), MARKED).select(*MARKED, "text", "spans")
        .mapInArrow(partial(_single_windows, window=window), "doc_id long, mark long, first int, one long, two long"), "windows")
    earliest = single.groupBy("one", "two").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    later = single.join(earliest, ["one", "two"]).where("doc_id > lo").select(*MARKED, "first", F.lit(1).alias("run"))
    return found.where("repeat").select(*MARKED, "first", "run").unionByName(later)


def _without(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for rows in windows(batches):
        n_words, n_removed, kept, cuts = [], [], [], []
        for text, spans in zip(rows.column("text").to_pylist(), rows.column("spans").to_pylist()):
            words = words_of(text)
            ranges = []
            for first, end in sorted((s["first"], s["first"] + s["run"] - 1 + window) for s in spans or ()):
                if ranges and first <= ranges[-1]["end"]:
                    ranges[-1]["end"] = max(end, ranges[-1]["end"])
                else:
                    ranges.append({"start": first, "end": end})
            left, at = [], 0
            for r in ranges:
                left += words[at:r["start"]]
                at = r["end"]
            left += words[at:]
            n_words.append(len(words)), n_removed.append(len(words) - len(left)), cuts.append(ranges)
            kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(cuts, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "n_removed", "repeats", "kept"])


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, repeats (maximal, as word ranges) and kept (the other words, one space between) of every row.

    docs: doc_id, text; other columns are ignored.  A null or blank text has no words; a row without
    an id stays whole; repeated rows are judged alike.
    """
    rows = marked(docs).join(_listed(repeats(docs, window, gram)), MARKED, "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(
        partial(_without, window=window), "doc_id long, n_words long, n_removed long, repeats array<struct<start: int, end: int>>, kept string")

"""Token ids in binary shard files: each document compressed alone under one shared dictionary.

Folder: shards/*.tok, a dictionary file, and manifest/ (Parquet, a row per shard).  A shard is

    magic, version, width of an id, sha256 of the dictionary      40 bytes
    one zstandard frame per document, in ascending doc_id order
    index: doc_id int64[n], known uint8[n], n_tokens uint64[n], offset uint64[n + 1]
    n uint64, place of the index uint64, magic                     20 bytes

so a document is found with one look at the index and one short read.  Only shards that the
manifest names count: a task that was lost and ran again leaves a file nobody reads.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskweave.llm.common import documents, windows
from riskweave.llm.word_ids import word_ids

MAGIC, VERSION = b"TKZ1", 1
HEAD, TAIL = struct.Struct("<4sBBxx32s"), struct.Struct("<QQ4s")
LEVEL = 3
SAMPLE_ROWS = 1000                # documents that train the dictionary, at most
SAMPLE_BYTES = 1 << 16            # longer arrays gain nothing from a dictionary and do not train it
DICTIONARY_BYTES = 1 << 16
MANIFEST = "shard long, path string, n_docs long, n_tokens long, dictionary_sha256 string"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path of an address; s3a and s3n, as Spark names them, are S3's."""
    scheme, colon, rest = uri.partition(":")
    return fs.FileSystem.from_uri(f"s3:{rest}" if colon and scheme in ("s3a", "s3n") else uri)


@lru_cache(maxsize=4)
def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT) if raw else None


# -- writing ---------------------------------------------------------------------
def _serialized(batches: Iterable[pa.RecordBatch], tokens: str, end: int) -> Iterator[pa.RecordBatch]:
    encoder = word_ids(tokens)
    for window in windows(batches):
        ids = encoder.texts(window.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [window.column("doc_id"), pa.array([np.append(x, end).astype(encoder.kind).tobytes() for x in ids], pa.binary())], ["doc_id", "ids"])


def train_dictionary(docs: DataFrame, tokens: str, end: int, rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from the id arrays of about `rows` documents with the smallest id hashes.

    Bounded: at most `rows` arrays of SAMPLE_BYTES reach the driver.  Too little text to learn
    from gives an empty dictionary, and documents are then compressed without one.
    """
    place = F.xxhash64("doc_id")
    last = docs.select(place.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return b""
    chosen = docs.where(place <= last).limit(rows).mapInArrow(partial(_serialized, tokens=tokens, end=end), "doc_id long, ids binary")
    samples = [bytes(r[0]) for r in chosen.where(F.length("ids") <= SAMPLE_BYTES).select("ids").collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressed(batches: Iterable[pa.RecordBatch], tokens: str, end: int, raw: bytes, bounds: list) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw)).compress
    width = word_ids(tokens).width
    for batch in _serialized(batches, tokens, end):
        ids, arrays = batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([0 if d is None else bisect_right(bounds, d) for d in ids], pa.int64()),
            pa.array([len(a) // width for a in arrays], pa.int64()), pa.array(map(pack, arrays), pa.binary())],
            ["doc_id", "shard", "n_tokens", "frame"])


class _Shard:
    """One shard file being written, frame by frame; only the index stays in memory."""

    def __init__(self, folder: str, shard: int, width: int, digest: bytes):
        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        self.shard, self.digest = shard, digest
        name = f"{shard:08d}-{uuid.uuid4().hex}.tok"
        self.uri, self.out = f"{folder}/{name}", files.open_output_stream(f"{path}/{name}")
        self.out.write(HEAD.pack(MAGIC, VERSION, width, digest))
        self.ids, self.sizes, self.offsets = [], [], [HEAD.size]

    def add(self, doc: int | None, n_tokens: int, frame: bytes) -> None:
        self.out.write(frame)
        self.ids.append(doc)
        self.sizes.append(n_tokens)
        self.offsets.append(self.offsets[-1] + len(frame))

    def close(self) -> tuple:
        self.out.write(np.array([0 if d is None else d for d in self.ids], "<i8").tobytes())
        self.out.write(np.array([d is not None for d in self.ids], "u1").tobytes())
        self.out.write(np.array(self.sizes, "<u8").tobytes())
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(TAIL.pack(len(self.ids), self.offsets[-1], MAGIC))
        self.out.close()
        return self.shard, self.uri, len(self.ids), sum(self.sizes), self.digest.hex()


def _write(batches: Iterable[pa.RecordBatch], folder: str, width: int, digest: bytes) -> Iterator[pa.RecordBatch]:
    shard, rows = None, []
    for batch in batches:
        for doc, number, n_tokens, frame in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "shard", "n_tokens", "frame"))):
            if shard is None or shard.shard != number:
                if shard is not None:
                    rows.append(shard.close())
                shard = _Shard(folder, number, width, digest)
            shard.add(doc, n_tokens, frame)
    if shard is not None:
        rows.append(shard.close())
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["shard", "path", "n_docs", "n_tokens", "dictionary_sha256"])


def write_store(docs: DataFrame, folder: str, tokens: str, end: int) -> DataFrame:
    """Write the ids of all documents below `folder`; returns the manifest.

    tokens is a tokenizers file, end the id behind every document (a null or empty text is that
    id alone).  Ascending doc_id, null first; repeated ids stay neighbours in the order of their
    compressed bytes.  Shards are ranges of doc_id of about one input split each, so the sort
    runs range by range and files are as many as the input has splits.
    """
    spark = docs.sparkSession
    docs = documents(docs)
    raw = train_dictionary(docs, tokens, end)
    digest = hashlib.sha256(raw).digest()
    files, path = _open(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/dictionary") as out:
        out.write(raw)
    n = docs.rdd.getNumPartitions()
    cuts = docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else []
    bounds = sorted({int(c) for c in cuts})
    frames = docs.mapInArrow(partial(_compressed, tokens=tokens, end=end, raw=raw, bounds=bounds),
                             "doc_id long, shard long, n_tokens long, frame binary")
    ordered = frames.repartitionById(len(bounds) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", "doc_id", "frame")
    ordered.mapInArrow(partial(_write, folder=f"{folder}/shards", width=word_ids(tokens).width, digest=digest), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


# -- reading ---------------------------------------------------------------------
class Reader:
    """One open shard: its index, and documents by place."""

    def __init__(self, uri: str, raw: bytes):
        files, path = _open(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        n, at, magic = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        head, _, width, digest = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        if head != MAGIC or magic != MAGIC:
            raise ValueError(f"{uri} is no whole shard")
        if digest != hashlib.sha256(raw).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        index = self.file.read_at(size - TAIL.size - at, at)
        self.ids, self.known = np.frombuffer(index, "<i8", n), np.frombuffer(index, "u1", n, 8 * n).astype(bool)
        self.n_tokens, self.offsets = np.frombuffer(index, "<u8", n, 9 * n), np.frombuffer(index, "<u8", n + 1, 17 * n)
        self.kind = np.dtype(f"<u{width}")
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress

    def tokens(self, place: int) -> np.ndarray:
        begin, end = int(self.offsets[place]), int(self.offsets[place + 1])
        return np.frombuffer(self.unpack(self.file.read_at(end - begin, begin)), self.kind)

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of the document with that id (several, if the id repeats)."""
        return [self.tokens(p) for p in np.flatnonzero(self.known & (self.ids == doc_id))]


def dictionary_of(folder: str) -> bytes:
    files, path = _open(f"{folder}/dictionary")
    with files.open_input_file(path) as f:
        return f.read()


def _read(batches: Iterable[pa.RecordBatch], raw: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            shard = Reader(uri, raw)
            starts = start + np.cumsum(np.append(0, shard.n_tokens[:-1])).astype(np.int64)
            for k in range(0, len(shard.ids), 256):
                places = range(k, min(k + 256, len(shard.ids)))
                ids = [shard.tokens(p).astype("<u4").tobytes() for p in places]
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard.ids[places.start:places.stop], mask=~shard.known[places.start:places.stop]),
                    pa.array(starts[places.start:places.stop]), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit) of every document.

    The manifest has one row per shard; their running sum is the only ordered step.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    shards = max(1, manifest.count())
    return placed.select("path", "start").repartition(shards, "path").mapInArrow(
        partial(_read, raw=dictionary_of(folder)), "doc_id long, start long, ids binary")

"""Source corpora as tables: file trees, pasted payloads, archives."""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweave import fixed_values as fv
from riskweave.schemas import missing

_REPLACEMENT = "�"


def decode_utf8(content: Column) -> Column:
    """Bytes as text with undecodable bytes dropped (a real U+FFFD goes too)."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit(_REPLACEMENT), F.lit(""))


# S1 -----------------------------------------------------------------------
def read_source_tree(spark: SparkSession, root: str, scan_id: str | None = None) -> DataFrame:
    """Every file below root.  Without scan_id the first folder names the scan.

    `binaryFile` drops the content column from the scan when nobody selects it, so
    path filters such as `is_scannable` can be counted without reading file bodies.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].split(":", 1)[-1]
    relative = F.expr("regexp_replace(path, '^[a-z0-9]+:/{0,2}(?=/)', '')")
    inside = F.substring(relative, len(base) + 2, 1 << 30)
    if scan_id is None:
        scan = F.element_at(F.split(inside, "/"), 1)
        path = F.regexp_replace(inside, "^[^/]+/", "")
    else:
        scan, path = F.lit(scan_id), inside
    return raw.select(
        scan.alias("scan_id"), path.alias("file_path"),
        decode_utf8(F.col("content")).alias("content"), F.col("length").alias("size"),
    )


# P11 ----------------------------------------------------------------------
def escapes_root(path: Column) -> Column:
    """True when a relative path leaves its root at its resolved end."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    # resolve '..' right to left: a step survives when fewer '..' than steps follow it
    depth = F.aggregate(
        steps, F.struct(F.lit(0).alias("up"), F.lit(0).alias("down")),
        lambda acc, s: F.when(
            s == "..",
            F.when(acc["down"] > 0, F.struct(acc["up"].alias("up"), (acc["down"] - 1).alias("down")))
            .otherwise(F.struct((acc["up"] + 1).alias("up"), acc["down"].alias("down"))),
        ).otherwise(F.struct(acc["up"].alias("up"), (acc["down"] + 1).alias("down"))),
        lambda acc: acc["up"],
    )
    return path.startswith("/") | (depth > 0)


def bad_proxy_path(path: Column) -> Column:
    """Proxy variant: any segment that is empty, '.', '..' or hides a separator."""
    def bad(segment):
        decoded = F.try_url_decode(segment)
        return (
            segment.rlike("(?i)%(?:00|2e|2f|5c)")
            | decoded.isNull()
            | decoded.isin("", ".", "..")
            | decoded.rlike(r"[/\\\x00]")
        )
    return F.exists(F.split(path, "/"), bad)


# S2 -----------------------------------------------------------------------
_FILES = "array<struct<path:string,content:string>>"


def expand_pasted(payloads: DataFrame) -> DataFrame:
    """(scan_id, payload) -> one row per pasted file, with the payload's verdict.

    A payload with any unsafe path is refused as a whole: its rows carry
    rejected = true.  Items without a path are dropped.
    """
    listed = F.from_json("payload", _FILES)
    wrapped = F.from_json("payload", f"struct<files:{_FILES}>")["files"]
    files = F.when(F.col("payload").rlike(r"^\s*\["), listed).otherwise(wrapped)
    named = F.filter(files, lambda f: missing(f["path"]).isNotNull())
    return (
        payloads.select("scan_id", named.alias("files"))
        .withColumn("rejected", F.exists("files", lambda f: escapes_root(f["path"])))
        .select("scan_id", "rejected", F.explode("files").alias("f"))
        .select(
            "scan_id", F.col("f.path").alias("file_path"),
            F.coalesce("f.content", F.lit("")).alias("content"),
            F.octet_length(F.coalesce("f.content", F.lit(""))).cast("bigint").alias("size"),
            "rejected",
        )
    )


# S3 -----------------------------------------------------------------------
_MEMBERS = "archive string, ordinal int, member string, size bigint, kind string, content binary"


def _members(name: str, body: bytes, max_bytes: int, max_files: int) -> Iterator[tuple]:
    """Members of one archive, bodies only while the archive is inside its limits.

    A damaged or mislabelled archive ends with one row of kind 'corrupt'.
    """
    total, lowered, i = 0, name.lower(), 0
    try:
        if lowered.endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(body)) as zf:
                for i, info in enumerate(zf.infolist(), 1):
                    link = (info.external_attr >> 16) & 0o170000 == 0o120000
                    kind = "link" if link else "dir" if info.is_dir() else "file"
                    total += info.file_size
                    inside = total <= max_bytes and i <= max_files
                    yield (name, i, info.filename, info.file_size, kind,
                           zf.read(info) if kind == "file" and inside else None)
        elif lowered.endswith((".gz", ".tgz")):
            with tarfile.open(fileobj=io.BytesIO(body)) as tf:
                for i, info in enumerate(tf, 1):
                    kind = ("link" if info.issym() or info.islnk() else "device" if info.isdev()
                            else "dir" if info.isdir() else "file")
                    total += info.size
                    inside = total <= max_bytes and i <= max_files
                    yield (name, i, info.name, info.size, kind,
                           tf.extractfile(info).read() if kind == "file" and inside else None)
        else:
            yield (name, 0, "", 0, "unsupported", None)
    except (zipfile.BadZipFile, tarfile.TarError, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError):
        yield (name, i + 1, "", 0, "corrupt", None)


@dataclass(frozen=True)
class ArchiveLimits:
    """What an archive may hold.  Expansion and verdict take the same limits, so an accepted archive has all its bodies."""

    max_bytes: int = fv.MAX_ARCHIVE_BYTES
    max_files: int = fv.MAX_ARCHIVE_FILES


def expand_archives(archives: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """(archive, body) -> one row per member; Spark spreads the archives over tasks."""
    def run(batches):
        for batch in batches:
            for name, body in zip(batch["archive"], batch["body"]):
                rows, held = [], 0
                for row in _members(name, bytes(body), limits.max_bytes, limits.max_files):
                    rows.append(row)
                    held += len(row[5] or b"")
                    if held > (16 << 20) or len(rows) >= 4096:
                        yield pd.DataFrame(rows, columns=["archive", "ordinal", "member", "size", "kind", "content"])
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "ordinal", "member", "size", "kind", "content"])
    return archives.select("archive", "body").mapInPandas(run, _MEMBERS)


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select(F.try_element_at(F.split("path", "/"), F.lit(-1)).alias("archive"), F.col("content").alias("body"))


# W4 -----------------------------------------------------------------------
def archive_verdicts(members: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """One row per archive: totals and the limits it breaks.

    Sizes are never negative, so some running total passes a limit exactly when the
    final total does; plain sums replace an ordered running sum.
    """
    unsafe = escapes_root(F.col("member")) | F.col("kind").isin("link", "device")
    totals = members.groupBy("archive").agg(
        F.sum("size").alias("total_size"),
        F.count(F.lit(1)).alias("member_count"),
        F.max(unsafe).alias("unsafe"),
        F.max(F.col("kind") == "unsupported").alias("unsupported"),
        F.max(F.col("kind") == "corrupt").alias("corrupt"),
    )
    return totals.withColumns({
        "too_large": F.col("total_size") > limits.max_bytes,
        "too_many": F.col("member_count") > limits.max_files,
    }).withColumn("accepted", ~(F.col("unsafe") | F.col("unsupported") | F.col("corrupt") | F.col("too_large") | F.col("too_many")))


def accepted_files(members: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Source files of the archives that passed."""
    good = verdicts.filter("accepted").select("archive")
    return (
        members.filter("kind = 'file'").join(good, "archive", "left_semi")
        .select(F.col("archive").alias("scan_id"), F.col("member").alias("file_path"),
                decode_utf8(F.col("content")).alias("content"), "size")
    )


# P1 -----------------------------------------------------------------------
def base_name(path: Column) -> Column:
    return F.lower(F.try_element_at(F.split(path, "/"), F.lit(-1)))


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot; '' for none, for dot-leading and dot-ending names."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def has_suffix(path: Column, tails: list[str]) -> Column:
    """suffix(path) is one of tails, without taking the path apart."""
    low, out = F.lower(path), F.lit(False)
    for tail in tails:
        out = out | (low.endswith(tail) & ~low.endswith("/" + tail) & (low != tail))
    return out


def is_scannable(path: Column) -> Column:
    return base_name(path).isin(*fv.SCANNABLE_NAMES) | suffix(path).isin(*fv.SCANNABLE_SUFFIXES)

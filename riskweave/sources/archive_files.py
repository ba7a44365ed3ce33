"""Archives that are files: a list first, then a member index, then bodies by ranges, dealt to tasks by bytes.

Folders are listed in tasks, level by level, and the list is a staged table: the driver knows the root alone.
A zip's index is its central directory, a tar's its headers; both are read by seeking, without the bodies.
Members are then packed into parts of about `task_bytes` of the archive, and every part is a task that
opens the archive and reads its own ranges, so an archive of any size is spread and none is held
whole.  A compressed tar has no ranges: it is one part, read once as a stream, member by member.
"""

from __future__ import annotations

import os
import stat
import tarfile
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskweave.session import stage
from riskweave.sources.corpus import ArchiveLimits

TASK_BYTES = 128 << 20
LISTED = "path string, folder boolean"
INDEX = "path string, archive string, ordinal int, member string, size bigint, kind string, stored bigint, at bigint, ranges boolean"
MEMBERS = "archive string, ordinal int, member string, size bigint, kind string, content binary"
BROKEN = (zipfile.BadZipFile, tarfile.TarError, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError)
HELD = 16 << 20


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and inner path of a place as Spark names it; s3a addresses are S3's."""
    scheme, colon, rest = path.partition(":")
    if not colon:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }:{rest}")


def _stream(path: str) -> pa.NativeFile:
    system, inside = locate(path)
    return system.open_input_file(inside)


def _form(name: str) -> str:
    low = name.lower()
    return "zip" if low.endswith(".zip") else "tar" if low.endswith(".tar") else "gz" if low.endswith((".tar.gz", ".tgz", ".gz")) else ""


def _zip_kind(info: zipfile.ZipInfo) -> str:
    return "link" if stat.S_ISLNK(info.external_attr >> 16) else "dir" if info.is_dir() else "file"


def _tar_kind(info: tarfile.TarInfo) -> str:
    return "link" if info.issym() or info.islnk() else "device" if info.isdev() else "dir" if info.isdir() else "file"


def _entries(path: str, name: str) -> Iterator[tuple]:
    """(ordinal, member, size, kind, bytes in the archive, place, whether it can be read by range); damaged archives end with 'corrupt'."""
    form, i = _form(name), 0
    if not form:
        yield 0, "", 0, "unsupported", 0, 0, False
        return
    try:
        with _stream(path) as file:
            if form == "zip":
                with zipfile.ZipFile(file) as zf:
                    for i, info in enumerate(zf.infolist(), 1):
                        yield i, info.filename, info.file_size, _zip_kind(info), info.compress_size, info.header_offset, True
            else:
                with tarfile.open(fileobj=file, mode="r:" if form == "tar" else "r|gz") as tf:
                    for i, info in enumerate(tf, 1):
                        yield i, info.name, info.size, _tar_kind(info), info.size, info.offset_data, form == "tar"
    except BROKEN:
        yield i + 1, "", 0, "corrupt", 0, 0, False


def _index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in INDEX.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    for batch in batches:
        for path in batch.column("path").to_pylist():
            name = path.rsplit("/", 1)[-1]
            rows = []
            for entry in _entries(path, name):
                rows.append((path, name, *entry))
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _shown(name: str) -> bool:
    """Names that Spark's file sources read; the others are work in progress or metadata."""
    return not (name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name)


def _entries_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in every folder: files with a byte at least, and folders."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, inside = locate(path)
            before = path.rstrip("/").removesuffix(inside.rstrip("/"))                # the scheme, and the host where the place has one
            infos = [i for i in system.get_file_info(fs.FileSelector(inside)) if _shown(i.base_name) and (i.type == fs.FileType.Directory or i.type == fs.FileType.File and i.size)]
            for at in range(0, len(infos), 10_000):
                some = infos[at:at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([before + i.path for i in some], pa.string()), pa.array([i.type == fs.FileType.Directory for i in some], pa.bool_())], ["path", "folder"])


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path of every file below root; a folder is listed by one task, and a level of folders is one staged table."""
    if ":" not in root:
        root = f"file:{os.path.abspath(root)}"
    system, inside = locate(root)
    tasks = max(1, spark.sparkContext.defaultParallelism)
    level = spark.range(1, numPartitions=1).select(F.lit(root).alias("path"), F.lit(True).alias("folder"))
    if system.get_file_info(inside).type == fs.FileType.File:
        return level.select("path")
    found = None
    while True:
        level = stage(level.where("folder").select("path").repartition(tasks).mapInArrow(_entries_of, LISTED), "listing")
        files = level.where("not folder").select("path")
        found = files if found is None else found.unionByName(files)
        if level.where("folder").isEmpty():
            return found


def archive_index(spark: SparkSession, root: str) -> DataFrame:
    """One row a member of every archive below root, without bodies."""
    return listing(spark, root).repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(_index, INDEX)


def parts(index: DataFrame, limits: ArchiveLimits = ArchiveLimits(), task_bytes: int = TASK_BYTES) -> DataFrame:
    """The index with part (which task reads a body) and wanted (whether the archive is still inside its limits there)."""
    before = Window.partitionBy("path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    seen = index.withColumns({"_total": F.sum("size").over(before), "_stored": F.sum("stored").over(before)})
    wanted = (F.col("kind") == "file") & (F.col("_total") <= limits.max_bytes) & (F.col("ordinal") <= limits.max_files)
    part = F.when(F.col("ranges"), F.floor((F.col("_stored") - F.col("stored")) / task_bytes)).otherwise(0).cast("int")
    return seen.withColumns({"part": part, "wanted": wanted}).drop("_total", "_stored")


def _bodies(path: str, rows: list[dict]) -> Iterator[tuple[dict, bytes | None]]:
    """Bodies of the wanted rows of one part; a member that cannot be read has kind 'corrupt'."""
    form = _form(rows[0]["archive"])
    if not any(r["wanted"] for r in rows):
        yield from ((r, None) for r in rows)
        return
    with _stream(path) as file:
        if form == "zip":
            with zipfile.ZipFile(file) as zf:
                listed = zf.infolist()
                for r in rows:
                    try:
                        yield r, zf.read(listed[r["ordinal"] - 1]) if r["wanted"] else None
                    except BROKEN:
                        yield r | {"kind": "corrupt"}, None
        elif form == "tar":
            for r in rows:
                if r["wanted"]:
                    file.seek(r["at"])
                body = file.read(r["size"]) if r["wanted"] else None
                yield (r, body) if body is None or len(body) == r["size"] else (r | {"kind": "corrupt"}, None)
        else:
            with tarfile.open(fileobj=file, mode="r|gz") as tf:
                entries = iter(tf)
                for r in rows:
                    try:
                        info = next(entries, None) if r["kind"] != "corrupt" else None
                        yield r, tf.extractfile(info).read() if r["wanted"] and info is not None else None
                    except BROKEN:
                        yield r | {"kind": "corrupt"}, None


def _read(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by path, part and ordinal."""
    types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    held: list[dict] = []

    def out() -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for r, body in _bodies(held[0]["path"], held):
            rows.append((r["archive"], r["ordinal"], r["member"], r["size"], r["kind"], body))
            size += len(body or b"")
            if size > HELD or len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        for r in batch.to_pylist():
            if held and (r["path"], r["part"]) != (held[0]["path"], held[0]["part"]):
                yield from out()
                held = []
            held.append(r)
    if held:
        yield from out()


def expand_archive_files(spark: SparkSession, root: str, limits: ArchiveLimits = ArchiveLimits(), task_bytes: int = TASK_BYTES) -> DataFrame:
    """Members of every archive below root, as `corpus.expand_archives` gives them for bodies at hand.

    archive is the file's name.  Bodies beyond the limits are null; a damaged archive, or a damaged member,
    has a row of kind 'corrupt'; other files one of kind 'unsupported'.  Files without a byte are left out, as Spark's file sources do.
    """
    dealt = parts(archive_index(spark, root), limits, task_bytes)
    names = [c.split()[0] for c in MEMBERS.split(", ")]
    return dealt.repartition("path", "part").sortWithinPartitions("path", "part", "ordinal").mapInArrow(partial(_read, names=names), MEMBERS)

"""Source trees as a Spark data source: `spark.read.format("source_tree").load(root)`.

Rows are scan_id, file_path, content, size; the first folder below root names the scan.  Folders are
listed side by side by a pool of threads; path conditions that Spark pushes down (equal, in, begins, ends)
drop files before any body is opened, and the rest is packed into partitions of about `partition_bytes`.
A file that holds more is a partition of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from riskweave.sources.archive_files import locate

NAME = "source_tree"
SCHEMA = "scan_id string, file_path string, content string, size bigint"
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
THREADS = 16


@dataclass(frozen=True)
class Files(InputPartition):
    """(scan, path in the scan, place, size) of the files that one task reads."""

    files: tuple[tuple[str, str, str, int], ...]

    def __init__(self, files):
        object.__setattr__(self, "files", tuple(files))


def holds(condition: Filter, scan: str, path: str) -> bool | None:
    """Whether a file meets a pushed condition; None where the condition is not about its path."""
    kinds = (EqualTo, In, StringStartsWith, StringEndsWith)
    if not isinstance(condition, kinds) or condition.attribute not in (("scan_id",), ("file_path",)):
        return None
    value = scan if condition.attribute == ("scan_id",) else path
    if isinstance(condition, EqualTo):
        return value == condition.value
    if isinstance(condition, In):
        return value in condition.value
    return value.startswith(condition.value) if isinstance(condition, StringStartsWith) else value.endswith(condition.value)


def listing(root: str, threads: int = THREADS) -> list[tuple[str, str, str, int]]:
    """Every file below root; one folder is one request, and many are under way at a time."""
    system, base = locate(root.rstrip("/"))
    found, ahead = [], [base]

    def one(folder: str) -> list[fs.FileInfo]:
        return system.get_file_info(fs.FileSelector(folder))

    with ThreadPoolExecutor(threads) as pool:
        while ahead:
            infos = [i for part in pool.map(one, ahead) for i in part]
            ahead = [i.path for i in infos if i.type == fs.FileType.Directory]
            for i in infos:
                inside = i.path[len(base):].lstrip("/")
                if i.type == fs.FileType.File and "/" in inside and not i.base_name.startswith((".", "_")):
                    scan, _, path = inside.partition("/")
                    found.append((scan, path, i.path, i.size))
    return sorted(found)


class TreeReader(DataSourceReader):
    def __init__(self, root: str, partition_bytes: int):
        self.root, self.partition_bytes = root, partition_bytes
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if holds(f, "", "") is None:
                yield f                                 # Spark applies it itself
            else:
                self.pushed.append(f)

    def partitions(self) -> list[Files]:
        kept = [f for f in listing(self.root) if all(holds(p, f[0], f[1]) for p in self.pushed)]
        out, held, size = [], [], 0
        for f in kept:
            if held and size + f[3] > self.partition_bytes:
                out.append(Files(held))
                held, size = [], 0
            held.append(f)
            size += f[3]
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = locate(self.root)
        rows, held = [], 0

        def out() -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["scan_id", "file_path", "content", "size"])

        for scan, path, place, size in partition.files:
            with system.open_input_file(place) as file:
                text = file.read().decode("utf-8", "ignore").replace("�", "")
            rows.append((scan, path, text, size))
            held += len(text)
            if held > BATCH_BYTES:
                yield out()
                rows, held = [], 0
        if rows:
            yield out()


class TreeSource(DataSource):
    """Option partition_bytes: bytes of files in one task."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], int(self.options.get("partition_bytes", PARTITION_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with conditions pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)

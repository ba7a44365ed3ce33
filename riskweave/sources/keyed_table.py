"""Tables that are replaced key by key, with commits that lose nothing.

A table is a list of layers, named by a manifest.  A layer holds the rows of the keys that one write
replaced and, beside them, the keys themselves, both filed by bucket (hash of the key).  Writing
touches no file that a reader may use: files first, then one new manifest, numbered one higher, that
must not exist yet.  Who comes second reads the newer manifest and adds the layer to that, so writers
of the same bucket lose nothing; of two writes of one key the later commit holds.  A write that
dies leaves files that no manifest names.

A key's rows are those of the newest layer that names it, so a write costs what it writes, whatever
the table's size.  `compact` merges the layers; layers committed meanwhile stay on top.  The number of
buckets and the key belong to the table and are kept in its manifest.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BUCKETS = 64
RETRIES = 50


class Conflict(RuntimeError):
    """Others kept committing first."""


@dataclass(frozen=True)
class Manifest:
    version: int
    key: tuple[str, ...]
    buckets: int
    schema: str
    layers: tuple[str, ...]

    def text(self) -> str:
        return json.dumps({"key": self.key, "buckets": self.buckets, "schema": self.schema, "layers": self.layers})

    @staticmethod
    def of(version: int, text: str) -> Manifest:
        m = json.loads(text)
        return Manifest(version, tuple(m["key"]), m["buckets"], m["schema"], tuple(m["layers"]))


class _Folder:
    """Small files of one folder, through the filesystem its address names."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.jvm, self.path = jvm, jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def child(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path)] if self.fs.exists(self.path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.child(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def add(self, name: str, text: str) -> bool:
        """Give the text this name, whole and only if nothing has it; False if something has."""
        draft, final = self.child(f".{uuid.uuid4().hex}.tmp"), self.child(name)
        out = self.fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if self.fs.getUri().getScheme() == "file":        # a local rename would overwrite; a link does not
                os.link(draft.toUri().getPath(), final.toUri().getPath())
                return True
            return not self.fs.exists(final) and bool(self.fs.rename(draft, final))
        except FileExistsError:
            return False
        finally:
            if self.fs.exists(draft):
                self.fs.delete(draft, False)

    def remove(self, name: str) -> None:
        self.fs.delete(self.child(name), True)


def _bucket(key: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


class KeyedTable:
    """A table of rows that belong to keys; key columns must not be null."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.key, self.first_buckets = tuple(key), buckets
        self.log = _Folder(spark, f"{self.path}/_manifests")

    # reading ----------------------------------------------------------------
    def manifest(self) -> Manifest | None:
        """The newest commit; None before the first."""
        names = [n for n in self.log.names() if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return None
        newest = max(names)
        found = Manifest.of(int(newest[:-5]), self.log.read(newest))
        if found.key != self.key:
            raise ValueError(f"{self.path} is kept by {found.key}, not by {self.key}")
        return found

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The rows of all keys, or of the given ones; then only their buckets are opened."""
        now = self.manifest()
        if now is None:
            raise AnalysisException(f"no commit in {self.path}")
        schema = T.StructType.fromJson(json.loads(now.schema))
        pruned = None
        if keys is not None:
            keys = keys.select(*self.key).distinct()
            pruned = [r.b for r in keys.select(_bucket(self.key, now.buckets).alias("b")).distinct().collect()]
        rows = self._rows(now, schema, pruned)
        return rows if keys is None else rows.join(keys, list(self.key), "left_semi")

    def _rows(self, now: Manifest, schema: T.StructType, pruned: list[int] | None) -> DataFrame:
        if not now.layers:
            return self.spark.createDataFrame([], schema)
        rows = self._files(now.layers, 0, "rows", schema, pruned)
        if len(now.layers) == 1:
            return rows.drop("_layer")
        named = T.StructType([f for f in schema.fields if f.name in self.key])
        # the keys of later layers are the short side; Spark broadcasts them where they are small
        later = self._files(now.layers, 1, "keys", named, pruned)
        newest = later.groupBy(*self.key).agg(F.max("_layer").alias("_newest"))
        held = rows.join(newest, list(self.key), "left").where(F.col("_layer") == F.coalesce("_newest", F.col("_layer")))
        return held.select(*schema.fieldNames())

    def _files(self, layers: tuple[str, ...], start: int, kind: str, schema: T.StructType, pruned: list[int] | None) -> DataFrame:
        """Files of the layers from `start` on, with their place in the list."""
        filed = T.StructType([*schema.fields, T.StructField("layer", T.StringType()), T.StructField("bucket", T.IntegerType())])
        place = F.element_at(F.create_map(*[F.lit(x) for i, name in enumerate(layers) for x in (name, i)]), F.col("layer"))
        out = (self.spark.read.schema(filed).option("basePath", f"{self.path}/{kind}")
               .parquet(*[f"{self.path}/{kind}/layer={name}" for name in layers[start:]]))
        if pruned is not None:
            out = out.where(F.col("bucket").isin(pruned))
        return out.withColumn("_layer", place).drop("layer", "bucket")

    # writing ----------------------------------------------------------------
    def replace(self, rows: DataFrame, keys: DataFrame | None = None) -> int:
        """Commit rows as all there is of their keys and of the given ones; keys without rows become empty.

        Gives the version.  The same call again gives the same table.
        """
        now = self.manifest()
        buckets = now.buckets if now else self.first_buckets
        mine = rows.select(*self.key) if keys is None else rows.select(*self.key).unionByName(keys.select(*self.key))
        name = self._write(rows, mine.distinct(), buckets)
        return self._commit(lambda m: replace(m, layers=(*m.layers, name), schema=_wider(m.schema, rows.schema)),
                            Manifest(0, self.key, buckets, rows.schema.json(), ()))

    def _write(self, rows: DataFrame, keys: DataFrame, buckets: int) -> str:
        name = uuid.uuid4().hex
        place = _bucket(self.key, buckets)
        for kind, df in (("rows", rows), ("keys", keys)):
            (df.withColumn("bucket", place).hint("rebalance", "bucket").sortWithinPartitions("bucket", *self.key)
             .write.partitionBy("bucket").parquet(f"{self.path}/{kind}/layer={name}"))
        return name

    def _commit(self, change, first: Manifest) -> int:
        for _ in range(RETRIES):
            now = self.manifest() or first
            following = change(now)
            if following is None:
                return now.version
            if following.buckets != now.buckets:
                raise ValueError("the number of buckets cannot change")
            if self.log.add(f"{now.version + 1:020d}.json", replace(following, version=now.version + 1).text()):
                return now.version + 1
        raise Conflict(f"{RETRIES} commits came first in {self.path}")

    def compact(self, most: int = 1) -> int:
        """Merge the layers into one if there are more than `most`; layers that come meanwhile stay on top."""
        now = self.manifest()
        if now is None or len(now.layers) <= most:
            return now.version if now else 0
        schema = T.StructType.fromJson(json.loads(now.schema))
        merged = self._write(self._rows(now, schema, None), self.spark.createDataFrame([], T.StructType([f for f in schema.fields if f.name in self.key])), now.buckets)

        def change(m: Manifest) -> Manifest | None:
            if m.layers[:len(now.layers)] != now.layers:          # another compaction was faster
                return None
            return replace(m, layers=(merged, *m.layers[len(now.layers):]))
        return self._commit(change, now)

    def vacuum(self) -> list[str]:
        """Remove layers that the newest manifest does not name.  Only while nobody writes or reads an older version."""
        now = self.manifest()
        kept = set(now.layers) if now else set()
        gone = []
        for kind in ("rows", "keys"):
            folder = _Folder(self.spark, f"{self.path}/{kind}")
            for name in folder.names():
                if name.startswith("layer=") and name[6:] not in kept:
                    folder.remove(name)
                    gone.append(name[6:])
        return sorted(set(gone))


def _wider(old: str, new: T.StructType) -> str:
    """Columns of both, the older ones first; a column must keep its type."""
    fields = {f.name: f for f in T.StructType.fromJson(json.loads(old)).fields}
    for f in new.fields:
        if f.name in fields and fields[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        fields.setdefault(f.name, T.StructField(f.name, f.dataType, True))
    return T.StructType(list(fields.values())).json()

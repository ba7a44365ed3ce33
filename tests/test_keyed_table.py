"""Commits of a keyed table: nothing lost, nothing half done."""

import threading

import pytest
from pyspark.sql import functions as F

from riskweave.sources import sinks, tables
from riskweave.sources.keyed_table import KeyedTable


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "scan_id string, id string")


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "scan_id string")


def held(table, *names):
    return sorted(tuple(r) for r in (table.read(*names) if names else table.read()).select("scan_id", "id").collect())


def test_replace_by_key(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["scan_id"], buckets=3)
    with pytest.raises(Exception, match="no commit"):
        t.read()
    t.replace(rows(spark, ("a", "1"), ("a", "2"), ("b", "3")))
    for _ in range(2):                                  # repeated: the same table
        t.replace(rows(spark, ("a", "9")), keys(spark, "a", "c"))
        assert held(t) == [("a", "9"), ("b", "3")]
    t.replace(rows(spark), keys(spark, "b"))
    assert held(t) == [("a", "9")] and held(t, keys(spark, "a", "b")) == [("a", "9")] and held(t, keys(spark, "zz")) == []
    assert t.compact() == 5 and len(t.manifest().layers) == 1 and held(t) == [("a", "9")]
    assert len(t.vacuum()) == 4 and held(t) == [("a", "9")]


def test_two_writers_on_one_bucket_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    KeyedTable(spark, path, ["scan_id"], buckets=1).replace(rows(spark, ("base", "0")))
    # both have read the same manifest when they commit
    gate, failed = threading.Barrier(6), []

    def write(i):
        try:
            t = KeyedTable(spark, path, ["scan_id"], buckets=1)
            seen, first = t.manifest, [True]

            def manifest():
                found = seen()
                if first[0]:
                    first[0] = False
                    gate.wait(60)
                return found
            t._write, written = (lambda r, k, b, w=t._write: w(r, k, b)), t._write
            name = written(rows(spark, (f"s{i}", str(i))), keys(spark, f"s{i}"), 1)
            t._write = lambda *_: name
            t.manifest = manifest
            t.replace(rows(spark, (f"s{i}", str(i))))
        except Exception as e:                          # noqa: BLE001 - shown by the assertion below
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    for th in threads:
        th.start()
    for th in threads:
        th.join()
    t = KeyedTable(spark, path, ["scan_id"], buckets=1)
    assert not failed and t.manifest().version == 7
    assert held(t) == sorted([("base", "0")] + [(f"s{i}", str(i)) for i in range(6)])


def test_a_killed_write_changes_nothing(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["scan_id"], buckets=2)
    t.replace(rows(spark, ("a", "1"), ("b", "2")))
    before = t.manifest()
    t._write(rows(spark, ("a", "half")), keys(spark, "a"), 2)                  # died before its commit
    boom = F.udf(lambda x: 1 // 0)
    with pytest.raises(Exception):
        t.replace(rows(spark, ("b", "x")).withColumn("id", boom("id")))          # died while writing
    t.log.fs.create(t.log.child(".draft.tmp"), False).close()                    # died while committing
    assert t.manifest() == before and held(t) == [("a", "1"), ("b", "2")]
    assert len(t.vacuum()) >= 1 and held(t) == [("a", "1"), ("b", "2")]


def test_a_layer_committed_during_compaction_stays_on_top(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["scan_id"], buckets=2)
    t.replace(rows(spark, ("a", "1"), ("b", "2")))
    t.replace(rows(spark, ("b", "3")))
    write = t._write

    def between(*args):
        name = write(*args)
        t._write = write
        KeyedTable(spark, t.path, ["scan_id"]).replace(rows(spark, ("a", "new")))
        return name
    t._write = between
    t.compact()
    assert len(t.manifest().layers) == 2 and held(t) == [("a", "new"), ("b", "3")]


def test_buckets_key_and_columns_belong_to_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    KeyedTable(spark, path, ["scan_id"], buckets=3).replace(rows(spark, ("a", "1"), ("b", "2")))
    KeyedTable(spark, path, ["scan_id"], buckets=7).replace(rows(spark, ("a", "2")).withColumn("extra", F.lit(1)))
    t = KeyedTable(spark, path, ["scan_id"])
    assert t.manifest().buckets == 3 and sorted(map(tuple, t.read().collect())) == [("a", "2", 1), ("b", "2", None)]
    with pytest.raises(ValueError, match="kept by"):
        KeyedTable(spark, path, ["id"]).read()
    with pytest.raises(ValueError, match="column id"):
        t.replace(rows(spark, ("a", "1")).withColumn("id", F.lit(3)))


def test_only_the_buckets_of_the_asked_keys_are_opened(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["scan_id"], buckets=16)
    t.replace(rows(spark, *[(f"s{i}", str(i)) for i in range(200)]))
    files = t.read(keys(spark, "s7")).select("*", F.input_file_name().alias("file"))
    assert len(files.collect()) == 1
    plan = t.read(keys(spark, "s7"))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:120]


def test_an_unreadable_table_is_no_first_write(spark, tmp_path):
    """A damaged file must not be taken for an empty table."""
    path = tmp_path / "findings"
    sinks.write_findings(rows(spark, ("a", "1"), ("b", "2")), keys(spark, "a", "b"), str(path), buckets=1)
    for f in path.glob("rows/*/*/*.parquet"):
        f.write_bytes(b"damaged")
    sinks.write_findings(rows(spark, ("a", "3")), keys(spark, "a"), str(path), buckets=1)
    with pytest.raises(Exception):
        tables.table(spark, str(tmp_path), "findings").collect()

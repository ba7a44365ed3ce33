"""The tree as a data source: whole, packed by bytes, pruned by path."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringEndsWith, StringStartsWith

from riskweave.sources import tree_source as ts


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for scan in ("s1", "s2", "s3"):
        for i in range(12):
            file = base / scan / "src dir" / f"d{i % 3}" / f"f{i}.{'py' if i % 2 else 'js'}"
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_bytes(f"{scan} {i} ü ".encode() * 100 + b"\xff\xfe")
        (base / scan / "package.json").write_text("{}")
        (base / scan / "empty.py").write_bytes(b"")
    (base / "loose.txt").write_text("in no scan")
    (base / "s1" / ".hidden").write_text("not listed")
    return base


def test_every_file_is_read(spark, root):
    ts.register(spark)
    got = {(r.scan_id, r.file_path): (r.content, r.size) for r in spark.read.format(ts.NAME).load(str(root)).collect()}
    want = {(f.relative_to(root).parts[0], "/".join(f.relative_to(root).parts[1:])): (f.read_bytes().decode("utf-8", "ignore"), f.stat().st_size)
            for f in root.rglob("*") if f.is_file() and f.name not in ("loose.txt", ".hidden")}
    assert got == want and len(got) == 42


def test_partitions_follow_bytes(root):
    parts = ts.TreeReader(str(root), 3500).partitions()
    assert len(parts) >= 9 and all(len(p.files) == 1 or sum(f[3] for f in p.files) <= 3500 for p in parts)
    assert sum(len(p.files) for p in parts) == 42
    assert len(ts.TreeReader(f"file:{root}", 1 << 30).partitions()) == 1


def test_paths_prune_before_bodies_are_opened(spark, root, monkeypatch):
    reader = ts.TreeReader(str(root), 1 << 20)
    other = EqualTo(("size",), 3)
    assert list(reader.pushFilters([StringEndsWith(("file_path",), ".json"), In(("scan_id",), ("s1", "s2")), StringStartsWith(("file_path",), "pack"), other])) == [other]
    (part,) = reader.partitions()
    assert [f[:2] for f in part.files] == [("s1", "package.json"), ("s2", "package.json")]
    # bodies of other files cannot be read at all, and nobody asks for them
    for f in root.rglob("*.js"):
        f.chmod(0)
    tree = spark.read.format(ts.NAME).load(str(root)).where(F.col("file_path").endswith("package.json") & (F.col("scan_id") == "s3"))
    assert [(r.scan_id, r.file_path, r.content) for r in tree.collect()] == [("s3", "package.json", "{}")]
    assert "src dir" not in str(tree.inputFiles())

"""Archives read from files by index and ranges."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from riskweave.sources import archive_files as af, corpus as co


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("archives")
    (root / "deep").mkdir()
    with zipfile.ZipFile(root / "deep" / "many.zip", "w") as zf:                     # stored, so bytes are bytes
        for i in range(40):
            zf.writestr(f"src/f{i}.py", bytes([65 + i % 26]) * 50_000)
        link = zipfile.ZipInfo("a-link")
        link.external_attr = 0o120777 << 16
        zf.writestr(link, "target")
        zf.writestr("src/empty/", "")
    for name, mode in (("plain.tar", "w"), ("packed.tar.gz", "w:gz"), ("short.tgz", "w:gz")):
        with tarfile.open(root / name, mode) as tf:
            for i in range(12):
                info = tarfile.TarInfo(f"t/{i}.txt")
                info.size = 30_000
                tf.addfile(info, io.BytesIO(bytes([97 + i]) * 30_000))
            link = tarfile.TarInfo("t/link")
            link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
            tf.addfile(link)
    for name in ("cut.zip", "cut.tar.gz"):
        whole = (root / ("deep/many.zip" if name == "cut.zip" else "packed.tar.gz")).read_bytes()
        (root / name).write_bytes(whole[:len(whole) // 2])
    (root / "note.rar").write_bytes(b"none")
    return root


def rows(df):
    return sorted((r.archive, r.ordinal, r.member, r["size"], r.kind, None if r.content is None else bytes(r.content)) for r in df.collect())


def test_equals_the_expansion_of_bodies(spark, folder):
    names = ["many.zip", "packed.tar.gz", "short.tgz", "cut.zip", "note.rar"]
    bodies = spark.createDataFrame([(p.name, bytearray(p.read_bytes())) for p in folder.rglob("*") if p.name in names], "archive string, body binary")
    for limits in (co.ArchiveLimits(), co.ArchiveLimits(400_000, 9)):
        got = rows(af.expand_archive_files(spark, str(folder), limits, task_bytes=200_000).where(F.col("archive").isin(names)))
        want = rows(co.expand_archives(bodies, limits))
        assert [r[:5] for r in got] == [r[:5] for r in want] and len(got) > 60
        assert got == want


def test_tars_by_ranges_and_damaged_ones(spark, folder):
    got = rows(af.expand_archive_files(spark, str(folder), task_bytes=100_000))
    plain = [r for r in got if r[0] == "plain.tar"]
    assert [(m, s, k, b) for _, _, m, s, k, b in plain] == [(f"t/{i}.txt", 30_000, "file", bytes([97 + i]) * 30_000) for i in range(12)] + [("t/link", 0, "link", None)]
    cut = [r for r in got if r[0] == "cut.tar.gz"]
    assert cut[-1][4] == "corrupt" and all(b == bytes([97 + o - 1]) * 30_000 for _, o, _, _, k, b in cut if k == "file" and b is not None)
    verdicts = {r.archive: r.accepted for r in co.archive_verdicts(af.expand_archive_files(spark, str(folder)).drop("content")).collect()}
    assert not any(verdicts[n] for n in ("cut.zip", "cut.tar.gz", "note.rar", "many.zip", "plain.tar"))     # links are refused too


def test_parts_follow_bytes_and_no_body_is_read_for_the_index(spark, folder, monkeypatch):
    index = af.archive_index(spark, str(folder)).where("archive = 'many.zip'")
    dealt = {r.part: r.n for r in af.parts(index, task_bytes=200_000).groupBy("part").agg(F.sum("stored").alias("n")).collect()}
    assert len(dealt) == 11 and max(dealt.values()) <= 250_000
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_files_are_listed_in_tasks_as_spark_lists_them(spark, tmp_path, monkeypatch):
    for name in ("a.zip", "1:b %20.zip", "_x/in.zip", "_k=1/in.zip", ".h/in.zip", "d/e/_metadata", "d/e/f/g.tar", "d/.hid.zip", "d/_tmp.zip", "d/c._COPYING_", "d/empty.zip"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else b"x")
    want = sorted(r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path").collect())
    assert len(want) == 4
    # nothing is listed by the driver, which asks for the root alone
    asked = []
    place = af.locate
    monkeypatch.setattr(af, "locate", lambda path: asked.append(path) or place(path))
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        found = af.listing(spark, root)
        assert sorted("file:/" + r.path.split(":", 1)[1].lstrip("/") for r in found.collect()) == want
        assert not any("x.zip" in f or str(tmp_path) in f for f in found.inputFiles())
    assert len(asked) == 3
    assert [r.path for r in af.listing(spark, f"{tmp_path}/a.zip").collect()] == [f"file:{tmp_path}/a.zip"]
    (tmp_path / "none").mkdir()
    assert af.listing(spark, f"{tmp_path}/none").count() == 0 and af.archive_index(spark, f"{tmp_path}/d/e").count() == 1
    with pytest.raises(Exception):
        af.listing(spark, f"{tmp_path}/gone").count()

"""Facts of a tree: kinds, identity, links, issues and evidence of paths."""

import os

import pytest
from pyspark.sql import functions as F

from lakesift.operators import dedup
from lakesift.sources import entries


@pytest.fixture
def root(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    (tmp_path / "top.txt").write_bytes(b"same")
    (tmp_path / "a" / "b" / "copy.txt").write_bytes(b"same")
    os.link(tmp_path / "top.txt", tmp_path / "a" / "hard.txt")
    os.symlink(tmp_path / "a", tmp_path / "loop")
    os.symlink(tmp_path / "nowhere", tmp_path / "a" / "dangling")
    os.mkfifo(tmp_path / "a" / "pipe")
    (tmp_path / "a" / os.fsdecode(b"bad\xff.txt")).write_bytes(b"")
    return str(tmp_path)


def test_entries(spark, root):
    found = entries.entries(spark, [root])
    rows = {os.path.relpath(os.fsdecode(bytes(r.raw_path)), root): r for r in found.collect()}
    assert {k: r.entry_kind for k, r in rows.items()} == {
        "a": "directory", "a/b": "directory", "empty": "directory", "top.txt": "file", "a/b/copy.txt": "file", "a/hard.txt": "file",
        "loop": "symlink", "a/dangling": "symlink", "a/pipe": "other", os.fsdecode(b"a/bad\xff.txt"): "file",
    }
    s = os.lstat(f"{root}/top.txt")
    r = rows["top.txt"]
    assert (r.size, r.allocated, r.modified_s * 10**9 + r.modified_ns, r.device, r.inode, r.links, r.mode) == (4, s.st_blocks * 512, s.st_mtime_ns, s.st_dev, s.st_ino, 2, s.st_mode)
    assert rows["a/hard.txt"].inode == r.inode and "�" in rows[os.fsdecode(b"a/bad\xff.txt")].path
    assert found.filter(~entries.entry_kind(F.col("mode")).eqNullSafe(F.col("entry_kind"))).count() == 0
    good, issues = entries.regular_files(found)
    assert good.count() == 4 and sorted(x.code for x in issues.collect()) == ["symlink_skipped", "symlink_skipped", "unsupported_file_type"]


def test_hard_links_are_one_object(spark, root):
    good, _ = entries.regular_files(entries.entries(spark, [root]))
    content = spark.createDataFrame([(f"{root}/{p}", b"same") for p in ("top.txt", "a/hard.txt", "a/b/copy.txt")], "path string, content binary")
    files = good.join(content, "path").withColumn("file_id", F.col("path")).withColumn("object_key", entries.object_key(F.col("device"), F.col("inode")))
    g = dedup.group_measures(dedup.verified_members(files)).collect()
    assert [(r.files, r.independent, r.reclaimable) for r in g] == [(3, 2, 4)]


def test_roots(spark, root):
    for bad in (f"{root}/loop", f"{root}/top.txt", f"{root}/nowhere"):
        with pytest.raises(NotADirectoryError):
            entries.entries(spark, [bad])
    assert entries.entries(spark, [f"{root}/empty"]).count() == 0
    both = entries.entries(spark, [root, f"{root}/a"])
    assert both.count() == 16 and entries.first_of_path(both, "root").count() == 10


def test_path_evidence(spark):
    cases = [("a/b", b"a/b", None), ("a", b"b", "display_differs"), (None, b"a", "display_differs"), ("", b"", "empty"), ("a", None, "empty"), ("/a", b"/a", "absolute"), ("a/../b", b"a/../b", "traversal"), ("a//b", b"a//b", "traversal"),
             ("a\0b", b"a\0b", "nul"), ("a�", b"a\xff", "display_differs"), ("...", b"...", None)]
    df = spark.createDataFrame([(d, None if r is None else bytearray(r), e) for d, r, e in cases], "d string, r binary, e string")
    assert df.filter(~entries.path_evidence(F.col("d"), F.col("r")).eqNullSafe(F.col("e"))).collect() == []

"""Entries of a directory tree with the facts that the file system keeps about them.

``binaryFile`` gives path, time and length only. This source lists directories itself, so the tree must be mounted under
the same path on every executor; object stores have no such facts.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = """root string, path string, raw_path binary, entry_kind string, size bigint, allocated bigint, modified_s bigint, modified_ns int,
  changed_s bigint, changed_ns int, device bigint, inode bigint, links bigint, mode int, issue string"""

#: File type bits of a mode (octal 170000) and the kinds that are told apart.
TYPE_BITS, KINDS = 0o170000, {0o120000: "symlink", 0o040000: "directory", 0o100000: "file"}


class _Part(InputPartition):
    """One directory; with ``deep``, all that is below it too."""

    def __init__(self, root: bytes, directory: bytes, deep: bool):
        self.root, self.directory, self.deep = root, directory, deep


def _row(root: bytes, path: bytes, issue: str | None = None) -> tuple:
    """The entry itself is looked at, never what a link points to; what can't be looked at becomes an issue."""
    name = path.decode("utf-8", "replace")
    try:
        s = os.lstat(path)
    except OSError:
        return (root.decode("utf-8", "replace"), name, path, *[None] * 11, "unreadable_entry")
    kind = KINDS.get(stat.S_IFMT(s.st_mode), "other")
    times = [x for ns in (s.st_mtime_ns, s.st_ctime_ns) for x in divmod(ns, 1_000_000_000)]
    return (root.decode("utf-8", "replace"), name, path, kind, s.st_size, s.st_blocks * 512, *times, s.st_dev, s.st_ino, s.st_nlink, s.st_mode, issue)


class EntrySource(DataSource):
    """Format ``file_entries``; option ``roots`` has one root a line."""

    @classmethod
    def name(cls) -> str:
        return "file_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([os.fsencode(r) for r in self.options["roots"].split("\n") if r])


class _Reader(DataSourceReader):
    def __init__(self, roots: list[bytes]):
        self.roots = roots

    def partitions(self) -> list[InputPartition]:
        """The root's own entries, and one part for each directory in it; the driver holds no more than their names."""
        out: list[InputPartition] = []
        for root in self.roots:
            out.append(_Part(root, root, False))
            with os.scandir(root) as found:
                out += [_Part(root, e.path, True) for e in found if e.is_dir(follow_symlinks=False)]
        return out

    def read(self, part: _Part) -> Iterator[tuple]:
        open_ = [part.directory]
        while open_:
            directory = open_.pop()
            try:
                with os.scandir(directory) as found:
                    for e in found:
                        if part.deep and e.is_dir(follow_symlinks=False):
                            open_.append(e.path)
                        yield _row(part.root, e.path)
            except OSError:
                yield _row(part.root, directory, "unreadable_directory")


def entries(spark: SparkSession, roots: list[str]) -> DataFrame:
    """One row for each entry below ``roots`` (existing directories, no links), in no order; links aren't followed.

    A directory that can't be listed has a further row with an issue. A root inside another one gives its entries twice:
    see ``first_of_path``.
    """
    for root in roots:
        if os.path.islink(root) or not os.path.isdir(root):
            raise NotADirectoryError(root)
    spark.dataSource.register(EntrySource)
    return spark.read.format("file_entries").option("roots", "\n".join(sorted(set(roots)))).load()


def entry_kind(mode: Column) -> Column:
    """``symlink``, ``directory``, ``file`` or ``other`` by the type bits of a mode; null without one."""
    kind = F.lit("other")
    for bits, name in KINDS.items():
        kind = F.when(mode.bitwiseAND(F.lit(TYPE_BITS)) == bits, name).otherwise(kind)
    return F.when(mode.isNotNull(), kind)


def regular_files(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regular files, and an issue (``path``, ``code``) for links, special files and what couldn't be read."""
    code = F.coalesce("issue", F.when(F.col("entry_kind") == "symlink", "symlink_skipped").when(F.col("entry_kind") == "other", "unsupported_file_type"))
    return found.filter("entry_kind = 'file' AND issue IS NULL"), found.select("path", code.alias("code")).filter("code IS NOT NULL")


def first_of_path(found: DataFrame, *order: str) -> DataFrame:
    """Each path once: the row that comes first by ``order``. The rest of a row goes along in the aggregate, so a path with many rows is summed up before the shuffle."""
    rest = F.struct(*(F.col(c) for c in found.columns))
    return found.groupBy("path").agg(F.min_by(rest, F.struct(*order)).alias("__row")).select("__row.*")


def object_key(device: Column, inode: Column) -> Column:
    """Identity of a stored object, equal for hard links; null if either part is unknown."""
    return F.concat(device.cast("string"), F.lit(":"), inode.cast("string"))


def source_signature(kind: Column, fields: list[Column]) -> Column:
    """SHA-256 over a tag, the kind and each field; an absent field differs from every value."""
    return F.sha2(F.concat_ws("|", F.lit("source-1"), kind, *(F.coalesce(F.concat(F.lit("="), f.cast("string")), F.lit("-")) for f in fields)), 256)


def path_evidence(display: Column, raw: Column) -> Column:
    """Why a stored relative path can't be trusted: ``empty``, ``nul``, ``absolute``, ``traversal`` or ``display_differs``; null if it can.

    ``raw`` has the path's bytes, ``display`` what they decode to as UTF-8. Components must not be empty, ``.`` or ``..``.
    """
    text = F.try_validate_utf8(raw)
    parts = F.split(text, "/")
    return (
        F.when(raw.isNull() | (F.octet_length(raw) == 0), "empty").when(text.isNull() | ~display.eqNullSafe(text), "display_differs").when(text.contains("\0"), "nul").when(text.startswith("/"), "absolute")
        .when(F.exists(parts, lambda p: p.isin("", ".", "..")), "traversal")
    )

"""Raw time fields of JPEG, TIFF and ISO base media files, read from bytes without trusting their structure.

``extract`` never raises on bad content: a broken part gives an issue and the rest is still read. Every read is counted
against a budget. ``extract_table`` runs it over a column of bytes, one row for each field.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# TIFF tags of times with their kinds, and box types.
TAGS = {0x0132: "modify", 0x9003: "dto", 0x9004: "create", 0x9010: "offset_modify", 0x9011: "offset", 0x9012: "offset_create", 0x9290: "subsec_modify", 0x9291: "subsec", 0x9292: "subsec_create"}
EXIF_POINTER = 0x8769
CREATION_KEY = b"com.apple.quicktime.creationdate"
HOLDERS = (b"moov", b"udta", b"meta", b"trak", b"mdia", b"moof", b"iprp")


class Budget(Exception):
    pass


@dataclass
class Report:
    format: str = "unknown"
    status: str = "no_fields"
    fields: list[dict] = field(default_factory=list)
    issues: list[str] = field(default_factory=list)
    bytes_read: int = 0
    operations: int = 0


class Reader:
    """Positional reads within a range, against limits of bytes, operations and fields that callers may only lower."""

    MOST = (32 * 1024 * 1024, 65536, 4096)

    def __init__(self, data: bytes, report: Report, limits: tuple[int, int, int] = MOST):
        self.data, self.report = data, report
        self.bytes, self.operations, self.fields = (min(a, b) for a, b in zip(limits, self.MOST))

    def at(self, offset: int, length: int, end: int | None = None) -> bytes | None:
        """The bytes, or None (and an issue) beyond the end."""
        self.report.operations += 1
        self.report.bytes_read += max(0, length)
        if self.report.bytes_read > self.bytes or self.report.operations > self.operations:
            raise Budget
        if offset < 0 or length < 0 or offset + length > (len(self.data) if end is None else end):
            self.report.issues.append("out_of_range")
            return None
        return self.data[offset : offset + length]

    def found(self, kind: str, raw: bytes, container: str, **where) -> None:
        if len(self.report.fields) >= self.fields:
            raise Budget
        self.report.fields.append({"kind": kind, "raw": raw, "container": container, **where})


def detect(head: bytes) -> str:
    if head[:2] == b"\xff\xd8":
        return "jpeg"
    if head[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    return "iso-bmff" if head[4:8] in (b"ftyp", b"moov", b"wide", b"free") else "unknown"


def tiff(r: Reader, base: int, end: int, most_directories: int = 64, most_entries: int = 4096) -> None:
    """Walk the directories of a TIFF header at ``base``; pointers that repeat or leave the range give issues."""
    head = r.at(base, 8, end)
    if head is None or head[:4] not in (b"II*\0", b"MM\0*"):
        r.report.issues.append("bad_header")
        return
    order = "<" if head[:2] == b"II" else ">"
    todo, seen = [struct.unpack(order + "I", head[4:])[0]], set()
    while todo:
        offset = todo.pop()
        if offset == 0:
            continue
        if offset in seen or len(seen) >= most_directories:
            r.report.issues.append("directory_cycle" if offset in seen else "too_many_directories")
            continue
        seen.add(offset)
        count = r.at(base + offset, 2, end)
        if count is None:
            continue
        n = struct.unpack(order + "H", count)[0]
        if n > most_entries:
            r.report.issues.append("too_many_entries")
            continue
        for k in range(n):
            where = offset + 2 + 12 * k
            entry = r.at(base + where, 12, end)
            if entry is None:
                break
            tag, kind, size, value = struct.unpack(order + "HHII", entry)
            if tag == EXIF_POINTER:
                todo.append(value)
            elif tag in TAGS:
                if kind != 2:
                    r.report.issues.append("field_type")
                    continue
                raw = r.at(base + where + 8, size, end) if size <= 4 else r.at(base + value, size, end)
                if raw is not None:
                    r.found(TAGS[tag], raw, "tiff", header_offset=base, ifd_offset=offset, tag=tag, offset=base + (where + 8 if size <= 4 else value), length=size)
        following = r.at(base + offset + 2 + 12 * n, 4, end)
        if following is not None:
            todo.append(struct.unpack(order + "I", following)[0])


def jpeg(r: Reader) -> None:
    """Segments up to the scan; each Exif APP1 holds a TIFF."""
    at, end = 2, len(r.data)
    while at + 4 <= end:
        mark = r.at(at, 4)
        if mark is None or mark[0] != 0xFF:
            r.report.issues.append("bad_marker")
            return
        if mark[1] in (0xD9, 0xDA):
            return
        if mark[1] == 0xFF or 0xD0 <= mark[1] <= 0xD7 or mark[1] == 0x01:
            at += 1 if mark[1] == 0xFF else 2
            continue
        length = struct.unpack(">H", mark[2:])[0]
        if length < 2 or at + 2 + length > end:
            r.report.issues.append("bad_segment")
            return
        if mark[1] == 0xE1 and length >= 8 and r.at(at + 4, 6) == b"Exif\0\0":
            tiff(r, at + 10, at + 2 + length)
        at += 2 + length


def boxes(r: Reader, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start of the content, end) of each box; 32-bit, 64-bit and to-the-end sizes."""
    at = start
    while at + 8 <= end:
        head = r.at(at, 8, end)
        if head is None:
            return
        size, kind = struct.unpack(">I4s", head)
        body = at + 8
        if size == 1:
            large = r.at(body, 8, end)
            if large is None:
                return
            size, body = struct.unpack(">Q", large)[0], body + 8
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            r.report.issues.append("bad_box")
            return
        yield kind, body, at + size
        at += size


def movie(r: Reader, start: int, end: int, path: tuple[bytes, ...] = (), depth: int = 0) -> None:
    if depth > 16:
        r.report.issues.append("too_deep")
        return
    keys: list[bytes] = []
    for kind, body, stop in boxes(r, start, end):
        here = (*path, kind)
        if kind == b"mvhd" and path == (b"moov",):
            version = r.at(body, 1, stop)
            raw = None if version is None else r.at(body + 4, 8 if version == b"\1" else 4, stop)
            if raw is not None and version in (b"\0", b"\1"):
                value = int.from_bytes(raw, "big")
                if value:
                    r.found("mvhd", str(value).encode(), "iso-bmff", box_path=here, offset=body + 4, length=len(raw))
        elif kind == b"keys":
            count = r.at(body + 4, 4, stop)
            at = body + 8
            for _ in range(0 if count is None else struct.unpack(">I", count)[0]):
                head = r.at(at, 8, stop)
                if head is None or (n := struct.unpack(">I", head[:4])[0]) < 8:
                    break
                name = r.at(at + 8, n - 8, stop)
                keys.append(b"" if name is None or head[4:] != b"mdta" else name)
                at += n
        elif kind == b"ilst":
            for item, inner, last in boxes(r, body, stop):
                index = int.from_bytes(item, "big")
                if item == b"\xa9day" or (0 < index <= len(keys) and keys[index - 1] == CREATION_KEY):
                    for part, data, close in boxes(r, inner, last):
                        raw = r.at(data + 8, close - data - 8, close) if part == b"data" else None
                        if raw is not None:
                            r.found("qt_text", raw, "iso-bmff", box_path=(*here, item), offset=data + 8, length=len(raw))
        elif kind == b"\xa9day":
            size = r.at(body, 2, stop)
            raw = None if size is None else r.at(body + 4, struct.unpack(">H", size)[0], stop)
            if raw is not None:
                r.found("qt_text", raw, "iso-bmff", box_path=here, offset=body + 4, length=len(raw))
        elif kind == b"meta" and path == ():
            heif(r, body + 4, stop)
        elif kind in HOLDERS:
            skip = 4 if kind == b"meta" and (r.at(body, 4, stop) or b"")[:4] == b"\0\0\0\0" else 0
            movie(r, body + skip, stop, here, depth + 1)


def heif(r: Reader, start: int, end: int) -> None:
    """The Exif item of a picture: found in iinf, located by iloc in the file (one extent).

    Its fields come with a TIFF container inside an ISO file, which the time policy then holds to be a conflict.
    """
    items, places, picture = set(), {}, False
    for kind, body, stop in boxes(r, start, end):
        if kind == b"hdlr":
            picture = r.at(body + 8, 4, stop) == b"pict"
        elif kind == b"iinf":
            version = r.at(body, 1, stop) or b"\0"
            for part, info, close in boxes(r, body + (6 if version == b"\0" else 8), stop):
                head = r.at(info, 4, close) if part == b"infe" else None
                if head is None or head[0] < 2:  # without an item type
                    continue
                if head[0] > 3:
                    r.report.issues.append("unsupported_version")
                    continue
                wide = 4 if head[0] == 3 else 2
                entry = r.at(info + 4, wide + 6, close)
                if entry is not None and entry[wide + 2 :] == b"Exif":
                    items.add(int.from_bytes(entry[:wide], "big"))
        elif kind == b"iloc":
            head = r.at(body, 8, stop)
            if head is None:
                continue
            if head[0] > 2:
                r.report.issues.append("unsupported_version")
                continue
            sizes = head[4] >> 4, head[4] & 15, head[5] >> 4
            index = head[5] & 15 if head[0] else 0
            wide = 4 if head[0] == 2 else 2  # of item numbers and of their count
            count = r.at(body + 6, wide, stop)
            at = body + 6 + wide
            extra = 2 if head[0] else 0
            for _ in range(0 if count is None else int.from_bytes(count, "big")):
                item = r.at(at, wide + extra + 2 + sizes[2] + 2, stop)
                if item is None:
                    break
                number, extents = int.from_bytes(item[:wide], "big"), struct.unpack(">H", item[-2:])[0]
                base = int.from_bytes(item[wide + extra + 2 : -2], "big")
                construction = item[wide + 1] & 15 if extra else 0
                at += len(item)
                for k in range(extents):
                    extent = r.at(at, index + sizes[0] + sizes[1], stop)
                    if extent is None:
                        break
                    at += len(extent)
                    if k == 0 and extents == 1 and construction == 0:
                        places[number] = (base + int.from_bytes(extent[index : index + sizes[0]], "big"), int.from_bytes(extent[index + sizes[0] :], "big"))
    for number in sorted(items & set(places)) if picture else ():
        offset, length = places[number]
        head = r.at(offset, 4)
        if head is not None:
            tiff(r, offset + 4 + struct.unpack(">I", head)[0], min(len(r.data), offset + length))


def extract(data: bytes | None, limits: tuple[int, int, int] = Reader.MOST) -> Report:
    report = Report()
    if not data:
        return report
    report.format = detect(data[:16])
    r = Reader(data, report, limits)
    try:
        if report.format == "jpeg":
            jpeg(r)
        elif report.format == "tiff":
            tiff(r, 0, len(data))
        elif report.format == "iso-bmff":
            movie(r, 0, len(data))
        else:
            report.status = "unsupported"
            return report
    except Budget:
        report.issues.append("budget")
        report.status = "partial" if report.fields else "failed"
        return report
    report.status = ("partial" if report.issues else "extracted") if report.fields else ("failed" if report.issues else "no_fields")
    return report


_SCHEMA = "id {0}, format string, status string, issues array<string>, bytes_read bigint, kind string, raw binary, container string, box_path array<binary>, tag int, ifd_offset bigint, offset bigint, length bigint"


def extract_table(files: DataFrame, id_column: str, content: str) -> DataFrame:
    """One row for each field, and one with null field columns for a file without any."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, data in zip(batch["id"], batch["content"]):
                report = extract(bytes(data) if data is not None else None)
                for f in report.fields or [{}]:
                    path = f.get("box_path")
                    rows.append((key, report.format, report.status, sorted(set(report.issues)), report.bytes_read, f.get("kind"), f.get("raw"), f.get("container"), None if path is None else list(path), f.get("tag"), f.get("ifd_offset"), f.get("offset"), f.get("length")))
            out = pd.DataFrame(rows, columns=["id", "format", "status", "issues", "bytes_read", "kind", "raw", "container", "box_path", "tag", "ifd_offset", "offset", "length"])
            yield out.astype({c: "Int64" for c in ("tag", "ifd_offset", "offset", "length")})

    return files.select(F.col(id_column).alias("id"), F.col(content).cast("binary").alias("content")).mapInPandas(run, _SCHEMA.format(dict(files.dtypes)[id_column]))

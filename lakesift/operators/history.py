"""The catalogue of finished runs, and their export as ordered records in JSON or CSV."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CSV_HEADER = "schema_version,profile,section,sequence,record_json"
SECTIONS = ("summary", "group", "member", "issue")


def eligible(runs: DataFrame, sealed: DataFrame) -> DataFrame:
    """Completed runs (``run``, ``state``, ``started``, ``finished``, ``coverage``) with complete or partial coverage, both times, and an exact seal."""
    ok = (F.col("state") == "completed") & F.col("coverage").isin("complete", "partial") & F.col("started").isNotNull() & F.col("finished").isNotNull()
    return runs.filter(ok).join(sealed.select("run"), "run", "left_semi").withColumn("duration", F.col("finished") - F.col("started"))


def valid_row() -> Column:
    """The rules of a history row: times in order, no negative count, parts not above wholes."""
    counts = F.least("groups", "members", "redundant", "issues", "unresolved") >= 0
    return (F.col("duration") >= 0) & counts & (F.col("unresolved") <= F.col("issues")) & (F.col("redundant") <= F.col("members"))


def records(parts: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """``section``, ``k`` (sort key) and ``record`` (JSON, integers as text) of all sections.

    Their order is that of ``SECTIONS``, then of the keys given for each.
    """
    out = None
    for n, section in enumerate(SECTIONS):
        df = parts[section]
        fields = [F.col(c).cast("string").alias(c) for c in df.columns]
        key = F.concat_ws("/", *(F.lpad(F.col(c).cast("string"), 20, "0") for c in keys[section])) if keys[section] else F.lit("")
        part = df.select(F.lit(n).alias("rank"), F.lit(section).alias("section"), key.alias("k"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))
        out = part if out is None else out.union(part)
    return out


def ordered(rows: DataFrame) -> Iterator[tuple[str, str]]:
    """Sections and records in order, a partition at a time."""
    return ((r.section, r.record) for r in rows.orderBy("rank", "k").toLocalIterator())


def logical_digest(rows: Iterator[tuple[str, str]]) -> str:
    """Digest over the records with their lengths, in order; the same for either format."""
    h = hashlib.sha256(b"export-1")
    for section, record in rows:
        for part in (section.encode(), record.encode()):
            h.update(len(part).to_bytes(8, "little") + part)
    return h.hexdigest()


def csv_lines(rows: Iterator[tuple[str, str]], profile: str = "complete") -> Iterator[str]:
    def field(x: str) -> str:
        return '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\r\n') else x

    yield CSV_HEADER + "\r\n"
    for n, (section, record) in enumerate(rows):
        yield ",".join(map(field, ("1", profile, section, str(n), record))) + "\r\n"


def json_document(rows: Iterator[tuple[str, str]], profile: str = "complete") -> Iterator[str]:
    """``{"manifest": ..., "records": [...], "integrity": ...}``, piece by piece."""
    h, n = hashlib.sha256(b"export-1"), 0
    yield json.dumps({"manifest": {"schema_version": "1", "profile": profile}})[:-1] + ',"records":['
    for section, record in rows:
        for part in (section.encode(), record.encode()):
            h.update(len(part).to_bytes(8, "little") + part)
        yield ("," if n else "") + f'{{"section":"{section}","sequence":"{n}","record":{record}}}'
        n += 1
    yield '],"integrity":' + json.dumps({"records": str(n), "digest": h.hexdigest()}) + "}"


def publish(pieces: Iterator[str], path: str, most_bytes: int = 256 * 1024 * 1024, most_records: int = 250_000) -> None:
    """Write to a private file and give it its name only if none has it; nothing is left behind on failure."""
    import os
    import tempfile

    folder = os.path.dirname(os.path.abspath(path))
    handle, private = tempfile.mkstemp(dir=folder)
    try:
        written = 0
        with os.fdopen(handle, "wb") as f:
            for n, piece in enumerate(pieces):
                data = piece.encode()
                written += len(data)
                if written > most_bytes or n > most_records + 2:
                    raise ValueError("export too large")
                f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.link(private, path)
    finally:
        os.unlink(private)

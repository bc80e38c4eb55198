"""Batches of an enumeration, written once each, and throttled progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH_EVENTS, BATCH_BYTES = 128, 1024 * 1024


def append_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch as Parquet under its number, so that a batch that is run again replaces itself; ends when all input is read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunks(events: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """Events with the number of their chunk inside a key: at most 128 events and 1 MiB; a larger event is an error.

    A chunk depends on where the one before ended, so rows of a key are taken in order; a key is a session, not a source.
    """

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        out, n, count, held = [], 0, 0, 0
        for size_ in rows[size]:
            if size_ > BATCH_BYTES:
                raise ValueError("event too large")
            if count == BATCH_EVENTS or held + size_ > BATCH_BYTES:
                n, count, held = n + 1, 0, 0
            count, held = count + 1, held + size_
            out.append(n)
        return rows.assign(chunk=out)

    schema = ", ".join([*(f"`{c}` {t}" for c, t in events.dtypes), "chunk bigint"])
    return events.groupBy(key).applyInPandas(number, schema)


def throttled(progress: DataFrame, key: str = "session", step: int = 256, every_ms: int = 200) -> DataFrame:
    """Progress rows (``seq``, ``stage``, ``completed``, ``at_ms``, ``terminal``) to show: at a new stage, the end, ``step`` items or ``every_ms`` since the last shown."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows, keep, last = rows.sort_values("seq", kind="stable"), [], None
        for r in rows.itertuples():
            show = last is None or r.terminal or r.stage != last.stage or r.completed - last.completed >= step or r.at_ms - last.at_ms >= every_ms
            keep.append(show)
            last = r if show else last
        return rows[keep]

    return progress.groupBy(key).applyInPandas(pick, progress.schema)


def fingerprint_batches(files: DataFrame) -> DataFrame:
    """Digest of each file's content, or an issue if there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            yield pd.DataFrame({"file_id": b["file_id"], "digest": [None if c is None else hashlib.sha256(c).hexdigest() for c in b["content"]], "issue": ["unreadable" if c is None else None for c in b["content"]]})

    return files.select("file_id", F.col("content").cast("binary").alias("content")).mapInPandas(run, f"file_id {dict(files.dtypes)['file_id']}, digest string, issue string")

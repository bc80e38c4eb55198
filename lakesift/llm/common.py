"""Shared storage for intermediate tables, and word hashing, for the corpus operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []
_LOCAL_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and every executor see: ``spark.checkpoint.dir``.

    Where the setting is missing, a local master gets a temporary folder of its own; a cluster gets an
    error, since a machine-local folder would lose data there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="lakesift-"))
        atexit.register(lambda: __import__("shutil").rmtree(_LOCAL_ROOT[0][7:], ignore_errors=True))
    return _LOCAL_ROOT[0]


def store(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/lakesift-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._lakesift_path = path
    return out


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names for columns that clash with none of ``taken``."""
    held = {c.lower() for c in taken}
    out = []
    for name in names:
        while (name := f"__{name}").lower() in held:
            pass
        out.append(name)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, instead of when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: What empties a Python worker's memory for each operator that remembers something between tasks.
REMEMBERED: dict[str, Callable[[], None]] = {}
_LATEST: list[str] = []


def working_on(operator: str) -> None:
    """For the start of a task: a worker forgets what it remembers for other operators, so that its memory is that of one."""
    if _LATEST != [operator]:
        _LATEST[:] = [operator]
        for other, forget in REMEMBERED.items():
            if other != operator:
                forget()
        gc.collect()
        pa.default_memory_pool().release_unused()


FILTER_BITS, FILTER_SLOTS = 23, 128


def membership(ids: DataFrame, name: str) -> np.ndarray:
    """A bitmap of fixed size (1 MB) that has a bit set for the hash of each id; other ids may share bits."""
    width = (1 << FILTER_BITS) // FILTER_SLOTS // 8

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            bits[batch.column(0).to_numpy(zero_copy_only=False)] = True
        if bits.any():
            parts = np.packbits(bits).reshape(FILTER_SLOTS, width)
            some = [k for k in range(FILTER_SLOTS) if parts[k].any()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["slot", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[slot] = held.get(slot, np.zeros(width, np.uint8)) | np.frombuffer(bits, np.uint8)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["slot", "bits"])

    places = ids.select(F.pmod(F.xxhash64(name), F.lit(1 << FILTER_BITS)).alias("place"))
    out = np.zeros((FILTER_SLOTS, width), np.uint8)
    for row in places.mapInArrow(mark, "slot int, bits binary").repartition(16, "slot").mapInArrow(unite, "slot int, bits binary").collect():
        out[row.slot] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def members_only(df: DataFrame, name: str, bitmap: np.ndarray) -> DataFrame:
    """Rows whose id may be in the bitmap, so that the rest needn't be shuffled; a join has the last word."""
    sent = df.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def hit(place: pd.Series) -> pd.Series:
        at = place.to_numpy()
        return pd.Series((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)

    return df.filter(hit(F.pmod(F.xxhash64(name), F.lit(1 << FILTER_BITS))))


def discard(df: DataFrame) -> None:
    """Delete what ``store`` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_lakesift_path", None)
    if path is not None:
        _delete(df.sparkSession, path)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _delete_all() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session may have ended before the interpreter does
            return


atexit.register(_delete_all)


class WordHashes(dict):
    """64-bit hash of each word (bytes), remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_EMPTY = np.empty(0, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit integers over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a text given in UTF-8.

    A-Z is lower-cased and words are runs of other than ASCII white space. With one to four words the
    whole sequence is the only shingle; a text without words, or null, has none.
    """
    if not text:
        return _EMPTY
    words = text.lower().split()
    if len(words) < 5:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64) if words else _EMPTY
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(w) - 4
    h = w[:n] * _FACTORS[0]
    for k in range(1, 5):
        h += w[k : n + k] * _FACTORS[k]
    h = mix(h)
    h.sort()
    keep = np.empty(n, dtype=bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]

"""Training in one task on rows of bounded number, and scoring of all rows, for the classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm.bpe import slices
from lakesift.llm.common import discard, store

Features = tuple[np.ndarray, np.ndarray]  # sorted bucket numbers, values


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in no fold."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)).cast("int")


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, most_terms: int, features: Callable[[bytes | None], Features], fit: Callable[[list[Features], np.ndarray], object], text: str = "text") -> object:
    """What ``fit`` makes of the features and labels of a bounded number of labelled rows, in a fixed order.

    Of either class the rows with the least hash of doc_id are taken, at most ``per_class`` of them, and of these those
    whose features together number ``most_terms`` at most. They are chosen from the labels and the features' numbers, so the
    documents are read once and joined with a table of bounded size. Features are stored; one task reads them and trains,
    so its memory is bounded whatever the texts' lengths, and the model alone, of fixed size, reaches the driver.
    Rows with a null id, label or text are left out, and so are labels other than 0 and 1.
    """
    chosen = None
    for value in (0, 1):
        some = labels.filter((F.col(label) == value) & learn & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
        some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.union(some)
    # Broadcast: 2 * per_class rows of an id and a label at most.
    rows = docs.select("doc_id", F.col(f"`{text}`").cast("string").cast("binary").alias("__text")).filter("__text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    schema = "h bigint, y int, n bigint, i binary, x binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                found = [features(t) for t in part.column(2).to_pylist()]
                columns = [pa.array([len(a) + 1 for a, _ in found], pa.int64()), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([b.astype("<f4").tobytes() for _, b in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], schema.replace(",", "").split()[::2])

    def learn_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(4)))]
        held.sort(key=lambda r: (r[0], r[1], r[2]))
        model = fit([(np.frombuffer(i, "<i4"), np.frombuffer(x, "<f4")) for _, _, i, x in held], np.array([r[1] for r in held], dtype=np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = store(rows.select(F.xxhash64("doc_id").alias("h"), "y", "__text").mapInArrow(run, schema))
    before = Window.partitionBy("y").orderBy("h").rangeBetween(Window.unboundedPreceding, 0)
    within = store(made.select("h", "y", "n").withColumn("sum", F.sum("n").over(before)).filter(F.col("sum") <= most_terms).select("h", "y").distinct(), 1)
    got = made.join(F.broadcast(within), ["h", "y"], "left_semi").select("h", "y", "i", "x").coalesce(1).mapInArrow(learn_all, "model binary").first()
    discard(made)
    discard(within)
    return fit([], np.empty(0)) if got is None else pickle.loads(bytes(got.model))


def score_documents(docs: DataFrame, model: object, score: Callable[[object, bytes | None], float], *, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``score`` and ``predicted`` (1 from 0.5 on) for every row; the model has a fixed size and is broadcast."""
    sent, types = docs.sparkSession.sparkContext.broadcast(model), dict(docs.dtypes)
    names = [c for c in keep if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                s = np.array([score(sent.value, t) for t in part.column(part.num_columns - 1).to_pylist()], dtype=np.float64)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), "score double", "predicted int"])
    return docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`").cast("string").cast("binary").alias("__text")).mapInArrow(run, schema)


def logistic(z: float) -> float:
    return 1 / (1 + np.exp(-min(35.0, max(-35.0, z))))

"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.bpe import slices
from lakesift.llm.common import REMEMBERED, WordHashes, mix, shingles, working_on

FILTER_BITS = 20
MOST_FUNCTIONS = 256  # beyond these, candidates of a partition come from the inverted index
MISS = 1e-6  # most that the functions of a partition may miss of true pairs
_HASHES = WordHashes()
_WORKER: dict[str, "Index"] = {}


def functions_needed(most: int, least_item: int) -> int:
    """MinHash functions for documents of up to ``most`` shingles and items of ``least_item`` or more.

    A contained item has at least 0.8 of its q shingles among them, so the Jaccard similarity is at least
    0.8 q / (most + 0.2 q); with k functions, all miss with probability (1 - that)^k. 0: nothing can match.
    """
    if 10 * most < 8 * least_item:
        return 0
    similarity = min(1.0, 0.8 * least_item / (most + 0.2 * least_item))
    return 1 if similarity >= 1 else math.ceil(math.log(MISS) / math.log(1 - similarity))


class Index:
    """The items of one block: shingles, their positions, and MinHash values by size class."""

    def __init__(self, ids: list, sets: list[np.ndarray]):
        self.ids = ids
        self.sizes = np.array([len(s) for s in sets])
        self.universe = np.unique(np.concatenate(sets)) if sets else np.empty(0, np.uint64)
        self.sets = [np.searchsorted(self.universe, s) for s in sets]
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[(self.universe >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        rng = np.random.default_rng(20)
        self.salt = rng.integers(1 << 62, size=MOST_FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.classes = {e: np.flatnonzero(np.array([int(n).bit_length() for n in self.sizes]) == e) for e in {int(n).bit_length() for n in self.sizes}}
        self.tables: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        flat = np.concatenate([*self.sets, np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.starts = np.searchsorted(flat[order], np.arange(len(self.universe) + 1))

    def signature(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Minimum of each of k functions over a set, told apart by function."""
        return np.array([mix(hashes * self.salt[i]).min() for i in range(k)], dtype=np.uint64) + np.arange(k, dtype=np.uint64)

    def table(self, e: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted MinHash values of a size class under at least k functions, and whose they are."""
        if e not in self.tables or self.tables[e][0] < k:
            k = min(MOST_FUNCTIONS, 1 << (k - 1).bit_length())
            values = np.concatenate([self.signature(self.universe[self.sets[i]], k) for i in self.classes[e]])
            order = np.argsort(values, kind="stable")
            self.tables[e] = (k, values[order], np.repeat(self.classes[e], k)[order])
        return self.tables[e][1:]

    def search(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) for each item of which the set has 0.8 or more."""
        near = hashes[self.filter[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]]
        if not len(near):
            return []
        at = np.minimum(np.searchsorted(self.universe, near), len(self.universe) - 1)
        at = at[self.universe[at] == near]
        if not len(at):
            return []
        values, most = self.universe[at], (1 << len(at).bit_length()) - 1
        needed = {e: functions_needed(most, 1 << (e - 1)) for e in self.classes}
        own = self.signature(values, min(MOST_FUNCTIONS, max(needed.values())))
        candidates: set[int] = set()
        for e, k in needed.items():
            if k > MOST_FUNCTIONS:
                found = np.unique(np.concatenate([self.owners[self.starts[i] : self.starts[i + 1]] for i in at]))
                candidates.update(found[np.isin(found, self.classes[e])].tolist())
            elif k:
                table, owner = self.table(e, k)
                a, b = np.searchsorted(table, own[:k], "left"), np.searchsorted(table, own[:k], "right")
                for x in np.flatnonzero(b > a):
                    candidates.update(owner[a[x] : b[x]].tolist())
        shared = ((i, int(np.isin(self.sets[i], at, assume_unique=True).sum())) for i in sorted(candidates))
        return [(i, n) for i, n in shared if 100 * n >= 80 * self.sizes[i]]


def _blocks(benchmark: DataFrame, text: str, block_bytes: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The items in blocks of about ``block_bytes`` of text, so that a block's index has a bounded size."""
    items = benchmark.select("item_id", F.col(text).cast("string").cast("binary").alias("t")).filter("t IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "t").collect()
        found = [(r.item_id, shingles(bytes(r.t), _HASHES)) for r in rows]
        found = [(i, s) for i, s in found if len(s)]
        if found:
            yield [i for i, _ in found], [s for _, s in found]


def _index(token: str, block: tuple[list, list[np.ndarray]]) -> Index:
    if token not in _WORKER:
        _WORKER.clear()
        _WORKER[token] = Index(*block)
    return _WORKER[token]


def _forget() -> None:
    _HASHES.clear()
    _WORKER.clear()


REMEMBERED["decontamination"] = _forget


def contained_items(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", block_bytes: int = 8_000_000) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_item`` and ``n_shared`` for each pair where a document has at least 0.8 of an item's

    distinct 5-word shingles (words as in ``shingles``).

    Documents are searched in one pass for each block of items, without a shuffle. A document is first reduced to those of
    its shingles that occur in the block, which changes no containment but makes the sets as small as what they share;
    otherwise the Jaccard similarity of a short item and a long document would be too low for MinHash. Both sides are
    then partitioned by size, powers of two; each pair of partitions uses as many MinHash functions as its lowest
    possible similarity needs to miss a true pair with probability of at most 1e-6 (beyond 256, candidates
    come from an inverted index). Candidates are verified exactly.

    Null and empty texts on either side match nothing. An item with under five words matches only a document that is the
    same few words. Repeated rows give repeated pairs. Empty tables give no rows.
    """
    kind = dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {kind}, n_item bigint, n_shared bigint"
    source = docs.select("doc_id", F.col(f"`{text}`").cast("string").cast("binary").alias("__text"))
    out = None
    for block in _blocks(benchmark, text, block_bytes):
        sent, token = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, token=token) -> Iterator[pa.RecordBatch]:
            working_on("decontamination")
            index = _index(token, sent.value)
            for batch in batches:
                for part in slices(batch, 1):
                    rows = [(k, *hit) for k, t in enumerate(part.column(1).to_pylist()) for hit in index.search(shingles(t, _HASHES))]
                    at = pa.array([r[0] for r in rows], pa.int64())
                    ids = pa.array([index.ids[r[1]] for r in rows], part_type(kind))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), ids, pa.array([int(index.sizes[r[1]]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["doc_id", "item_id", "n_item", "n_shared"])

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def part_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", block_bytes: int = 8_000_000) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, by the same search; texts aren't shuffled."""
    names, types = docs.columns, dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in names)
    for block in _blocks(benchmark, text, block_bytes):
        sent, token = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, token=token) -> Iterator[pa.RecordBatch]:
            working_on("decontamination")
            index = _index(token, sent.value)
            for batch in batches:
                last = batch.num_columns - 1
                for part in slices(batch, last):
                    keep = pa.array([not index.search(shingles(t, _HASHES)) for t in part.column(last).to_pylist()], pa.bool_())
                    yield pa.RecordBatch.from_arrays([part.column(i) for i in range(last)], names).filter(keep)

        docs = docs.select("*", F.col(f"`{text}`").cast("string").cast("binary").alias("__text")).mapInArrow(run, schema)
    return docs


#: DuckDB: exact containment through the items' shingles.
ORACLE = r"""
WITH lowered AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM lowered WHERE text IS NOT NULL),
sets AS (SELECT side, id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
items AS (SELECT id AS item_id, len(s) AS n_item, unnest(s) AS x FROM sets WHERE side = 1),
docs AS (SELECT id AS doc_id, unnest(s) AS x FROM sets WHERE side = 0)
SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM docs JOIN items USING (x) GROUP BY ALL HAVING 100 * count(*) >= 80 * n_item
"""

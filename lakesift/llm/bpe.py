"""Byte-level BPE with a segment tree that finds the leftmost pair of lowest rank."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import REMEMBERED, working_on

NO_PAIR = 1 << 62


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def merge_tokens(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece.

    Leaves of the tree stand for byte positions. The leaf of a live position holds ``rank << 32 | position``
    of the pair that starts there, so the root is the leftmost pair of minimum rank. A merge joins a token
    with its live right neighbour and renews three leaves: its own, its left neighbour's and the neighbour's
    that vanished; each costs a walk to the root, so n bytes need O(n log n).
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    tree = [NO_PAIR] * (2 * size)
    after = list(range(1, n + 1))  # start of the live token to the right; n at the end
    before = list(range(-1, n - 1))
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b

    while (low := tree[1]) != NO_PAIR:
        i = low & 0xFFFFFFFF
        gone = after[i]
        j = after[i] = after[gone]
        changed = [(gone, NO_PAIR)]
        if j < n:
            before[j] = i
            rank = get(piece[i : after[j]])
            changed.append((i, NO_PAIR if rank is None else rank << 32 | i))
        else:
            changed.append((i, NO_PAIR))
        if i:
            k = before[i]
            rank = get(piece[k:j])
            changed.append((k, NO_PAIR if rank is None else rank << 32 | k))
        for leaf, value in changed:
            node = size + leaf
            if tree[node] == value:
                continue
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                if other < value:
                    value = other
                node >>= 1
                if tree[node] == value:
                    break
                tree[node] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder for one vocabulary; pieces seen before come from a bounded memory."""

    def __init__(self, vocabulary: bytes, pattern: str, remembered: int = 300_000, longest: int = 64):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.table = [b""] * (1 + max(self.ranks.values(), default=-1))
        for token, rank in self.ranks.items():
            self.table[rank] = token
        self.findall = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall  # as Unicode has it
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.remembered, self.longest = remembered, longest

    def _piece(self, piece: str) -> bytes:
        ids = self.old.get(piece) or np.array(merge_tokens(piece.encode(), self.ranks), dtype="<u4").tobytes()
        if len(piece) <= self.longest:
            if len(self.young) >= self.remembered:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out = []
        for found in self.findall(text):
            out.append(self.young.get(found) or self._piece(found))
        return b"".join(out)

    def count(self, text: str | None) -> int:
        """Number of ids of the text."""
        if not text:
            return 0
        return sum([len(self.young.get(found) or self._piece(found)) for found in self.findall(text)]) >> 2

    def decode(self, ids: bytes) -> bytes:
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_CODECS: dict[tuple[str, str], Codec] = {}
REMEMBERED["bpe"] = _CODECS.clear


def codec(vocabulary: bytes, pattern: str) -> Codec:
    """One codec for each Python worker and vocabulary, so that its memory lasts over many tasks."""
    working_on("bpe")
    key = (hashlib.sha256(vocabulary).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary, pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, *, vocabulary: str | None = None, pattern: str | None = None, text: str = "text", keep: list[str] | None = None, ids: bool = True, decoded: bool = True) -> DataFrame:
    """Encode each text; gives ``keep`` (default: all columns but those made here) and

    ``token_ids`` (binary, little-endian unsigned 32-bit), ``n_tokens`` and ``decoded`` (binary, decoded from
    the ids). ``ids=False`` and ``decoded=False`` leave those two out. Null and empty texts have no tokens and
    decode to nothing. Columns of these names in the input are replaced. Rows are independent: repeated rows
    give repeated results. The vocabulary file is read on the driver and sent to the executors (under 1 MB).
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Path(vocabulary or default_vocabulary()).read_bytes())
    pattern = pattern or default_pattern()
    made = ["token_ids"] * ids + ["n_tokens"] + ["decoded"] * decoded
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), *(f"{c} {'bigint' if c == 'n_tokens' else 'binary'}" for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(sent.value, pattern)
        for batch in batches:
            for part in slices(batch, len(batch.schema) - 1):
                encoded = [tool.encode(t) for t in part.column(part.num_columns - 1).to_pylist()]
                columns = [part.column(i) for i in range(len(names))]
                if ids:
                    columns.append(pa.array(encoded, pa.binary()))
                columns.append(pa.array([len(x) >> 2 for x in encoded], pa.int64()))
                if decoded:
                    columns.append(pa.array([tool.decode(x) for x in encoded], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*names, *made])

    return docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of the column, one row at least."""
    n = batch.num_rows
    step = max(1, n * most // max(most, batch.column(column).nbytes))
    for start in range(0, n, step):
        yield batch.slice(start, step)


def digests(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``n_tokens``, and SHA-256 of the ids and of the decoded bytes, as lowercase hex."""
    return encode_documents(docs, keep=["doc_id"], **options).select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

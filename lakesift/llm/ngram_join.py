"""Jaccard join of 5-word shingle sets: prefixes under several global orders, then exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm.bpe import slices
from lakesift.llm.common import REMEMBERED, WordHashes, discard, members_only, membership, release, shingles, store, working_on
from lakesift.llm.components import components

BITS = 22  # the sketch of shingle frequencies has 2**BITS counters, whatever the input
SLOTS = 512  # so that one row of counters is small
_HASHES = WordHashes()
REMEMBERED["ngram_join"] = _HASHES.clear


def _texts(docs: DataFrame, text: str, *more: str) -> DataFrame:
    return docs.select(*(F.col(f"`{c}`") for c in more), F.col(f"`{text}`").cast("string").cast("binary").alias("__text"))


def frequency_levels(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Coarse level of each counter: 0 for ordinary shingles, then one more for each doubling.

    Each task counts all its documents' shingles in a fixed array; arrays are cut into slots and summed as
    they stream in. What reaches the driver is one array of fixed size.
    """
    width = (1 << BITS) // SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on("ngram_join")
        total = np.zeros(1 << BITS, dtype=np.uint32)
        for batch in batches:
            for part in slices(batch, 0):
                found = [shingles(t, _HASHES) for t in part.column(0).to_pylist()]
                if found:
                    at, times = np.unique((np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32), return_counts=True)
                    total[at] += times.astype(np.uint32)
        if total.any():
            low = np.minimum(total, 0xFFFF).astype("<u2").reshape(SLOTS, width)  # far beyond what tells frequent from rare
            some = np.flatnonzero(low.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([low[k].tobytes() for k in some], pa.binary())], ["slot", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[slot] = sums.get(slot, 0) + np.frombuffer(counts, dtype="<u2").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes() for x in sums.values()], pa.binary())], ["slot", "counts"])

    out = np.zeros((SLOTS, width), dtype=np.int64)
    for row in _texts(docs, text).mapInArrow(count, "slot int, counts binary").repartition(64, "slot").mapInArrow(add, "slot int, counts binary").collect():
        out[row.slot] = np.frombuffer(row.counts, dtype="<u4")
    flat = out.reshape(-1)
    usual = max(8.0, 1.5 * flat.sum() / len(flat))
    return np.where(flat <= usual, 0, 1 + np.floor(np.log2(np.maximum(flat, 1) / usual))).clip(0, 60).astype(np.uint8)


def shingle_sets(docs: DataFrame, levels: np.ndarray, text: str = "text") -> DataFrame:
    """For each row: set size ``n``, signature ``s1``, ``s2`` of the set, and its prefixes under three orders.

    At a similarity of 0.8 two sets share ceil(0.8 n) shingles at least, so under any order of all shingles
    they share one among the first n - ceil(0.8 n) + 1 of each. Order 1 goes from rare to frequent (level,
    then hash); its prefix comes as ``cold`` (level 0) and ``hot`` shingles. Order 2 goes by ascending hash
    and order 3 by descending hash; of these, ``p2`` and ``p3`` keep the upper 32 bits.
    """
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def lists(values: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *values])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on("ngram_join")
        level = sent.value
        for batch in batches:
            for part in slices(batch, 1):
                size, first, second, cold, hot, low, high = [], [], [], [], [], [], []
                for t in part.column(1).to_pylist():
                    h = shingles(t, _HASHES)
                    n = len(h)
                    size.append(n)
                    digest = xxhash.xxh3_128_intdigest(h.tobytes()) if n else 0
                    first.append((digest >> 64) - (1 << 63))
                    second.append((digest & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                    p = n - (4 * n + 4) // 5 + 1 if n else 0
                    at = level[(h >> np.uint64(64 - BITS)).astype(np.int64)]
                    prefix = np.argsort(at, kind="stable")[:p]
                    heat = at[prefix] > 0
                    chosen = h[prefix].view(np.int64)
                    cold.append(chosen[~heat])
                    hot.append(chosen[heat])
                    top = (h >> np.uint64(32)).astype("<u4")
                    low.append(top[:p].tobytes())
                    high.append((np.uint32(0xFFFFFFFF) - top[::-1][:p]).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists(cold), lists(hot), pa.array(low, pa.binary()), pa.array(high, pa.binary())],
                    ["doc_id", "n", "s1", "s2", "cold", "hot", "p2", "p3"],
                )

    return _texts(docs, text, "doc_id").mapInArrow(run, "doc_id bigint, n int, s1 bigint, s2 bigint, cold array<bigint>, hot array<bigint>, p2 binary, p3 binary")


def _most_shared(na: int, nb: int, a: np.ndarray, b: np.ndarray) -> int:
    """Upper bound of the intersection by one order, from both prefixes (sorted, upper bits only)."""
    top = min(a[-1], b[-1])
    ca, cb = int(np.searchsorted(a, top, "right")), int(np.searchsorted(b, top, "right"))
    a, b = a[:ca], b[:cb]
    in_b = b[np.minimum(np.searchsorted(b, a), cb - 1)] == a if cb else np.zeros(ca, dtype=bool)
    in_a = a[np.minimum(np.searchsorted(a, b), ca - 1)] == b if ca else np.zeros(cb, dtype=bool)
    return min(int(in_b.sum()) + na - ca, int(in_a.sum()) + nb - cb)


def _other_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep a pair of order 1 only if its prefixes under orders 2 and 3 allow enough shared shingles."""
    for batch in batches:
        na, nb, *packed = (batch.column(i).to_pylist() for i in range(2, 8))
        keep = []
        for m, n, a2, a3, b2, b3 in zip(na, nb, *packed):
            need = -(-4 * (m + n) // 9)
            keep.append(min(m, n) >= need - min(m, n) and all(_most_shared(m, n, np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) >= need for x, y in ((a2, b2), (a3, b3))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep pairs whose whole texts have a similarity of 0.8 or more."""
    working_on("ngram_join")
    last, left = None, None
    for batch in batches:
        for part in slices(batch, 2):
            keep = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                if x != last or left is None:
                    last, left = x, shingles(x, _HASHES)
                right = shingles(y, _HASHES)
                both = int(np.isin(left, right, assume_unique=True).sum())
                keep.append(100 * both >= 80 * (len(left) + len(right) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def ngram_join(docs: DataFrame, *, text: str = "text", most_star_rounds: int = 8) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for each row: all links of 0.8 or more, as components.

    1. Rows with equal sets fall into one class, whatever its size; classes go on under their least doc_id.
    2. Classes that share a shingle of their order-1 prefixes stand in one list; two of them can only be similar if few
       enough shingles stand before it in both. In each list every class is
       compared with one pivot; pairs must also pass the filters of orders 2 and 3, and are then verified on whole
       texts. Once lists hold few pairs across components, or pivots no longer join many, all pairs across
       components are compared. Pairs inside a component add nothing, so no link between components is lost,
       and a group of thousands of near copies costs about one comparison for each.

    ``component_id`` is the least doc_id that links reach. Null and empty texts have no shingles and stay alone.
    Repeated rows get equal results. Rows with one doc_id and different texts are one document: each has the size of its
    own set, and links of any of them count for all (but not for a row without shingles). A row without doc_id gets the
    component of its class, or null. An empty table gives no rows.
    """
    levels = frequency_levels(docs, text)
    sets = store(shingle_sets(docs, levels, text))
    rows = store(sets.select("doc_id", "n", "s1", "s2"))
    classes = store(sets.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("n", "cold", "hot", "p2", "p3"))).filter("node IS NOT NULL"))
    discard(sets)
    release(docs.sparkSession)
    lists = _lists(classes)
    release(docs.sparkSession)
    facts = classes.select("node", "n", "p2", "p3")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = store(pairs.select("a", "b").distinct())
        release(docs.sparkSession)
        # Stored, so that both sides of a join read little and no task runs several Python workers at once.
        near = store(members_only(facts, "node", membership(pairs.select(F.explode(F.array("a", "b")).alias("node")), "node")))
        pairs = pairs.join(near.toDF("a", "na", "a2", "a3"), "a").join(near.toDF("b", "nb", "b2", "b3"), "b")
        pairs = store(pairs.select("a", "b", "na", "nb", "a2", "a3", "b2", "b3").mapInArrow(_other_orders, "a bigint, b bigint"))
        discard(near)
        texts = store(members_only(_texts(docs, text, "doc_id"), "doc_id", membership(pairs.select(F.explode(F.array("a", "b")).alias("node")), "node")))
        pairs = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
        out = store(pairs.select("a", "b", "x", "y").mapInArrow(_verify, "a bigint, b bigint").distinct())
        discard(texts)
        release(docs.sparkSession)
        return out

    names = ("token", "node", "n", "pos")
    links = None
    before = None
    most_star_rounds = max(1, most_star_rounds)
    for turn in range(most_star_rounds + 1):
        if links is None:
            part = lists.select(*names, F.col("node").alias("component"), F.lit(0).cast("bigint").alias("degree"))
        else:
            degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
            part = lists.join(store(components(links).join(degree, "node")), "node", "left")
            part = part.select(*names, F.coalesce("component", "node").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree"))
        mixed = part.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q"))
        mixed = store(mixed.filter("m * m > q"))
        members, across = mixed.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum(F.expr("(m * m - q) / 2")), F.lit(0))).first()
        if not members:
            break
        part = store(part.join(mixed.select("token"), "token", "left_semi"))
        lists = part.select(*names)  # lists of one component need not be looked at again
        # A first round of pivots always joins copies; then all pairs across components, once they are few or pivots help little.
        last = turn > 0 and (across <= 2 * members + 20_000 or turn == most_star_rounds or across > before / 2)
        if last:
            pairs = part.toDF(*(f"{c}_a" for c in part.columns)).join(part.toDF(*(f"{c}_b" for c in part.columns)), F.col("token_a") == F.col("token_b"))
            enough = _enough(*(F.col(c) for c in ("n_a", "pos_a", "n_b", "pos_b")))
            pairs = pairs.filter(F.expr("node_a < node_b AND component_a != component_b") & enough).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        else:
            # First the class with fewest rare shingles before the token, the most usual one; then the one with most links.
            order = F.struct((-F.col("pos")).alias("k"), (-F.col("n")).alias("n"), (-F.col("node")).alias("i")) if links is None else F.struct(F.col("degree").alias("k"), F.xxhash64("node", F.lit(turn)).alias("i"))
            pivots = part.groupBy("token").agg(F.max_by(F.struct("node", "component", "n", "pos"), order).alias("p"))
            pairs = part.join(pivots, "token").filter((F.col("component") != F.col("p.component")) & _enough(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos")))
            pairs = pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"))
        new = verified(pairs)
        links = new if links is None else links.union(new)
        before = across
        if last:
            break
    same = _one_id(rows, classes)
    if not same.isEmpty():
        links = same if links is None else links.union(same)
    rows = rows.join(classes.select("s1", "s2", "node"), ["s1", "s2"], "left")
    if links is not None:
        rows = rows.join(store(components(links)), "node", "left")
    else:
        rows = rows.withColumn("component", F.lit(None).cast("bigint"))
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "node"))
    return rows.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), own.alias("component_id"))


def _one_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between classes that have rows with one doc_id; usually none."""
    span = [f(c).alias(f"{name}_{c}") for c in ("s1", "s2") for name, f in (("least", F.min), ("most", F.max))]
    several = store(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(*span).filter("least_s1 != most_s1 OR least_s2 != most_s2").select("doc_id"))
    held = rows.join(several, "doc_id", "left_semi").join(classes.select("s1", "s2", "node"), ["s1", "s2"]).select("doc_id", "node").distinct()
    return store(held.join(held.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").filter("a != node").select("a", F.col("node").alias("b")).distinct())


def _enough(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Whether two sets can be similar if they first meet, in order 1, at these positions: what stands before is not shared."""
    return F.least(n - pos, m - at) >= F.floor((4 * (n + m) + 8) / 9)


def _lists(classes: DataFrame) -> DataFrame:
    """``token``, ``node``, ``n`` and position ``pos`` for each order-1 prefix shingle that two or more classes have.

    A cold shingle stands in as many sets as its counter says at most, a fixed small share of all, so its
    list is one window. Hot ones are counted before the shuffle and joined back, and such a join can be split.
    """
    names = ("token", "node", "n", "pos")
    # Not even the smallest set of the list that it could match leaves room for what stands before.
    room = _enough(F.col("n"), F.col("pos"), F.greatest(F.col("least"), F.ceil(F.col("n") * 4 / 5)), F.lit(-(1 << 30)))
    w = Window.partitionBy("token")
    cold = classes.select("node", "n", F.posexplode("cold").alias("pos", "token"))
    cold = cold.withColumn("c", F.count("*").over(w)).withColumn("least", F.min("n").over(w)).filter("c > 1").filter(room).select(*names)
    hot = classes.select("node", "n", F.size("cold").alias("before"), F.posexplode("hot").alias("pos", "token")).withColumn("pos", F.col("pos") + F.col("before"))
    often = hot.groupBy("token").agg(F.count("*").alias("c"), F.min("n").alias("least")).filter("c > 1").select("token", "least")
    hot = hot.join(often, "token").filter(room).select(*names)
    return store(cold.union(hot))


def keep_one(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does, that with the least doc_id.

    Documents without shingles and rows without a doc_id stay. Of rows with one doc_id, one stays.
    """
    stay = store(ngram_join(docs, text=text)).filter("doc_id = component_id").select("doc_id").distinct()
    ids = docs.filter(F.col("doc_id").isNotNull())
    return ids.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"]).union(docs.filter(F.col("doc_id").isNull()))


#: DuckDB: exact sets and all pairs that share a shingle, for small tables.
ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT s.doc_id, len(s.s) AS n_shingles, (SELECT min(r.other) FROM reach r WHERE r.doc_id = s.doc_id) AS component_id FROM sets s
"""

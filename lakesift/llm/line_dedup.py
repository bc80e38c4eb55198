"""Repeated runs of lines, found by winnowing over line hashes; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm.common import discard, fresh, store

WORD = r"[^\\x20\\x09-\\x0D]+"
COMMON = 4096  # a key of more than this share of rows is common


def line_hashes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``d``, ``v`` (id and hash of the text, which name a document) and ``ls``: of each line with a word

    its number ``p`` among all lines, two independent hashes ``a`` and ``b``, and its words ``w``.
    """
    t = f"`{text}`"
    lines = F.expr(f"transform(split({t}, '\\n'), (x, i) -> struct(i AS p, xxhash64(x) AS a, xxhash64(7, x) AS b, regexp_count(x, '{WORD}') AS w))")
    return docs.filter(F.col("doc_id").isNotNull() & F.col(t).isNotNull()).select(F.col("doc_id").alias("d"), F.xxhash64(t).alias("v"), F.filter(lines, lambda s: s.w > 0).alias("ls"), F.size(F.split(F.col(t), "\n")).alias("lines"))


def fingerprints(hashed: DataFrame, long_line: int) -> DataFrame:
    """Window minima: one row for each selected hash ``f``, with the windows ``ws`` that chose it.

    A window is three lines in a row, two hashes of neighbouring lines; the smaller is selected (the later,
    if equal). Equal windows select equal hashes wherever they stand, so any run of three lines or more
    that occurs twice shares a fingerprint. A line of ``long_line`` words or more is a window by itself.
    A window keeps its first line ``i`` (counted among lines with words), two hashes ``k`` and ``l``, the numbers of its
    first line and of the line after it, ``s`` and ``e``, and, of one line only, what stands on either side, ``x``.
    """
    grams = F.expr("transform(sequence(0, greatest(size(ls) - 2, 0)), i -> xxhash64(2, get(ls, i).a, get(ls, i + 1).a))")
    pick = "IF(get(g, {0}) < get(g, {0} + 1), {0}, {0} + 1)"
    beside = "STRUCT<pa: BIGINT, pb: BIGINT, ps: INT, na: BIGINT, nb: BIGINT, ne: INT>"
    window = f"""struct({{0}} AS i, xxhash64(3, get(ls, {{0}}).a, get(ls, {{0}} + 1).a, get(ls, {{0}} + 2).a) AS k, xxhash64(3, get(ls, {{0}}).b, get(ls, {{0}} + 1).b, get(ls, {{0}} + 2).b) AS l,
        get(ls, {{0}}).p AS s, coalesce(get(ls, {{0}} + 3).p, lines) AS e, CAST(NULL AS {beside}) AS x)"""
    # Gram s is chosen by window s - 1, by window s, or by both.
    short = f"""IF(size(ls) < 3, array(), filter(transform(sequence(0, size(ls) - 2), s -> struct(get(g, s) AS f, array_compact(array(
        IF(s >= 1 AND {pick.format('(s - 1)')} = s, {window.format('(s - 1)')}, NULL),
        IF(s + 2 < size(ls) AND {pick.format('s')} = s, {window.format('s')}, NULL))) AS ws)), x -> size(x.ws) > 0))"""
    long = f"""filter(transform(ls, (x, i) -> IF(x.w >= {int(long_line)}, struct(xxhash64(1, x.a) AS f, array(struct(i AS i, xxhash64(1, x.a) AS k, xxhash64(1, x.b) AS l, x.p AS s, coalesce(get(ls, i + 1).p, lines) AS e,
        CAST(struct(get(ls, i - 1).a, get(ls, i - 1).b, get(ls, i - 1).p, get(ls, i + 1).a, get(ls, i + 1).b, coalesce(get(ls, i + 2).p, lines)) AS {beside}) AS x)) AS ws), NULL)), x -> x IS NOT NULL)"""
    return hashed.withColumn("g", grams).select("d", "v", F.explode(F.expr(f"concat({short}, {long})")).alias("x")).select("d", "v", "x.f", "x.ws")


def _meet(many: DataFrame, total: int, counted: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join with ``counted``, one row for each key of ``many`` with its number of rows ``c``.

    Keys of more than one in ``COMMON`` of all rows are ``COMMON`` at most, so they are broadcast and their rows stay
    where they are; the rest is shuffled, and no key of it can fill a task.
    """
    often = F.col("c") * COMMON > total
    hot = F.broadcast(counted.filter(often))
    return many.join(hot.drop("c"), keys, how).unionByName(many.join(hot.select(*keys), keys, "left_anti").join(counted.filter(~often).drop("c"), keys, how))


def repeated_runs(hashed: DataFrame, long_line: int) -> DataFrame:
    """``d``, ``v`` and ``runs``: line numbers ``start`` to ``end`` (not included) of the later repeated runs, in order and apart."""
    prints = store(fingerprints(hashed, long_line))
    often = store(prints.groupBy("f").agg(F.count("*").alias("c")).filter("c > 1"))
    # Positions with the same fingerprint meet; of the windows behind it, the equal ones are copies.
    windows = store(_meet(prints, prints.count(), often, ["f"], "left_semi").select("d", "v", F.explode("ws").alias("w")).select("d", "v", "w.*"))
    discard(prints)
    discard(often)
    first = store(windows.groupBy("k", "l").agg(F.min(F.struct("d", "v", "i", "x")).alias("o"), F.count("*").alias("c")).filter("c > 1"))
    matches = _meet(windows, windows.count(), first, ["k", "l"], "inner").filter("struct(d, v, i) > struct(o.d, o.v, o.i)")
    # Extend each match both ways. Every window of a run of three lines is itself a match, and they grow together below;
    # what is left to compare is the line on either side of a match of one line.
    before, after = "x.pa = o.x.pa AND x.pb = o.x.pb", "x.na = o.x.na AND x.nb = o.x.nb"
    grown = matches.select("d", "v", F.expr(f"IF({before}, x.ps, s)").alias("start"), F.expr(f"IF({after}, x.ne, e)").alias("end"))
    mine = Window.partitionBy("d", "v").orderBy("start", "end")
    grown = grown.withColumn("reach", F.max("end").over(mine.rowsBetween(Window.unboundedPreceding, -1)))
    grown = grown.withColumn("island", F.count(F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1)).over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    islands = grown.groupBy("d", "v", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return islands.groupBy("d", "v").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def line_dedup(docs: DataFrame, *, text: str = "text", long_line: int = 25) -> DataFrame:
    """All columns, with later repeats of runs of lines deleted from ``text``, and ``n_lines`` and ``n_deleted`` (lines).

    A run is repeated if an equal run starts earlier, by doc_id and then line, in the same text or another, and if it
    has three lines with words or one line of ``long_line`` words: so every passage of whole lines with at least
    ``2 * long_line`` words is caught. Matches grow both ways while the lines are equal. The earliest copy stays.
    Lines without words don't count; those that follow a deleted line go with it. ``n_chars`` is renewed if
    it is among the columns.

    Null and empty texts, and rows without a doc_id, stay as they are. Rows that share doc_id and text are one document
    and get the same result; an empty table gives none. Work grows with the number of lines, also of a text that only
    repeats itself; a document's lines must fit in a task. Columns ``n_lines`` and ``n_deleted`` of the input are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    t = f"`{text}`"
    d, v, r = fresh(docs.columns, "run_d", "run_v", "runs")
    runs = repeated_runs(store(line_hashes(docs, text)), long_line).toDF(d, v, r)
    rows = docs.select(*(F.col(f"`{c}`") for c in names))
    out = rows.join(runs.hint("shuffle_hash"), (F.col("doc_id") == F.col(d)) & (F.xxhash64(t) == F.col(v)), "left")
    # Stretches between the runs; the text is split once.
    kept = F.expr(f"""get(transform(array(struct(split({t}, '\n') AS lines, {r} AS runs)), z -> array_join(flatten(transform(sequence(0, size(z.runs)), j ->
        slice(z.lines, IF(j = 0, 0, get(z.runs, j - 1).end) + 1, IF(j = size(z.runs), size(z.lines), get(z.runs, j).start) - IF(j = 0, 0, get(z.runs, j - 1).end)))), '\n')), 0)""")
    new = F.when(F.col(r).isNull(), F.col(t)).otherwise(kept)
    n_lines = F.when(F.col(t).isNull(), 0).otherwise(F.size(F.split(F.col(t), "\n"))).cast("bigint")
    n_deleted = F.coalesce(F.expr(f"aggregate({r}, 0, (n, x) -> n + x.end - x.start)"), F.lit(0)).cast("bigint")
    out = out.select(*(new.alias(c) if c == text else F.col(f"`{c}`") for c in names), n_lines.alias("n_lines"), n_deleted.alias("n_deleted"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length(t)).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out


#: DuckDB: the same rows as the query, from the texts of the lines instead of hashes.
ORACLE = r"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
every AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS p FROM parts),
words AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM every),
lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS j FROM words WHERE w > 0),
windows AS (
  SELECT doc_id, j, 'l' || line AS content FROM lines WHERE w >= 25
  UNION ALL
  SELECT doc_id, j, content FROM (SELECT doc_id, j, 's' || line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS content
    FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY j)) WHERE content IS NOT NULL),
firsts AS (SELECT content, min((doc_id, j)) AS o FROM windows GROUP BY content HAVING count(*) > 1),
seeds AS (SELECT DISTINCT w.doc_id, f.o[1] AS d0, w.j - f.o[2] AS shift, w.j FROM windows w JOIN firsts f USING (content) WHERE (w.doc_id, w.j) > f.o),
pairs AS (SELECT DISTINCT doc_id, d0, shift FROM seeds),
equal AS (SELECT x.doc_id, x.d0, x.shift, l.j, l.p, l.j - row_number() OVER (PARTITION BY x.doc_id, x.d0, x.shift ORDER BY l.j) AS island
  FROM pairs x JOIN lines l ON l.doc_id = x.doc_id JOIN lines o ON o.doc_id = x.d0 AND o.j = l.j - x.shift AND o.line = l.line),
hit AS (SELECT DISTINCT e.doc_id, e.d0, e.shift, e.island FROM equal e JOIN seeds s ON s.doc_id = e.doc_id AND s.d0 = e.d0 AND s.shift = e.shift AND s.j = e.j),
gone AS (SELECT DISTINCT e.doc_id, e.p FROM equal e JOIN hit h ON h.doc_id = e.doc_id AND h.d0 = e.d0 AND h.shift = e.shift AND h.island = e.island),
owner AS (SELECT doc_id, p, line, max(CASE WHEN w > 0 THEN p END) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM words),
marked AS (SELECT o.*, g.p IS NOT NULL AS deleted FROM owner o LEFT JOIN gone g ON g.doc_id = o.doc_id AND g.p = o.q),
joined AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE deleted) AS n_deleted, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT deleted), '') AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, length(j.text) AS n_chars, sha256(j.text) AS text_sha256
FROM documents d LEFT JOIN joined j ON j.doc_id = d.doc_id
"""

"""Queries on entries of a tree and their facts; a document or an order stands for an entry. Survey rows A8, A9, C5, C9, C27, I47, I48."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakesift.registry import query, table
from lakesift.sources import entries

_MODES = [0o100644, 0o040755, 0o120777, 0o010644, 0o140755, 0o060660, 0o100600]


@query(f"""SELECT doc_id, CASE (m & 61440) WHEN 32768 THEN 'file' WHEN 16384 THEN 'directory' WHEN 40960 THEN 'symlink' ELSE CASE WHEN m IS NOT NULL THEN 'other' END END AS entry_kind
  FROM (SELECT doc_id, ({_MODES})[doc_id % 8 + 1] AS m FROM documents)""")
def entry_kinds(spark, sf_dir):
    """Kind by the mode's type bits; one mode in eight is unknown."""
    mode = F.get(F.array(*(F.lit(m) for m in _MODES)), (F.col("doc_id") % 8).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", entries.entry_kind(mode).alias("entry_kind"))


@query(f"""SELECT CASE WHEN (m & 61440) = 40960 THEN 'symlink_skipped' ELSE 'unsupported_file_type' END AS code, count(*) AS entries
  FROM (SELECT ({_MODES})[doc_id % 8 + 1] AS m FROM documents) WHERE (m & 61440) NOT IN (32768, 16384) GROUP BY ALL""")
def entry_issues(spark, sf_dir):
    """Links and special files are left out, each with an issue."""
    mode = F.get(F.array(*(F.lit(m) for m in _MODES)), (F.col("doc_id") % 8).cast("int"))
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), entries.entry_kind(mode).alias("entry_kind"), F.lit(None).cast("string").alias("issue"))
    return entries.regular_files(found)[1].groupBy("code").agg(F.count("*").alias("entries"))


@query("""SELECT path, min(o_orderkey) AS entry, arg_min(o_custkey, o_orderkey) AS size FROM (SELECT o_orderkey, o_custkey, o_orderpriority || '/' || o_custkey % 1000 AS path FROM orders) GROUP BY path""")
def first_of_path(spark, sf_dir):
    """The first entry of each path."""
    found = table(spark, sf_dir, "orders").select(F.concat("o_orderpriority", F.lit("/"), (F.col("o_custkey") % 1000).cast("string")).alias("path"), F.col("o_orderkey").alias("entry"), F.col("o_custkey").alias("size"))
    return entries.first_of_path(found, "entry")


@query("""SELECT o_orderkey, sha256('source-1|' || CASE WHEN o_orderkey % 2 = 0 THEN 'file' ELSE 'directory' END || '|=' || o_orderkey || '|' || coalesce('=' || CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END, '-')
  || '|' || coalesce('=' || CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderpriority END, '-')) AS signature FROM orders""")
def source_signatures(spark, sf_dir):
    """Digest of an entry's facts, absent ones told from all values."""
    kind = F.when(F.col("o_orderkey") % 2 == 0, "file").otherwise("directory")
    fields = [F.col("o_orderkey"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")), F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority"))]
    return table(spark, sf_dir, "orders").select("o_orderkey", entries.source_signature(kind, fields).alias("signature"))


@query("""SELECT o_orderkey, to_base64(encode('ticket-1:' || o_custkey || ':' || o_orderkey)) AS ticket, sha256('ticket-1:' || o_custkey || ':' || o_orderkey) AS sort_key FROM orders""")
def ticket_sort_keys(spark, sf_dir):
    """Opaque versioned ticket, ordered by the digest of its bytes."""
    raw = F.concat_ws(":", F.lit("ticket-1"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.base64(raw.cast("binary")).alias("ticket"), F.sha2(raw, 256).alias("sort_key"))


_PATH = """CASE doc_id % 7 WHEN 0 THEN lang || '/' || source WHEN 1 THEN '/' || source WHEN 2 THEN lang || '/../' || source WHEN 3 THEN lang || '//' || source WHEN 4 THEN '' WHEN 5 THEN lang || '/é' || doc_id ELSE lang || '/./x' END"""


@query(f"""SELECT doc_id, CASE WHEN raw IS NULL OR raw = '' THEN 'empty' WHEN doc_id % 11 = 0 THEN 'display_differs' WHEN raw[1] = '/' THEN 'absolute' WHEN list_has_any(string_split(raw, '/'), ['', '.', '..']) THEN 'traversal' END AS problem
  FROM (SELECT doc_id, {_PATH} AS raw FROM documents)""")
def stored_paths(spark, sf_dir):
    """Stored paths whose bytes, display or components can't be trusted."""
    raw = F.expr(_PATH)
    display = F.when(F.col("doc_id") % 11 == 0, F.concat(raw, F.lit("?"))).otherwise(raw)
    return table(spark, sf_dir, "documents").select("doc_id", entries.path_evidence(display, raw.cast("binary")).alias("problem"))

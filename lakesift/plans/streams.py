"""Queries on batches of events and progress. Survey rows B1-B5, F9, L1-L9."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakesift.registry import query, table
from lakesift.streaming import enumeration as E


@query("SELECT event_id, user_id, 1 + event_id % 1000 AS size, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 128 AS chunk FROM events")
def event_chunks(spark, sf_dir):
    """B2, L1: batches of at most 128 events; sizes here never reach the byte limit first."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (1 + F.col("event_id") % 1000).alias("size"))
    return E.chunks(e, "user_id", "event_id", "size")


@query("""WITH RECURSIVE p AS (SELECT user_id AS session, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id * 30 AS at_ms, event_id AS completed FROM events),
  s AS (SELECT session, seq, n, at_ms, completed FROM p WHERE n = 1 UNION ALL SELECT x.session, x.seq, x.n, x.at_ms, x.completed FROM s, LATERAL (SELECT * FROM p WHERE p.session = s.session AND p.n > s.n AND (p.completed - s.completed >= 256 OR p.at_ms - s.at_ms >= 200) ORDER BY p.n LIMIT 1) x)
  SELECT session, seq FROM s""")
def throttled_progress(spark, sf_dir):
    """Progress shown at most every 200 ms or 256 items, counted from the last one shown."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.lit("scan").alias("stage"), F.col("event_id").alias("completed"), (F.col("event_id") * 30).alias("at_ms"), F.lit(False).alias("terminal"))
    return E.throttled(e).select("session", "seq")


@query("SELECT doc_id AS file_id, sha256(text) AS digest, NULL AS issue FROM documents")
def digest_batches(spark, sf_dir):
    """L2: digests batch by batch."""
    return E.fingerprint_batches(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content")))

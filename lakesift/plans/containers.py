"""Queries on raw containers, built from documents. Survey rows A11-A24, J14."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakesift.registry import query, table
from lakesift.sources import containers as C


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 2 THEN 'unknown' WHEN doc_id % 3 = 1 THEN 'iso-bmff' ELSE 'tiff' END AS format, CASE doc_id % 3 WHEN 0 THEN 'extracted' WHEN 1 THEN 'extracted' ELSE 'unsupported' END AS status,
  CASE doc_id % 3 WHEN 0 THEN 'modify' WHEN 1 THEN 'mvhd' END AS kind, CASE doc_id % 3 WHEN 0 THEN '2024:06:07 08:09:' || lpad((doc_id % 60)::VARCHAR, 2, '0') WHEN 1 THEN (3800000000 + doc_id)::VARCHAR END AS raw FROM documents""")
def container_fields(spark, sf_dir):
    """Time fields out of TIFF and movie bytes assembled for each document."""
    when = F.concat(F.lit("2024:06:07 08:09:"), F.lpad((F.col("doc_id") % 60).cast("string"), 2, "0"))
    tiff = F.concat(F.lit("49492A0008000000" "0100" "3201" "0200" "14000000" "1A000000" "00000000"), F.hex(F.encode(when, "UTF-8")), F.lit("00"))
    movie = F.concat(F.lit("00000018" "6D6F6F76" "00000010" "6D766864" "00000000"), F.lpad(F.hex(F.col("doc_id") + 3_800_000_000), 8, "0"))
    content = F.when(F.col("doc_id") % 3 == 0, F.unhex(tiff)).when(F.col("doc_id") % 3 == 1, F.unhex(movie)).otherwise(F.encode(F.lit("<html>"), "UTF-8"))
    out = C.extract_table(table(spark, sf_dir, "documents").select("doc_id", content.alias("content")), "doc_id", "content")
    return out.select("id", "format", "status", "kind", F.regexp_replace(F.decode("raw", "UTF-8"), "\x00$", "").alias("raw"))

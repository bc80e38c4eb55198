"""Queries on exact duplicates; a document stands for a file. Survey rows A1-A3, C8-C10, D21-D23, E1-E6, E31-E34, I44-I46."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesift.operators import dedup
from lakesift.registry import query, table

TARGET = 64
FILES_SQL = """files AS (SELECT doc_id AS file_id, lang || '/' || source || '/' || doc_id || '.txt' AS path, strlen(text) AS size, text AS content,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id - doc_id % 2 END AS object_key FROM documents)"""
_SAMPLE = """CASE WHEN size <= 64 THEN [0] ELSE list_sort(list_distinct([0, (size - least(64, greatest(size // 3, 1))) // 2, size - least(64, greatest(size // 3, 1))])) END"""
_STEPS = f"""{FILES_SQL},
s1 AS (SELECT * FROM files WHERE size IN (SELECT size FROM files GROUP BY size HAVING count(*) > 1)),
s2 AS (SELECT *, CASE WHEN size <= 64 THEN size ELSE least(64, greatest(size // 3, 1)) END AS chunk, {_SAMPLE} AS offs FROM s1),
s3 AS (SELECT *, sha256('sample-1|' || size || '|64|' || array_to_string([o || ':' || chunk || ':' || substring(hex(content), 2 * o + 1, 2 * chunk) FOR o IN offs], '|')) AS sample FROM s2),
s4 AS (SELECT * FROM s3 WHERE (size, sample) IN (SELECT (size, sample) FROM s3 GROUP BY size, sample HAVING count(*) > 1)),
s5 AS (SELECT *, sha256(content) AS digest FROM s4),
s6 AS (SELECT * FROM s5 WHERE (size, digest) IN (SELECT (size, digest) FROM s5 GROUP BY size, digest HAVING count(*) > 1)),
members AS (SELECT m.digest AS group_key, m.size, m.file_id, m.path, m.object_key, r.file_id AS representative FROM s6 m
  JOIN s6 r ON r.size = m.size AND r.digest = m.digest AND r.content = m.content
  WHERE r.file_id = (SELECT min(x.file_id) FROM s6 x WHERE x.size = m.size AND x.digest = m.digest))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("file_id"),
        F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.col("text").alias("content"),
        F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") - F.col("doc_id") % 2).alias("object_key"),
    )


@query(f"""WITH {_STEPS} SELECT group_key, size, representative, count(*) AS files, count(DISTINCT object_key) + count(*) FILTER (WHERE object_key IS NULL) AS independent,
  size * greatest(count(DISTINCT object_key) + count(*) FILTER (WHERE object_key IS NULL) - 1, 0) AS reclaimable FROM members GROUP BY group_key, size, representative ORDER BY reclaimable DESC, representative""")
def exact_duplicate_groups(spark, sf_dir):
    """Groups of equal content, most reclaimable bytes first."""
    return dedup.group_measures(dedup.verified_members(files(spark, sf_dir), TARGET)).orderBy(F.desc("reclaimable"), "representative")


@query(f"WITH {_STEPS} SELECT group_key, file_id, representative, file_id = representative AS is_representative, row_number() OVER (PARTITION BY group_key ORDER BY path) - 1 AS ordinal FROM members")
def exact_group_members(spark, sf_dir):
    """Members with their place by path."""
    w = Window.partitionBy("group_key").orderBy("path")
    m = dedup.verified_members(files(spark, sf_dir), TARGET)
    return m.select("group_key", "file_id", "representative", (F.col("file_id") == F.col("representative")).alias("is_representative"), (F.row_number().over(w) - 1).cast("bigint").alias("ordinal"))


@query(f"WITH {_STEPS} SELECT group_key, representative, file_id AS member, size AS compared_bytes FROM members WHERE file_id <> representative")
def verification_edges(spark, sf_dir):
    """K - 1 comparisons for k members."""
    m = dedup.verified_members(files(spark, sf_dir), TARGET, strict_bucket=True)
    return m.filter("file_id != representative").select("group_key", "representative", F.col("file_id").alias("member"), F.col("size").alias("compared_bytes"))


@query(f"WITH {_STEPS} SELECT group_key, sha256(string_agg(path, chr(10) ORDER BY path)) AS discriminator FROM members GROUP BY group_key")
def class_discriminators(spark, sf_dir):
    """E5: digest of a group's paths in order."""
    return dedup.class_discriminator(dedup.verified_members(files(spark, sf_dir), TARGET))


@query(f"""WITH {_STEPS} SELECT '1 listed' AS stage, count(*) AS files, coalesce(sum(size), 0) AS bytes FROM files UNION ALL SELECT '2 same size', count(*), coalesce(sum(size), 0) FROM s1
  UNION ALL SELECT '3 same sample', count(*), coalesce(sum(size), 0) FROM s4 UNION ALL SELECT '4 same digest', count(*), coalesce(sum(size), 0) FROM s6""")
def fingerprint_summary(spark, sf_dir):
    """Files and bytes that reach each step."""
    return dedup.stage_summary(files(spark, sf_dir), TARGET)


@query(f"WITH {FILES_SQL} SELECT size, count(*) AS files FROM files GROUP BY size HAVING count(*) > 1")
def size_buckets(spark, sf_dir):
    """E1, E7, C10."""
    return files(spark, sf_dir).groupBy("size").agg(F.count("*").alias("files")).filter("files > 1")


@query(f"WITH {_STEPS} SELECT size, sample, count(*) AS files FROM s3 GROUP BY ALL HAVING count(*) > 1")
def sample_buckets(spark, sf_dir):
    """Sampled digests shared inside a size."""
    by_size = dedup.in_buckets(files(spark, sf_dir), "size").withColumn("sample", dedup.sample_digest(F.col("content"), F.col("size"), TARGET))
    return by_size.groupBy("size", "sample").agg(F.count("*").alias("files")).filter("files > 1")


@query(f"WITH {FILES_SQL} SELECT file_id, size, CASE WHEN size <= 64 THEN size ELSE least(64, greatest(size // 3, 1)) END AS chunk, array_to_string({_SAMPLE}, ',') AS offsets FROM files")
def sample_layout(spark, sf_dir):
    """Windows of each file."""
    f = files(spark, sf_dir)
    return f.select("file_id", "size", dedup.sample_chunk(F.col("size"), TARGET).alias("chunk"), F.concat_ws(",", dedup.sample_offsets(F.col("size"), TARGET).cast("array<string>")).alias("offsets"))


@query(f"""WITH {_STEPS}, g AS (SELECT group_key, size, count(*) AS n, count(DISTINCT object_key) + count(*) FILTER (WHERE object_key IS NULL) AS i FROM members GROUP BY ALL)
  SELECT count(*) AS groups, coalesce(sum(n), 0) AS members, coalesce(sum(CASE WHEN i > 1 THEN i - 1 ELSE 0 END), 0) AS redundant, coalesce(sum(size * greatest(i - 1, 0)), 0) AS reclaimable FROM g""")
def exact_totals(spark, sf_dir):
    """Sums over all groups."""
    g = dedup.group_measures(dedup.verified_members(files(spark, sf_dir), TARGET))
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return g.agg(F.count("*").alias("groups"), z("files").alias("members"), z(F.when(F.col("independent") > 1, F.col("independent") - 1).otherwise(0)).alias("redundant"), z("reclaimable").alias("reclaimable"))


@query(f"WITH {_STEPS}, o AS (SELECT object_key FROM members WHERE object_key IS NOT NULL GROUP BY object_key HAVING count(DISTINCT group_key) > 1) SELECT object_key FROM o")
def overlapping_objects(spark, sf_dir):
    """Objects in more than one group."""
    m = dedup.verified_members(files(spark, sf_dir), TARGET).filter("object_key IS NOT NULL")
    return m.groupBy("object_key").agg(F.countDistinct("group_key").alias("n")).filter("n > 1").select("object_key")


@query("""WITH x AS (SELECT lang, sha256(text) AS h FROM documents),
  p AS (SELECT lang, CAST('0x' || substring(h, 1, 8) AS BIGINT) AS a, CAST('0x' || substring(h, 9, 8) AS BIGINT) AS b FROM x)
  SELECT lang, count(*) AS files, bit_xor(a) AS x0, bit_xor(b) AS x1 FROM p GROUP BY lang""")
def unordered_digest(spark, sf_dir):
    """Exclusive or of digests, whatever the order."""
    h = F.sha2("text", 256)
    d = table(spark, sf_dir, "documents").select("lang", *(F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint").alias(c) for k, c in enumerate("ab")))
    return d.groupBy("lang").agg(F.count("*").alias("files"), F.bit_xor("a").alias("x0"), F.bit_xor("b").alias("x1"))


@query("""WITH b AS (SELECT source, doc_id // 1000 AS block, sha256(string_agg(sha256(text), '|' ORDER BY doc_id)) AS h, count(*) AS n FROM documents GROUP BY ALL)
  SELECT source, sha256('manifest-1|' || sum(n) || '|' || string_agg(h, '|' ORDER BY block)) AS manifest, CAST(sum(n) AS BIGINT) AS leaves FROM b GROUP BY source""")
def ordered_manifest(spark, sf_dir):
    """Digest over leaves in order of their ordinal, block by block, so that no task holds all leaves of a source."""
    d = table(spark, sf_dir, "documents").select("source", F.expr("doc_id div 1000").alias("block"), F.struct("doc_id", F.sha2("text", 256).alias("h")).alias("leaf"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x.h), "|")
    blocks = d.groupBy("source", "block").agg(F.sha2(joined("leaf"), 256).alias("h"), F.count("*").alias("n"))
    blocks = blocks.select("source", "n", F.struct("block", "h").alias("b"))
    return blocks.groupBy("source").agg(F.sha2(F.concat(F.lit("manifest-1|"), F.sum("n").cast("string"), F.lit("|"), joined("b")), 256).alias("manifest"), F.sum("n").alias("leaves"))


@query()
def compare_neighbours(spark, sf_dir):
    """Equality of two files of one size and the first character, from 0, where they differ, found by halving."""
    w = Window.partitionBy(F.octet_length("text")).orderBy("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.lead("text").over(w).alias("other"), F.lead("doc_id").over(w).alias("other_id")).filter("other IS NOT NULL")
    at = F.expr("""aggregate(sequence(0, int(ceil(log2(1 + length(text))))), named_struct('low', 0, 'high', length(text)), (s, i) -> if(s.low >= s.high, s,
      if(substring(text, s.low + 1, (s.low + s.high + 1) div 2 - s.low) = substring(other, s.low + 1, (s.low + s.high + 1) div 2 - s.low),
        named_struct('low', int((s.low + s.high + 1) div 2), 'high', s.high), named_struct('low', s.low, 'high', int((s.low + s.high + 1) div 2 - 1)))), s -> bigint(s.low))""")
    return d.select("doc_id", "other_id", (F.col("text") == F.col("other")).alias("same"), F.when(F.col("text") != F.col("other"), at).alias("first_difference"))

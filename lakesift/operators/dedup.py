"""Exact duplicates by narrowing: size, sampled digest, full digest, equal content.

``files`` has ``file_id``, ``path``, ``size`` (bytes), ``content`` (string or binary) and ``object_key`` (the identity of the
stored object, null if unknown). Each step keeps only the rows the next needs, so content is hashed for
few files. All steps are aggregations with partial sums and equi joins, which the engine can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_BYTES = 64 * 1024


def in_buckets(files: DataFrame, *keys: str) -> DataFrame:
    """Files whose ``keys`` are all known and shared with another file."""
    known = files
    for key in keys:
        known = known.filter(F.col(key).isNotNull())
    return known.join(known.groupBy(*keys).count().filter("count > 1").drop("count"), list(keys), "left_semi")


def sample_chunk(size: Column, target: int) -> Column:
    """Bytes in each window: the whole file if it isn't longer than the target, else a third, at most the target."""
    return F.when(size <= target, size).otherwise(F.least(F.lit(target), F.greatest(F.floor(size / 3), F.lit(1)))).cast("bigint")


def sample_offsets(size: Column, target: int) -> Column:
    """Starts of the windows: first, middle and last, each once."""
    chunk = sample_chunk(size, target)
    three = F.array(F.lit(0).cast("bigint"), F.floor((size - chunk) / 2).cast("bigint"), (size - chunk).cast("bigint"))
    return F.when(size <= target, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_distinct(F.array_sort(three)))


def sample_digest(content: Column, size: Column, target: int) -> Column:
    """SHA-256 over a tag, length, target and each window's offset, length and bytes (in hex)."""
    chunk = sample_chunk(size, target)
    text = F.hex(content.cast("binary"))
    windows = F.transform(sample_offsets(size, target), lambda o: F.concat_ws(":", o.cast("string"), chunk.cast("string"), F.substring(text, (2 * o + 1).cast("int"), (2 * chunk).cast("int"))))
    return F.sha2(F.concat(F.lit("sample-1|"), size.cast("string"), F.lit(f"|{target}|"), F.array_join(windows, "|")), 256)


def narrowed(files: DataFrame, target: int = SAMPLE_BYTES) -> DataFrame:
    """Files that share size, sampled digest and full digest with another.

    Sizes alone are compared first, so that content is read only of files that share one; each step carries ids and digests,
    and content is joined back by id.
    """
    same_size = in_buckets(files.select("file_id", "size"), "size").select("file_id")
    slim = files.join(same_size, "file_id", "left_semi").select("file_id", "size", sample_digest(F.col("content"), F.col("size"), target).alias("sample"))
    left = in_buckets(slim, "size", "sample").select("file_id", "sample")
    hashed = files.join(left, "file_id").withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))
    return hashed.filter("digest IS NOT NULL")


def verified_members(files: DataFrame, target: int = SAMPLE_BYTES, strict_bucket: bool = False) -> DataFrame:
    """Members of exact groups with ``group_key`` (digest) and ``representative``, content compared byte by byte.

    A bucket of one digest is split into classes of equal content, told apart by a second hash and then compared with the
    class's least file. ``strict_bucket`` gives up a bucket with more than one class as a whole.
    """
    found = narrowed(files, target).withColumn("mark", F.xxhash64("content"))
    first = found.groupBy("size", "digest", "mark").agg(F.min_by(F.struct("file_id", "content"), "file_id").alias("r"), F.count("*").alias("n"))
    members = found.join(first.filter("n > 1"), ["size", "digest", "mark"]).filter(F.col("content") == F.col("r.content"))
    if strict_bucket:
        split = first.groupBy("size", "digest").agg(F.count("*").alias("classes")).filter("classes > 1")
        members = members.join(split, ["size", "digest"], "left_anti")
    return members.select(F.col("digest").alias("group_key"), "size", "file_id", "path", "object_key", F.col("r.file_id").alias("representative"))


def group_measures(members: DataFrame) -> DataFrame:
    """Files, independent copies (distinct known objects, each unknown one counts) and the bytes that could be freed at most."""
    independent = F.countDistinct("object_key") + F.sum(F.when(F.col("object_key").isNull(), 1).otherwise(0))
    out = members.groupBy("group_key", "size", "representative").agg(F.count("*").alias("files"), independent.cast("bigint").alias("independent"))
    return out.withColumn("reclaimable", (F.col("size") * F.greatest(F.col("independent") - 1, F.lit(0))).cast("bigint"))


def class_discriminator(members: DataFrame) -> DataFrame:
    """A digest of each group's sorted paths, the same for any order of its rows."""
    paths = F.array_join(F.array_sort(F.collect_list("path")), "\n")
    return members.groupBy("group_key").agg(F.sha2(paths, 256).alias("discriminator"))


def stage_summary(files: DataFrame, target: int = SAMPLE_BYTES) -> DataFrame:
    """Files and bytes that reach each step; content is sampled only where sizes are shared, and hashed only where samples are."""
    ids = files.select("file_id", "size")
    sized = in_buckets(ids, "size")
    some = files.join(sized.select("file_id"), "file_id", "left_semi").select("file_id", "size", sample_digest(F.col("content"), F.col("size"), target).alias("sample"))
    sampled = in_buckets(some, "size", "sample")
    whole = files.join(sampled.select("file_id", "sample"), "file_id").select("file_id", "size", "sample", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    steps = {"1 listed": ids, "2 same size": sized, "3 same sample": sampled, "4 same digest": in_buckets(whole, "size", "sample", "digest")}
    out = None
    for name, df in steps.items():
        one = df.agg(F.lit(name).alias("stage"), F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))
        out = one if out is None else out.union(one)
    return out

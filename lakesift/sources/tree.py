"""Files of a tree as a table, by batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesift.functions import text as X

BINARY = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def roots_or_error(spark: SparkSession, roots: list[str]) -> list[str]:
    """Distinct roots in order; an error for one that doesn't exist, seen by the file system that Spark uses for it."""
    out = sorted(set(roots))
    for root in out:
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            raise FileNotFoundError(root)
    return out


def scan(spark: SparkSession, roots: list[str], with_content: bool = True) -> DataFrame:
    """``file_id`` (digest of the path), ``path``, ``size``, ``modified`` and ``content``; the content is only read where it's used."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots_or_error(spark, roots))
    return _columns(df, with_content)


def _columns(df: DataFrame, with_content: bool) -> DataFrame:
    names = [F.sha2("path", 256).alias("file_id"), F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lit(None).cast("string").alias("object_key")]
    return df.select(*names, *([F.col("content")] if with_content else []))


def stream(spark: SparkSession, root: str, files_per_batch: int = 64) -> DataFrame:
    """The same as ``scan``, in batches of at most ``files_per_batch``; a restart goes on from the checkpoint."""
    df = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(root)
    return _columns(df, True)


def media_files(files: DataFrame) -> DataFrame:
    return files.withColumn("media_kind", X.media_kind(F.col("path"))).filter("media_kind IS NOT NULL")


def within_depth(files: DataFrame, root: str, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """Files at most so many directories below the root, and an issue for each of the others."""
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    depth = F.size(F.split(plain(F.col("path")), "/")) - F.size(F.split(plain(F.lit(root.rstrip("/"))), "/")) - 1
    issue = files.filter(depth > most).select("path", F.lit("depth_limit").alias("code"))
    return files.filter(depth <= most), issue


def first_by_identity(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each (device, inode) once, by path, and an issue for each further one; rows without identity all stay."""
    w = Window.partitionBy("device", "inode").orderBy("path")
    n = F.when(F.col("inode").isNull(), 1).otherwise(F.row_number().over(w))
    ranked = entries.withColumn("__n", n)
    return ranked.filter("__n = 1").drop("__n"), ranked.filter("__n > 1").select("path", F.lit("identity_already_visited").alias("code"))


def same_device(entries: DataFrame, root_device: int) -> tuple[DataFrame, DataFrame]:
    ok = F.col("device").eqNullSafe(F.lit(root_device))
    return entries.filter(ok), entries.filter(~ok).select("path", F.lit("other_file_system").alias("code"))

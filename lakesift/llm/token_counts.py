"""Exact histogram of encoded lengths; suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm.bpe import codec, default_pattern, default_vocabulary, slices
from lakesift.llm.common import store


def token_lengths(docs: DataFrame, *, keep: list[str] | None = None, vocabulary: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """``keep`` (default: all other columns) and ``n_tokens``, the encoded length of each whole text.

    Null and empty texts have length 0. A text of any length is encoded whole, also one long run of white space or letters.
    Repeated rows give repeated results, an empty table none. A column ``n_tokens`` of the input is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Path(vocabulary or default_vocabulary()).read_bytes())  # a file of under 1 MB
    pattern = pattern or default_pattern()
    names = [c for c in (docs.columns if keep is None else keep) if c != "n_tokens"]
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = codec(sent.value, pattern).count
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                counts = [count(t) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(counts, pa.int64())], [*names, "n_tokens"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), "n_tokens bigint"])
    return docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def length_histogram(lengths: DataFrame, *, n_tokens: str = "n_tokens", block: int = 1024) -> DataFrame:
    """One row for each length that occurs, longest context first in its sums.

    * ``n_docs``, ``tokens``: documents of just this length, and their tokens;
    * ``docs_at_least``, ``tokens_at_least``: suffix sums over this and greater lengths;
    * ``docs_at_most``, ``tokens_at_most``, ``quantile``: the share of documents not longer than this;
    * ``truncated_tokens``: tokens left when every document is cut at this length;
    * ``total_docs``, ``total_tokens``.

    Between two lengths a < L < b of the table, a cut at L leaves ``truncated_tokens(a) + (L - a) *
    docs_at_least(b)``: see ``at_limit``. An empty table gives no rows.

    Counts are summed before the shuffle. The suffix sums go in two steps, inside blocks of ``block``
    lengths and over the blocks' totals, so no task sees more than ``block`` lengths or the list of blocks.
    """
    length = F.col(n_tokens).cast("bigint")
    counts = lengths.groupBy(length.alias("n_tokens")).agg(F.count("*").alias("n_docs")).filter("n_tokens IS NOT NULL")
    counts = counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("__block", F.expr(f"n_tokens div {int(block)}"))
    counts = store(counts)  # else the texts are encoded twice
    above = Window.orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = counts.groupBy("__block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "__block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("__docs_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("__tokens_above"),
        F.sum("d").over(every).alias("total_docs"),
        F.sum("t").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("__block").orderBy(F.desc("n_tokens"))
    out = counts.join(blocks, "__block")
    out = out.withColumn("docs_at_least", F.sum("n_docs").over(inside) + F.col("__docs_above"))
    out = out.withColumn("tokens_at_least", F.sum("tokens").over(inside) + F.col("__tokens_above"))
    shorter = F.col("total_docs") - F.col("docs_at_least")
    return out.select(
        "n_tokens",
        "n_docs",
        "tokens",
        "docs_at_least",
        "tokens_at_least",
        (shorter + F.col("n_docs")).alias("docs_at_most"),
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("tokens")).alias("tokens_at_most"),
        ((shorter + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        "total_docs",
        "total_tokens",
    )


def at_limit(histogram: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit: documents and tokens that a cut at ``limit`` leaves or shortens."""
    longer: Column = F.col("n_tokens") > F.lit(int(limit))
    return histogram.agg(
        F.lit(int(limit)).cast("bigint").alias("limit"),
        F.coalesce(F.sum(F.when(longer, F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
        F.coalesce(F.sum(F.when(longer, F.col("n_docs") * int(limit)).otherwise(F.col("tokens"))), F.lit(0)).alias("truncated_tokens"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
    )


def length_at_quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The least length that at least ``share`` of all documents do not exceed (``n_tokens``; null if none)."""
    return histogram.filter(F.col("docs_at_most") >= F.lit(float(share)) * F.col("total_docs")).agg(F.min("n_tokens").alias("n_tokens"))

import pytest
from pyspark.sql import functions as F

from lakesift.operators import lifecycle as L
from lakesift.operators.pages import Pages


def test_pages_replace():
    held = Pages(2)
    held.replace([1, 2], "a")
    for rows, cursor, message in (([1, 2, 3], "b", "limit"), ([3], "a", "advance"), ([], "c", "advance")):
        with pytest.raises(ValueError, match=message):
            held.replace(rows, cursor)
    assert (held.rows, held.cursor) == ([1, 2], "a")
    held.replace([3], None)
    assert (held.rows, held.cursor) == ([3], None)


def test_two_passes_count_repeated_rows(spark):
    one = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None)], "report int, raw string")
    two = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "x")], "report int, raw string")
    assert sorted(r.report for r in L.unequal_extractions(one, two, "report").collect()) == [1, 4]


def test_support_needs_one_scope_without_other_values(spark):
    fields = spark.createDataFrame(
        [(1, 1, "x", "dto", 5, True), (1, 1, "x", "offset", 60, True), (2, 1, "x", "dto", 5, True), (2, 1, "y", "offset", 60, True), (3, 1, "x", "dto", 5, True), (3, 1, "x", "offset", 60, False)],
        "analysis int, source int, scope string, kind string, value bigint, verified boolean",
    )
    wanted = spark.createDataFrame([(n, 5, 60, n != 4) for n in (1, 2, 3, 4)], "analysis int, wall bigint, minutes bigint, eligible boolean")
    assert sorted(r.analysis for r in L.unsupported_candidates(wanted, fields).collect()) == [2, 3]


def test_manifest_depends_on_order_and_crosses_chunks(spark):
    rows = spark.range(3000).select(F.lit("s").alias("scope"), "id")
    made = lambda leaf: L.manifests(rows, ["scope"], "id", leaf.cast("string")).first()
    assert made(F.col("id")).leaves == 3000
    assert made(F.col("id")).manifest != made(F.lit(2999) - F.col("id")).manifest

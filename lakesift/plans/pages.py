"""Queries on keyset pages. A limit is what a page is. Survey rows C15, C17, A27, A28, E15, E17, G1-G22."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakesift.operators import pages as P
from lakesift.registry import query, table


@query("SELECT doc_id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 33")
def page_one_key(spark, sf_dir):
    """G1, G11, G18."""
    return P.page(table(spark, sf_dir, "documents").select("doc_id", "source"), [("doc_id", True)], 32, (100,))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey > 50 OR (l_orderkey = 50 AND l_linenumber > 2) ORDER BY 1, 2, 3 LIMIT 65")
def page_two_keys(spark, sf_dir):
    """G2, G10, G12, G17."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").filter(P.after([("l_orderkey", True), ("l_linenumber", True)], (50, 2)))
    return P.page(d, [("l_orderkey", True), ("l_linenumber", True), ("l_partkey", True)], 64)


@query("SELECT strlen(text) AS bytes, doc_id FROM documents WHERE strlen(text) < 5000 OR (strlen(text) = 5000 AND doc_id > 7) ORDER BY 1 DESC, 2 LIMIT 17")
def page_mixed_direction(spark, sf_dir):
    """Largest first, then by id."""
    d = table(spark, sf_dir, "documents").select(F.octet_length("text").cast("bigint").alias("bytes"), "doc_id")
    return P.page(d, [("bytes", False), ("doc_id", True)], 16, (5000, 7))


@query("SELECT epoch_us(o_orderdate) // 1000000 AS finished, o_orderkey FROM orders ORDER BY 1 DESC, 2 DESC LIMIT 65")
def page_newest_first(spark, sf_dir):
    """History, newest first."""
    from lakesift.functions import time as M

    return P.page(table(spark, sf_dir, "orders").select(M.seconds("o_orderdate").alias("finished"), "o_orderkey"), [("finished", False), ("o_orderkey", False)], 64, kind="history")


@query("SELECT n_regionkey, n_name, n_nationkey FROM nation WHERE n_regionkey > 1 OR (n_regionkey = 1 AND (n_name > 'NATION_1' OR (n_name = 'NATION_1' AND n_nationkey > 3))) ORDER BY 1, 2, 3 LIMIT 9")
def page_three_keys(spark, sf_dir):
    """G5."""
    return P.page(table(spark, sf_dir, "nation").select("n_regionkey", "n_name", "n_nationkey"), [("n_regionkey", True), ("n_name", True), ("n_nationkey", True)], 8, (1, "NATION_1", 3))


@query("SELECT coalesce(sum(strlen(url) + strlen(html)), 0)::BIGINT AS bytes, coalesce(sum(strlen(url) + strlen(html)), 0) <= 16777216 AS fits FROM (SELECT * FROM pages ORDER BY page_id LIMIT 65)")
def page_byte_budget(spark, sf_dir):
    """Bytes of a page before it is read."""
    return P.page_bytes(P.page(table(spark, sf_dir, "pages"), [("page_id", True)], 64), "url", "html")


@query("SELECT sum(6 * strlen(text) + 6 * strlen(role) + 64)::BIGINT AS bytes, count(*) + 1 AS records, sum(6 * strlen(text) + 6 * strlen(role) + 64) <= 268435456 AND count(*) + 1 <= 250000 AS allowed FROM conversations")
def export_preflight(spark, sf_dir):
    """A bound of an export's bytes before it starts."""
    size = F.sum(6 * F.octet_length("text") + 6 * F.octet_length("role") + 64).cast("bigint")
    return table(spark, sf_dir, "conversations").agg(size.alias("bytes"), (F.count("*") + 1).alias("records"), ((size <= 268435456) & (F.count("*") + 1 <= 250000)).alias("allowed"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey > 20 ORDER BY o_orderkey LIMIT 33")
def active_runs(spark, sf_dir):
    """Runs in an active state, by key."""
    return P.page(table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", "o_custkey"), [("o_orderkey", True)], 32, (20,))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, sf_dir):
    """One row by key; the filter reaches the scan."""
    return table(spark, sf_dir, "orders").filter("o_orderkey = 7").select("o_orderkey", "o_orderstatus")


@query("SELECT event_id, CASE WHEN strlen(props) <= 20 THEN props END AS props, strlen(props) > 20 AS too_long FROM events")
def capped_document(spark, sf_dir):
    """JSON only if it is within a byte cap."""
    n = F.octet_length("props")
    return table(spark, sf_dir, "events").select("event_id", F.when(n <= 20, F.col("props")).alias("props"), (n > 20).alias("too_long"))

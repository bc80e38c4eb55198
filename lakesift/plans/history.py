"""Queries on the history catalogue and export records. Survey rows A29, B7-B11, C16-C20, E11-E17, E37, G21, H2, I38, I51."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakesift.functions import time as M
from lakesift.operators import history as H
from lakesift.registry import query, table

_RUNS = """runs AS (SELECT o_orderkey AS run, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'running' END AS state, epoch_us(o_orderdate) // 1000000 AS started, CASE WHEN o_orderkey % 9 <> 0 THEN epoch_us(o_orderdate) // 1000000 + o_orderkey % 500 END AS finished,
  ['complete', 'partial', 'interrupted'][1 + o_orderkey % 3] AS coverage FROM orders), ok AS (SELECT * FROM runs WHERE state = 'completed' AND coverage IN ('complete', 'partial') AND finished IS NOT NULL AND run IN (SELECT l_orderkey FROM lineitem))"""


def _eligible(spark, sf_dir):
    k = F.col("o_orderkey")
    started = M.seconds("o_orderdate")
    runs = table(spark, sf_dir, "orders").select(k.alias("run"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("state"), started.alias("started"), F.when(k % 9 != 0, started + k % 500).alias("finished"), F.expr("get(array('complete', 'partial', 'interrupted'), int(o_orderkey % 3))").alias("coverage"))
    return H.eligible(runs, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run")))


@query(f"WITH {_RUNS} SELECT run, coverage, finished - started AS duration FROM ok")
def history_catalogue(spark, sf_dir):
    """Runs that enter the history."""
    return _eligible(spark, sf_dir).select("run", "coverage", "duration")


@query(f"""WITH {_RUNS}, m AS (SELECT l_orderkey AS run, count(DISTINCT l_suppkey) AS groups, count(*) AS members, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS redundant FROM lineitem GROUP BY 1),
  i AS (SELECT event_id % 1000 AS run, count(*) AS issues, count(*) FILTER (WHERE event_id % 2 = 0) AS unresolved FROM events GROUP BY 1), t AS (SELECT ok.run, finished - started AS duration, coalesce(groups, 0) AS groups, coalesce(members, 0) AS members, coalesce(redundant, 0) AS redundant, coalesce(issues, 0) AS issues, coalesce(unresolved, 0) AS unresolved FROM ok LEFT JOIN m USING (run) LEFT JOIN i USING (run))
  SELECT *, duration >= 0 AND least(groups, members, redundant, issues, unresolved) >= 0 AND unresolved <= issues AND redundant <= members AS valid FROM t""")
def history_summary(spark, sf_dir):
    """Each run's totals, and whether they are consistent."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.countDistinct("l_suppkey").alias("groups"), F.count("*").alias("members"), F.count_if(F.col("l_returnflag") == "R").alias("redundant"))
    i = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 1000).alias("run")).agg(F.count("*").alias("issues"), F.count_if(F.col("event_id") % 2 == 0).alias("unresolved"))
    t = _eligible(spark, sf_dir).select("run", "duration").join(m, "run", "left").join(i, "run", "left")
    t = t.select("run", "duration", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("groups", "members", "redundant", "issues", "unresolved")))
    return t.withColumn("valid", H.valid_row())


@query("""WITH g AS (SELECT o_orderkey FROM orders WHERE o_custkey = 1), u AS (SELECT 0 AS rank, 'summary' AS section, '' AS k, '{"groups":"' || (SELECT count(*) FROM g) || '"}' AS record
  UNION ALL SELECT 1, 'group', lpad(o_orderkey::VARCHAR, 20, '0'), '{"o_orderkey":"' || o_orderkey || '"}' FROM g
  UNION ALL SELECT 2, 'member', lpad(l_orderkey::VARCHAR, 20, '0') || '/' || lpad(l_linenumber::VARCHAR, 20, '0') || '/' || lpad(l_partkey::VARCHAR, 20, '0'), '{"l_orderkey":"' || l_orderkey || '","l_linenumber":"' || l_linenumber || '","l_partkey":"' || l_partkey || '"}' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM g)
  UNION ALL SELECT 3, 'issue', lpad(event_id::VARCHAR, 20, '0'), '{"event_id":"' || event_id || '"}' FROM events WHERE user_id = 1) SELECT section, k, record FROM u""")
def export_records(spark, sf_dir):
    """One run's sections as ordered JSON records, integers as text."""
    g = table(spark, sf_dir, "orders").filter("o_custkey = 1").select("o_orderkey")
    parts = {
        "summary": g.agg(F.count("*").alias("groups")),
        "group": g,
        "member": table(spark, sf_dir, "lineitem").join(g, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey"),
        "issue": table(spark, sf_dir, "events").filter("user_id = 1").select("event_id"),
    }
    keys = {"summary": [], "group": ["o_orderkey"], "member": ["l_orderkey", "l_linenumber", "l_partkey"], "issue": ["event_id"]}
    return H.records(parts, keys).select("section", "k", "record")


@query("""SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' AS document, c_name AS back FROM customer""")
def document_round_trip(spark, sf_dir):
    """A document written as JSON and read back."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct("c_custkey", "c_name")).alias("document"))
    return c.select("c_custkey", "document", F.from_json("document", "c_custkey bigint, c_name string").getField("c_name").alias("back"))


@query("SELECT count(*) AS records, bit_xor(CAST('0x' || substring(sha256(c_custkey || '|' || c_name), 1, 8) AS BIGINT)) AS mark FROM customer")
def backup_digest(spark, sf_dir):
    """Count and digest by which a copy is compared with its source."""
    h = F.conv(F.substring(F.sha2(F.concat(F.col("c_custkey").cast("string"), F.lit("|"), "c_name"), 256), 1, 8), 16, 10).cast("bigint")
    return table(spark, sf_dir, "customer").agg(F.count("*").alias("records"), F.bit_xor(h).alias("mark"))

"""Queries on validators and state machines. Survey rows B13, B14, C11-C14, C16, C20-C24, C28, D27, D28, D30-D32, K1-K14, N1-N25 (as appends)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakesift.operators import validators as V
from lakesift.registry import query, table

_STATES = "['queued', 'running', 'paused', 'running', 'completed', 'failed', 'cancelled']"
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, b in V.JOB_EDGES)


def _versions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("version"), F.expr("get(array" + _STATES.replace("[", "(").replace("]", ")") + ", int((event_id * 7 + user_id) % 7))").alias("state"))
    return e


@query(f"""WITH v AS (SELECT user_id AS entity, event_id AS version, {_STATES}[1 + (event_id * 7 + user_id) % 7] AS state FROM events),
  s AS (SELECT *, lag(state) OVER w AS f, lag(version) OVER w AS b FROM v WINDOW w AS (PARTITION BY entity ORDER BY version))
  SELECT entity, version, state FROM s WHERE f IS NOT NULL AND ((f, state) NOT IN ({_ALLOWED}) OR version <> b + 1)""")
def illegal_state_steps(spark, sf_dir):
    """Steps that no edge allows, or versions that jump."""
    return V.illegal_steps(_versions(spark, sf_dir), V.JOB_EDGES).select("entity", "version", "state")


@query("""WITH s AS (SELECT o_custkey AS run, ['enumeration', 'sampling', 'full_hash', 'exact'][1 + o_orderkey % 4] AS stage, o_orderkey AS "at", 1 + o_orderkey % 4 AS rk FROM orders),
  w AS (SELECT *, coalesce(lag(rk) OVER (PARTITION BY run ORDER BY s."at", rk), 0) AS before FROM s) SELECT run, stage, "at" FROM w WHERE rk <> before + 1""")
def stage_order_violations(spark, sf_dir):
    """Stages sealed out of order."""
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.expr("get(array('enumeration', 'sampling', 'full_hash', 'exact'), int(o_orderkey % 4))").alias("stage"), F.col("o_orderkey").alias("at"))
    return V.stage_order(s).select("run", "stage", "at")


@query("""WITH r AS (SELECT user_id AS run, event_id AS sequence, CASE WHEN event_id % 97 = 0 THEN 'cancel' WHEN event_id % 2 = 0 THEN 'pause' ELSE 'resume' END AS kind FROM events)
  SELECT run, CASE WHEN bool_or(kind = 'cancel') THEN 'cancel' ELSE arg_max(kind, sequence) END AS outcome, max(sequence) AS sequence FROM r GROUP BY run""")
def control_outcomes(spark, sf_dir):
    """K7, K8: a cancel dominates; else the latest request holds."""
    e = F.col("event_id")
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), e.alias("sequence"), F.when(e % 97 == 0, "cancel").when(e % 2 == 0, "pause").otherwise("resume").alias("kind"))
    return V.control_outcome(r)


@query("""WITH r AS (SELECT o_orderkey AS run, ['running', 'paused', 'completed', 'queued'][1 + o_orderkey % 4] AS state, o_orderkey % 3 = 0 AS cancel_requested, 1 AS version, o_orderkey % 5 = 0 AS live FROM orders)
  SELECT run, CASE WHEN NOT live AND state <> 'completed' THEN CASE WHEN cancel_requested THEN 'cancelled' ELSE 'interrupted' END ELSE state END AS state, version + CASE WHEN NOT live AND state <> 'completed' THEN 1 ELSE 0 END AS version FROM r""")
def reconciled_runs(spark, sf_dir):
    """New versions of runs whose session is gone; nothing is changed in place."""
    o = table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_orderkey").alias("run"), F.expr("get(array('running', 'paused', 'completed', 'queued'), int(o_orderkey % 4))").alias("state"), (F.col("o_orderkey") % 3 == 0).alias("cancel_requested"), F.lit(1).alias("version"))
    return V.reconciled(runs, o.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("run")))


@query("""SELECT 'lineitem-orders' AS rule, CAST(l_orderkey AS VARCHAR) AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'labels-documents', CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'price-range', CAST(o_orderkey AS VARCHAR) FROM orders WHERE NOT (o_totalprice < 400000) UNION ALL SELECT 'one-line', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
  UNION ALL SELECT 'status', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus NOT IN ('O', 'F') """)
def violation_report(spark, sf_dir):
    """Declared keys, domains and unique rows, with what breaks them."""
    names = ("lineitem", "orders", "labels", "documents")
    tables = {n: table(spark, sf_dir, n) for n in names}
    rules = [
        V.Rule("lineitem-orders", lambda t: V.orphans(t["lineitem"], "l_orderkey", t["orders"], "o_orderkey"), "l_orderkey"),
        V.Rule("labels-documents", lambda t: V.orphans(t["labels"], "doc_id", t["documents"], "doc_id"), "doc_id"),
        V.Rule("price-range", lambda t: V.broken(t["orders"], F.col("o_totalprice") < 400000), "o_orderkey"),
        V.Rule("one-line", lambda t: V.repeated(t["lineitem"], "l_orderkey", "l_linenumber", where=F.col("l_returnflag") == "R"), "l_orderkey"),
        V.Rule("status", lambda t: V.broken(t["orders"], F.col("o_orderstatus").isin("O", "F")), "o_orderkey"),
    ]
    return V.report(rules, tables)


@query("SELECT user_id, bool_or(event_type IN ('error', 'click')) AS partial FROM events GROUP BY user_id")
def partial_reports(spark, sf_dir):
    """C11: a report is partial if one of its issues is of a kind that loses files."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type").isin("error", "click")).alias("partial"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def guarded_scope(spark, sf_dir):
    """Rows that several guards admit."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").filter("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return o.join(table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT s.o_orderkey FROM orders s WHERE s.o_orderpriority LIKE '1%' AND NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_orderkey = s.o_orderkey AND d.l_linestatus = 'O')")
def missing_dependency(spark, sf_dir):
    """Selected rows without the dependency they need."""
    d = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'")
    return table(spark, sf_dir, "orders").filter("o_orderpriority LIKE '1%'").join(d, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("""SELECT l_orderkey, sum(l_quantity)::BIGINT AS used, count(*) AS fields, sum(l_quantity) <= 150 AND count(*) <= 6 AS within FROM lineitem GROUP BY l_orderkey""")
def extraction_accounting(spark, sf_dir):
    """What an extraction used against its limits."""
    used, n = F.sum("l_quantity").cast("bigint"), F.count("*")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(used.alias("used"), n.alias("fields"), ((used <= 150) & (n <= 6)).alias("within"))


@query("""SELECT o_orderstatus AS namespace, o_custkey % 100 AS volume, min(o_orderkey) AS first_run, count(*) AS runs FROM orders GROUP BY ALL""")
def backfill_namespaces(spark, sf_dir):
    """Rows of a new table derived from an old one."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("namespace"), (F.col("o_custkey") % 100).alias("volume")).agg(F.min("o_orderkey").alias("first_run"), F.count("*").alias("runs"))


@query("""WITH d AS (SELECT conv_id, count(*) AS found, max(turn) + 1 AS expected FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN found = expected THEN 'complete' ELSE 'partial' END AS coverage FROM d""")
def coverage_outcome(spark, sf_dir):
    """Complete only if all that was announced was seen."""
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("found"), (F.max("turn") + 1).alias("expected"))
    return d.select("conv_id", F.when(F.col("found") == F.col("expected"), "complete").otherwise("partial").alias("coverage"))

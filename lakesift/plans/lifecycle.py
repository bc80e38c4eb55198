"""Queries on closing drafts, seals, leases, attempts and manifests. Survey rows E18-E20, E36, E40, E41, J14, J18, J20, K4, K8-K10, L4."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakesift.operators import lifecycle as L
from lakesift.registry import query, table


def _day(c):
    return F.unix_date(F.to_date(c)).cast("bigint")


@query("""WITH f AS (SELECT l_orderkey AS report, l_linenumber AS ordinal, l_partkey AS raw FROM lineitem), s AS (SELECT report, ordinal, CASE WHEN report % 50 = 0 THEN raw + 1 ELSE raw END AS raw FROM f WHERE NOT (report % 70 = 1 AND ordinal = 1)),
  b AS (SELECT *, 1 AS n FROM f UNION ALL SELECT *, -1 FROM s) SELECT DISTINCT report FROM (SELECT report FROM b GROUP BY report, ordinal, raw HAVING sum(n) <> 0)""")
def double_extraction(spark, sf_dir):
    """Reports whose second pass isn't the first's; planted changes and lost rows."""
    first = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("raw"))
    second = first.filter("NOT (report % 70 = 1 AND ordinal = 1)").withColumn("raw", F.when(F.col("report") % 50 == 0, F.col("raw") + 1).otherwise(F.col("raw")))
    return L.unequal_extractions(first, second, "report")


@query("""WITH b AS (SELECT o_orderkey AS k, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS wall, 60 * (o_orderkey % 5) AS minutes FROM orders),
  f AS (SELECT k, 'ifd0' AS scope, 'dto' AS kind, wall AS v, k % 7 <> 0 AS ok FROM b UNION ALL SELECT k, CASE WHEN k % 9 = 0 THEN 'exif' ELSE 'ifd0' END, 'offset', minutes, true FROM b UNION ALL SELECT k, 'ifd0', 'offset', minutes + 1, true FROM b WHERE k % 11 = 0)
  SELECT k AS analysis, wall, minutes FROM b WHERE k % 2 = 0 AND NOT EXISTS (SELECT 1 FROM f x JOIN f y ON x.k = y.k AND x.scope = y.scope WHERE x.k = b.k AND x.kind = 'dto' AND y.kind = 'offset' AND x.v = b.wall AND y.v = b.minutes
    AND NOT EXISTS (SELECT 1 FROM f z WHERE z.k = x.k AND z.scope = x.scope AND (NOT z.ok OR (z.kind = 'dto' AND z.v <> x.v) OR (z.kind = 'offset' AND z.v <> y.v))))""")
def candidate_support(spark, sf_dir):
    """Eligible candidates without verified, unequivocal fields in one scope; companions in another scope prove nothing."""
    k = F.col("o_orderkey")
    b = table(spark, sf_dir, "orders").select(k.alias("analysis"), _day("o_orderdate").alias("wall"), (60 * (k % 5)).alias("minutes"))
    a = F.col("analysis")

    def rows(scope, kind, value, verified):
        return F.struct(F.lit(1).alias("source"), scope.alias("scope"), F.lit(kind).alias("kind"), value.cast("bigint").alias("value"), verified.alias("verified"))

    true, here = F.lit(True), F.lit("ifd0")
    made = F.array(rows(here, "dto", F.col("wall"), a % 7 != 0), rows(F.when(a % 9 == 0, "exif").otherwise("ifd0"), "offset", F.col("minutes"), true), F.when(a % 11 == 0, rows(here, "offset", F.col("minutes") + 1, true)))
    fields = b.select("analysis", F.explode(F.array_compact(made)).alias("x")).select("analysis", "x.*")
    return L.unsupported_candidates(b.withColumn("eligible", a % 2 == 0), fields).select("analysis", "wall", "minutes")


_JSON = """CASE WHEN o_orderkey % 19 = 0 THEN '{}' WHEN o_orderkey % 10 = 0 THEN '[' || (o_custkey + 1) || ',' || o_custkey || ']' WHEN o_orderkey % 13 = 0 THEN '[' || o_custkey || ',' || o_custkey || ']' WHEN o_orderkey % 17 = 0 THEN '[' || o_custkey || ', ' || (o_custkey + 1) || ']'
  ELSE '[' || o_custkey || ',' || (o_custkey + 1) || ']' END"""


@query(f"""WITH j AS (SELECT o_orderkey, {_JSON} AS t FROM orders), p AS (SELECT o_orderkey, t, CASE WHEN t <> '{{}}' THEN CAST(t AS BIGINT[]) END AS ids FROM j)
  SELECT o_orderkey, CASE WHEN ids IS NULL THEN 'no_array' ELSE 'not_canonical' END AS problem FROM p WHERE ids IS NULL OR t <> '[' || array_to_string(list_sort(list_distinct(ids)), ',') || ']'
  UNION ALL SELECT DISTINCT o_orderkey, 'dangling' FROM (SELECT o_orderkey, unnest(ids) AS i FROM p) WHERE i NOT IN (SELECT c_custkey FROM customer)""")
def json_evidence(spark, sf_dir):
    """Stored arrays of references that aren't canonical or don't resolve."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_JSON).alias("t"))
    return L.evidence_arrays(rows, "o_orderkey", "t", table(spark, sf_dir, "customer"), "c_custkey")


@query("""WITH m AS (SELECT l_orderkey AS k, count(*) AS m, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS a, max(l_linenumber) AS z, count(*) FILTER (WHERE l_linenumber > 1 AND l_returnflag <> 'R') AS e FROM lineitem GROUP BY l_orderkey),
  r AS (SELECT o_orderkey AS build, 1 + o_orderkey % 4 AS expected, coalesce(m, 0) AS n, d, a, z, coalesce(e, 0) AS e FROM orders LEFT JOIN m ON k = o_orderkey WHERE o_orderstatus = 'F'),
  c AS (SELECT build, concat_ws(',', CASE WHEN n <> expected THEN 'members' END, CASE WHEN n < 2 THEN 'too_few' END, CASE WHEN a <> 1 OR z <> n OR d <> n THEN 'ordinals' END, CASE WHEN e <> greatest(n - 1, 0) THEN 'edges' END) AS codes FROM r)
  SELECT build, codes FROM c WHERE codes <> ''""")
def build_lifecycle(spark, sf_dir):
    """K4: builds closed as verified whose evidence isn't complete."""
    lines = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "build", "l_linenumber": "ordinal"})
    builds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("build"), F.when(F.col("o_orderstatus") == "F", "verified").otherwise("draft").alias("state"), (1 + F.col("o_orderkey") % 4).alias("expected"))
    return L.incomplete_builds(builds, lines, lines.filter("ordinal > 1 AND l_returnflag != 'R'"))


@query("""WITH r AS (SELECT user_id AS run, event_type AS stage, event_id AS bytes FROM events), a AS (SELECT run, stage, count(*) AS items, sum(bytes)::BIGINT AS bytes FROM r WHERE run % 20 <> 1 GROUP BY ALL),
  s AS (SELECT run, stage, count(*) AS sealed_items, sum(bytes)::BIGINT AS sealed_bytes FROM r WHERE bytes % 10 <> 0 GROUP BY ALL)
  SELECT run, stage, sealed_items::BIGINT AS sealed_items, sealed_bytes, items::BIGINT AS items, bytes FROM a FULL JOIN s USING (run, stage) WHERE sealed_items IS DISTINCT FROM items OR sealed_bytes IS DISTINCT FROM bytes""")
def seal_totals(spark, sf_dir):
    """Sealed totals against the rows; some rows came after the seal, some runs lost theirs."""
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), F.col("event_id").cast("bigint").alias("bytes"))
    seals = r.filter("bytes % 10 != 0").groupBy("run", "stage").agg(F.count("*").alias("items"), F.sum("bytes").alias("bytes"))
    return L.seal_totals(seals, r.filter("run % 20 != 1"))


@query("""SELECT o_custkey AS session, count(*) FILTER (WHERE o_orderstatus = 'F') AS evidence, count(*) FILTER (WHERE o_orderstatus = 'O') AS unavailable, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS failed, count(*) AS total,
  sum(o_orderkey % 1000) <= 4000 AND sum(o_orderkey % 900) <= 4000 AS within FROM orders GROUP BY o_custkey""")
def session_budgets(spark, sf_dir):
    """Outcomes of a session by kind, and its two passes against half the read budget each."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    kind = F.when(s == "F", "evidence").when(s == "O", "unavailable").otherwise("failed")
    return L.session_budgets(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), kind.alias("outcome"), (k % 1000).alias("first"), (k % 900).alias("second")), 8000)


_CHILDREN = ("sources", "observations", "candidates", "issues", "members", "recommendations")


@query(f"""WITH c AS (SELECT l_orderkey AS k, max(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS last, {", ".join(f"count(*) FILTER (WHERE l_linenumber = {i}) AS c{i}" for i in range(1, 7))} FROM lineitem WHERE l_linenumber <= 6 GROUP BY l_orderkey),
  r AS (SELECT o_orderkey AS analysis, concat_ws(',', {", ".join(f"CASE WHEN coalesce(c{i}, 0) <> CASE WHEN o_orderkey % 7 >= {i} THEN 1 ELSE 0 END THEN '{n}' END" for i, n in enumerate(_CHILDREN, 1))}, CASE WHEN date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 90 < last THEN 'too_early' END) AS codes
    FROM orders LEFT JOIN c ON k = o_orderkey) SELECT analysis, codes FROM r WHERE codes <> ''""")
def analysis_seals(spark, sf_dir):
    """Six declared counts of children against the rows, and a seal not earlier than any child."""
    k = F.col("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("analysis"), _day("l_shipdate").alias("at"), "l_linenumber")
    children = {n: lines.filter(F.col("l_linenumber") == i) for i, n in enumerate(_CHILDREN, 1)}
    seals = table(spark, sf_dir, "orders").select(k.alias("analysis"), (_day("o_orderdate") + 90).alias("at"), *(F.when(k % 7 >= i, 1).otherwise(0).alias(f"n_{n}") for i, n in enumerate(_CHILDREN, 1)))
    return L.child_contradictions(seals, children)


@query("""WITH l AS (SELECT o_custkey AS run, o_orderkey AS version, o_orderkey % 3 AS session, CASE WHEN o_orderkey % 4 < 2 THEN 'held' ELSE 'released' END AS state FROM orders),
  v AS (SELECT *, lag(version) OVER w AS pv, lag(session) OVER w AS ps, coalesce(lag(state) OVER w = 'held', false) AS held FROM l WINDOW w AS (PARTITION BY run ORDER BY version)),
  c AS (SELECT run, version, concat_ws(',', CASE WHEN version <> pv + 1 THEN 'generation' END, CASE WHEN held AND state = 'held' AND session <> ps THEN 'held_by_other' END, CASE WHEN held AND state = 'released' AND session <> ps THEN 'foreign_release' END,
    CASE WHEN NOT held AND state = 'released' THEN 'nothing_held' END) AS codes FROM v) SELECT run, version, codes FROM c WHERE codes <> ''""")
def lease_violations(spark, sf_dir):
    """K8: generations that jump, leases taken from a holder, releases by others."""
    k = F.col("o_orderkey")
    return L.lease_violations(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), k.alias("version"), (k % 3).alias("session"), F.when(k % 4 < 2, "held").otherwise("released").alias("state")))


@query("""WITH v AS (SELECT o_custkey AS run, o_orderkey AS version, o_orderkey // 10 AS items, o_orderkey % 100 AS bytes FROM orders), s AS (SELECT *, lag(items) OVER w AS i, lag(bytes) OVER w AS b FROM v WINDOW w AS (PARTITION BY run ORDER BY version))
  SELECT run, version, items, bytes FROM s WHERE items < i OR bytes < b""")
def checkpoint_violations(spark, sf_dir):
    """K8: checkpoints whose counters fall."""
    k = F.col("o_orderkey")
    return L.checkpoint_violations(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), k.alias("version"), F.expr("o_orderkey div 10").alias("items"), (k % 100).alias("bytes")))


@query("""WITH a AS (SELECT o_orderkey AS attempt, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey - o_orderkey % 5 END AS parent, CASE WHEN o_orderkey % 8 = 0 THEN 'quick' ELSE 'full' END AS mode, o_custkey % 2 AS scope,
    ['completed', 'failed', 'running', 'cancelled'][1 + o_orderkey % 4] AS state, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders),
  c AS (SELECT a.attempt, concat_ws(',', CASE WHEN p.attempt IS NULL THEN 'no_parent' END, CASE WHEN p.state NOT IN ('completed', 'failed', 'cancelled') THEN 'parent_open' END, CASE WHEN a.mode <> 'full' THEN 'not_full' END, CASE WHEN a.scope <> p.scope THEN 'other_scope' END,
    CASE WHEN a.day < p.day THEN 'before_parent' END) AS codes FROM a LEFT JOIN a p ON p.attempt = a.parent WHERE a.parent IS NOT NULL) SELECT attempt, codes FROM c WHERE codes <> ''""")
def attempt_lineage(spark, sf_dir):
    """K9: attempts whose parent is missing, open, of another scope or later, or that aren't full."""
    k = F.col("o_orderkey")
    state = F.get(F.array(*map(F.lit, ("completed", "failed", "running", "cancelled"))), (k % 4).cast("int"))
    return L.attempt_violations(table(spark, sf_dir, "orders").select(
        k.alias("attempt"), F.when(k % 3 != 0, k - k % 5).alias("parent"), F.when(k % 8 == 0, "quick").otherwise("full").alias("mode"), (F.col("o_custkey") % 2).alias("scope"), state.alias("state"), _day("o_orderdate").alias("at"),
    ))


@query("""WITH b AS (SELECT o_orderkey AS entity, 1 AS version, 1 AS c, 0 AS e FROM orders WHERE o_orderkey % 6 <> 0 UNION ALL SELECT l_orderkey, 1, 0, 1 FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT entity, version, sum(c) AS c, sum(e) AS e FROM b GROUP BY ALL)
  SELECT entity, version, CASE WHEN c = 0 THEN 'no_change' WHEN e = 0 THEN 'no_event' ELSE 'repeated' END AS gap FROM n WHERE c <> 1 OR e <> 1""")
def audit_gaps(spark, sf_dir):
    """Changes without just one event, events without a change."""
    changes = table(spark, sf_dir, "orders").filter("o_orderkey % 6 != 0").select(F.col("o_orderkey").alias("entity"), F.lit(1).alias("version"))
    events = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("entity"), F.lit(1).alias("version"))
    return L.audit_gaps(changes, events, "entity", "version")


def _tree(rows: str, keys: str) -> str:
    return f"""WITH r AS ({rows}), a AS (SELECT {keys}, o // 1048576 AS h, o // 1024 AS l, count(*) AS n, sha256(string_agg(sha256(leaf), ',' ORDER BY o, sha256(leaf))) AS d FROM r GROUP BY ALL),
  b AS (SELECT {keys}, h, sum(n) AS n, sha256(string_agg(d, ',' ORDER BY l)) AS d FROM a GROUP BY ALL) SELECT {keys}, sum(n)::BIGINT AS leaves, sha256(string_agg(d, ',' ORDER BY h)) AS manifest FROM b GROUP BY ALL"""


@query(_tree("SELECT o_custkey % 25 AS volume, o_orderstatus AS scope, o_orderkey AS o, o_custkey % 25 || '|' || o_orderstatus || '|' || o_orderkey || '|' || o_orderpriority AS leaf FROM orders", "volume, scope"))
def volume_manifests(spark, sf_dir):
    """Ordered digest of the directories of a volume's scope, each with its mount and scope."""
    rows = table(spark, sf_dir, "orders").withColumns({"volume": F.col("o_custkey") % 25, "scope": F.col("o_orderstatus")})
    return L.manifests(rows, ["volume", "scope"], "o_orderkey", F.concat_ws("|", F.col("volume").cast("string"), "scope", F.col("o_orderkey").cast("string"), "o_orderpriority"))


@query(_tree("SELECT source AS scope, doc_id AS o, doc_id || '|' || sha256(coalesce(text, '')) AS leaf FROM documents WHERE doc_id % 3 <> 0", "scope"))
def frozen_scopes(spark, sf_dir):
    """Count and manifest of the verified groups of a scope."""
    rows = table(spark, sf_dir, "documents").filter("doc_id % 3 != 0").withColumnRenamed("source", "scope")
    return L.manifests(rows, ["scope"], "doc_id", F.concat_ws("|", F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256)))


@query("""WITH t AS (SELECT o_custkey AS run, o_orderkey AS directory, 1 + o_orderkey % 4 AS entries FROM orders), f AS (SELECT l_orderkey AS directory, count(*) AS now FROM lineitem WHERE l_orderkey % 9 <> 0 GROUP BY l_orderkey),
  x AS (SELECT run, directory, CASE WHEN now IS NULL THEN 'missing' WHEN now <> entries THEN 'changed' ELSE 'verified' END AS own FROM t LEFT JOIN f USING (directory))
  SELECT run, directory, CASE WHEN directory > min(directory) FILTER (WHERE own <> 'verified') OVER (PARTITION BY run) THEN 'not_reached' ELSE own END AS outcome FROM x""")
def directory_replay(spark, sf_dir):
    """L4: directories replayed in strict order up to the first that changed."""
    tickets = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("directory"), (1 + F.col("o_orderkey") % 4).alias("entries"))
    now = table(spark, sf_dir, "lineitem").filter("l_orderkey % 9 != 0").groupBy(F.col("l_orderkey").alias("directory")).agg(F.count("*").alias("entries"))
    return L.replay(tickets, tickets.select("run", "directory").join(now, "directory"))

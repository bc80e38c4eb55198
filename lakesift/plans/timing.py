"""Queries on capture-time evidence. Orders stand for analyses; fields are derived from them. Survey rows D24, E23-E30, I30, J1-J12, J15-J17, J19."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakesift.functions import time as M
from lakesift.operators import timepolicy as P
from lakesift.registry import query, table

_FIELDS = r"""base AS (SELECT o_orderkey AS analysis, epoch_us(o_orderdate) // 1000000 AS t, o_orderkey % 4 AS r, o_orderkey % 11 AS d, o_orderkey % 6 = 0 AS floating, o_orderkey % 7 <> 0 AS verified FROM orders),
fields AS (
  SELECT analysis, 1 AS source, 'a' AS lineage, 'dto' AS kind, t AS wall, CASE WHEN floating THEN NULL ELSE 120 END AS minutes, verified FROM base
  UNION ALL SELECT analysis, 2, 'b', 'dto', t + CASE r WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3600 ELSE 5000 END, CASE WHEN floating THEN NULL ELSE 120 END, verified FROM base WHERE d < 6
  UNION ALL SELECT analysis, 1, 'a', 'create', t + 10, NULL, verified FROM base WHERE d > 3),
atoms AS (SELECT *, wall - 60 * minutes AS instant, CASE WHEN kind = 'dto' THEN CASE WHEN minutes IS NULL THEN 'medium' ELSE 'high' END ELSE 'low' END AS confidence, kind = 'dto' AS strong FROM fields)"""


def _analyses(spark, sf_dir):
    """Narrow rows are dealt, not the fields made from them."""
    return P.dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("analysis"), "o_orderdate"))


def fields(spark, sf_dir):
    """Evidence of two sources: original times with offsets in their scope, some far apart, and creation times."""
    k = F.col("analysis")
    base = _analyses(spark, sf_dir).select(k, F.col("o_orderdate").alias("t"), (k % 4).alias("r"), (k % 11).alias("d"), (k % 6 == 0).alias("floating"), (k % 7 != 0).alias("verified"))

    text = lambda c: F.date_format(c, "yyyy:MM:dd HH:mm:ss")
    shift = F.expr("t + make_interval(0, 0, 0, 0, 0, 0, CASE r WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3600 ELSE 5000 END)")

    def one(source, lineage, kind, raw, where=None):
        row = F.struct(F.lit(source).alias("source"), F.lit(lineage).alias("lineage"), F.lit("ifd0").alias("scope"), F.lit(kind).alias("kind"), raw.alias("raw"))
        return row if where is None else F.when(where, row)

    zoned, other = ~F.col("floating"), F.col("d") < 6
    rows = [one(1, "a", "dto", text("t")), one(2, "b", "dto", text(shift), other), one(1, "a", "create", text(F.expr("t + INTERVAL 10 SECOND")), F.col("d") > 3), one(1, "a", "offset", F.lit("+02:00"), zoned), one(2, "b", "offset", F.lit("+02:00"), zoned & other)]
    return base.select("analysis", F.explode(F.array_compact(F.array(*rows))).alias("x"), "verified").select("analysis", "x.*", "verified")


@query(f"WITH {_FIELDS} SELECT analysis, source, kind, wall, minutes, instant, confidence, strong FROM atoms")
def time_atoms(spark, sf_dir):
    """Fields joined with the companions of their scope, graded."""
    return P.atoms(fields(spark, sf_dir)).select("analysis", "source", "kind", "wall", "minutes", "instant", "confidence", "strong")


@query(f"""WITH {_FIELDS}, g AS (SELECT analysis, min(instant) AS i0, max(instant) AS i1, min(wall) AS w0, max(wall) AS w1, min(CASE WHEN instant IS NULL THEN wall END) AS f0, max(CASE WHEN instant IS NULL THEN wall END) AS f1 FROM atoms WHERE strong GROUP BY analysis),
  a AS (SELECT analysis, greatest(coalesce(i1 - i0, 0), coalesce(w1 - f0, 0), coalesce(f1 - w0, 0)) AS apart FROM g)
  SELECT analysis, apart, CASE WHEN (apart + 2) // 3600 BETWEEN 1 AND 14 AND abs(apart - (apart + 2) // 3600 * 3600) <= 2 THEN 'possible_time_zone' ELSE 'strong' END AS code FROM a WHERE apart > 2""")
def time_conflicts(spark, sf_dir):
    """Strong times too far apart, and whether by whole hours."""
    return P.strong_conflicts(P.atoms(fields(spark, sf_dir)))


@query(f"""WITH {_FIELDS}, x AS (SELECT analysis, lineage, kind, CASE WHEN instant IS NULL THEN 'w' || wall ELSE 'u' || instant END AS s FROM atoms) SELECT analysis, lineage, kind FROM x GROUP BY ALL HAVING count(DISTINCT s) > 1
  UNION ALL SELECT o_orderkey, 'a', 'dto' FROM orders WHERE o_orderkey % 10 = 3""")
def lineage_conflicts(spark, sf_dir):
    """Lineages that state two times; a planted second time must be found, an equal instant must not."""
    f = fields(spark, sf_dir)
    row = lambda **new: F.struct(*(new.get(c, F.col(c)).alias(c) for c in f.columns))
    planted = F.when((F.col("analysis") % 10 == 3) & (F.col("kind") == "dto") & (F.col("source") == 1), row(raw=F.lit("2001:01:01 00:00:00"), source=F.lit(3)))
    both = f.select("analysis", F.explode(F.array_compact(F.array(row(), planted))).alias("x"))
    return P.lineage_conflicts(P.atoms(both.select("analysis", *(f"x.{c}" for c in f.columns if c != "analysis"))))


@query(f"""WITH {_FIELDS} SELECT analysis, wall, minutes, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, array_to_string(list_sort(list_distinct(list(lineage))), ',') AS lineages,
  CASE max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence, max(CASE kind WHEN 'dto' THEN 5 ELSE 3 END) AS priority, bool_and(verified) AS verified FROM atoms GROUP BY analysis, wall, minutes""")
def time_candidates(spark, sf_dir):
    """Equal times merged."""
    c = P.candidates(P.atoms(fields(spark, sf_dir)))
    text = lambda x: F.concat_ws(",", F.col(x).cast("array<string>")).alias(x)
    return c.select("analysis", "wall", "minutes", text("kinds"), text("sources"), text("lineages"), "confidence", "priority", "verified")


@query(f"""WITH {_FIELDS}, g AS (SELECT analysis, min(instant) AS i0, max(instant) AS i1, min(wall) AS w0, max(wall) AS w1, min(CASE WHEN instant IS NULL THEN wall END) AS f0, max(CASE WHEN instant IS NULL THEN wall END) AS f1 FROM atoms WHERE strong GROUP BY analysis),
  conflict AS (SELECT analysis FROM g WHERE greatest(coalesce(i1 - i0, 0), coalesce(w1 - f0, 0), coalesce(f1 - w0, 0)) > 2),
  cand AS (SELECT analysis, wall, minutes, instant, max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS c, max(CASE kind WHEN 'dto' THEN 5 ELSE 3 END) AS p, bool_and(verified) AS v FROM atoms GROUP BY ALL),
  m AS (SELECT cand.*, conflict.analysis IS NOT NULL AS x FROM cand LEFT JOIN conflict USING (analysis)),
  a AS (SELECT m.*, EXISTS (SELECT 1 FROM m o WHERE o.analysis = m.analysis AND o.c = 3 AND m.c = 3 AND NOT m.x AND o.p = m.p AND o.instant <> m.instant AND abs(o.instant - m.instant) <= 2) AS near FROM m),
  e AS (SELECT *, NOT x AND c = 3 AND v AND instant IS NOT NULL AND NOT near AS eligible FROM a),
  r AS (SELECT *, row_number() OVER (PARTITION BY analysis ORDER BY eligible DESC, c DESC, instant IS NOT NULL DESC, p DESC, wall, minutes) AS n FROM e)
  SELECT analysis, CASE WHEN x THEN 'conflict' WHEN eligible THEN 'eligible' ELSE 'review' END AS decision, CASE WHEN NOT x THEN wall END AS wall, CASE WHEN NOT x THEN CASE c WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END END AS confidence FROM r WHERE n = 1""")
def time_decisions(spark, sf_dir):
    """The policy's decision for each analysis."""
    return P.decisions(fields(spark, sf_dir)).select("analysis", "decision", "wall", "confidence")


_REPORTS = """r AS (SELECT o_orderkey AS analysis, 1 AS source, CASE WHEN o_orderkey % 13 = 0 THEN 'p0' ELSE 'p1' END AS parser, CASE o_orderkey % 8 WHEN 0 THEN 'partial' WHEN 1 THEN 'failed' WHEN 2 THEN 'none' ELSE 'extracted' END AS status,
  o_orderkey % 17 <> 0 AS budget_ok, o_orderkey % 3 AS fields, CASE WHEN o_orderkey % 10 = 1 THEN 1 ELSE 0 END AS issues, o_orderkey % 19 // 18 AS other_parser, o_orderkey % 23 // 22 AS bad_encoding, o_orderkey % 29 // 28 AS bad_container, o_orderkey % 31 // 30 AS bad_locator FROM orders),
  every AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE analysis % 37 = 0),
  x AS (SELECT *, count(*) OVER (PARTITION BY analysis, source) > 1 AS twice, status IN ('partial', 'failed') AS broken,
    CASE WHEN status = 'extracted' THEN fields = 0 OR issues > 0 WHEN status IN ('partial', 'failed') THEN fields > 0 ELSE fields > 0 OR issues > 0 END AS wrong FROM every)"""


def _reports(spark, sf_dir):
    k = F.col("o_orderkey")
    last = lambda n: (k % n == n - 1).cast("bigint")
    status = F.when(k % 8 == 0, "partial").when(k % 8 == 1, "failed").when(k % 8 == 2, "none").otherwise("extracted")
    r = table(spark, sf_dir, "orders").select(
        k.alias("analysis"), F.lit(1).alias("source"), F.when(k % 13 == 0, "p0").otherwise("p1").alias("parser"), status.alias("status"), (k % 17 != 0).alias("budget_ok"), (k % 3).alias("fields"), (k % 10 == 1).cast("bigint").alias("issues"),
        last(19).alias("other_parser"), last(23).alias("bad_encoding"), last(29).alias("bad_container"), last(31).alias("bad_locator"),
    )
    return r.union(r.filter("analysis % 37 = 0"))


@query(f"""WITH {_REPORTS} SELECT analysis, concat_ws(',', CASE WHEN twice THEN 'duplicate_source' END, CASE WHEN parser <> 'p1' THEN 'unknown_parser' END, CASE WHEN NOT budget_ok THEN 'budget_contradiction' END, CASE WHEN other_parser > 0 THEN 'parser_mismatch' END,
  CASE WHEN bad_encoding > 0 THEN 'encoding_mismatch' END, CASE WHEN bad_container > 0 THEN 'container_mismatch' END, CASE WHEN bad_locator > 0 THEN 'locator_mismatch' END, CASE WHEN broken THEN 'report_untrusted' END, CASE WHEN wrong THEN 'report_contradiction' END) AS codes,
  status <> 'extracted' OR parser <> 'p1' OR NOT budget_ok OR other_parser + bad_encoding + bad_container + bad_locator > 0 OR wrong AS dropped, twice OR broken OR wrong AS untrusted FROM x""")
def source_trust(spark, sf_dir):
    """Contradictions of a source's report, those that drop its fields, and those that make the extraction untrusted."""
    return P.source_trust(_reports(spark, sf_dir), "p1").select("analysis", F.concat_ws(",", "codes").alias("codes"), "dropped", "untrusted")


@query(f"""WITH {_REPORTS} SELECT analysis, bool_or(twice OR broken OR wrong OR parser <> 'p1' OR NOT budget_ok OR other_parser + bad_encoding + bad_container + bad_locator > 0) AS conflict FROM x GROUP BY analysis""")
def global_conflicts(spark, sf_dir):
    """Any of the fourteen codes on any source makes the analysis a conflict."""
    some = F.exists("codes", lambda c: c.isin(*P.CONFLICT_CODES))
    return P.source_trust(_reports(spark, sf_dir), "p1").groupBy("analysis").agg(F.max(some | F.col("untrusted")).alias("conflict"))


@query("""WITH b AS (SELECT o_orderkey AS analysis, epoch_us(o_orderdate) // 1000000 - CASE WHEN o_orderkey % 5 = 0 THEN 400000000 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN 4000000000 ELSE 0 END AS wall, o_orderkey % 3 = 0 AS movie, o_orderkey % 4 <> 0 AS verified, o_orderkey % 11 = 0 AS untrusted FROM orders),
  c AS (SELECT *, year(make_timestamp(wall * 1000000)) AS y FROM b), x AS (SELECT *, y IN (SELECT unnest(years)) AS sentinel, wall > 4102444800 AS future, wall < 631152000 OR wall > 4102444800 AS outside FROM c, (SELECT [1904, 1970, 1980] AS years))
  SELECT analysis, concat_ws(',', CASE WHEN NOT movie THEN 'missing_offset' END, CASE WHEN movie THEN 'movie_epoch' END, CASE WHEN sentinel THEN 'sentinel' END, CASE WHEN future THEN 'future' END, CASE WHEN outside THEN 'out_of_range' END) AS anomalies,
  concat_ws(',', 'not_high', CASE WHEN NOT movie THEN 'no_instant' END, CASE WHEN untrusted THEN 'conflict' END, CASE WHEN sentinel THEN 'sentinel' END, CASE WHEN future THEN 'future' END, CASE WHEN outside THEN 'out_of_range' END, CASE WHEN movie THEN 'movie_epoch' END, CASE WHEN untrusted THEN 'untrusted' END,
    CASE WHEN NOT verified THEN 'unverified' END) AS blockers FROM x""")
def evidence_gates(spark, sf_dir):
    """Anomalies and blockers of one candidate for each analysis, early, late, floating or of a movie header."""
    k = F.col("analysis")
    wall = M.seconds("o_orderdate") - F.when(k % 5 == 0, 400000000).otherwise(0) + F.when(k % 7 == 0, 4000000000).otherwise(0)
    movie = k % 3 == 0
    raw = F.when(movie, (wall + M.MOVIE_EPOCH).cast("string")).otherwise(F.date_format(F.timestamp_seconds(wall), "yyyy:MM:dd HH:mm:ss"))
    f = _analyses(spark, sf_dir).select(k, F.lit(1).alias("source"), F.lit("a").alias("lineage"), F.lit("ifd0").alias("scope"), F.when(movie, "mvhd").otherwise("create").alias("kind"), raw.alias("raw"), (k % 4 != 0).alias("verified"))
    c = P.assessed(P.graded(f), untrusted=f.filter("analysis % 11 = 0"))
    return c.select("analysis", F.concat_ws(",", "anomalies").alias("anomalies"), F.concat_ws(",", "blockers").alias("blockers"))


@query("""WITH m AS (SELECT o_orderkey AS member, o_orderkey * 1000 AS candidate, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey * 1000 + o_orderkey % 5 * 400 END AS birth, o_orderkey * 1000 + o_orderkey % 4 * 500 AS modified FROM orders), r AS (SELECT *, CASE WHEN birth IS NULL THEN NULL ELSE abs(birth - candidate) <= 1000 END AS b, abs(modified - candidate) <= 1000 AS m FROM m)
  SELECT member, CASE WHEN coalesce(b, true) AND m THEN 'matches' ELSE 'differs' END AS by_value, CASE WHEN coalesce(b, false) OR m THEN 'matches' ELSE 'differs' END AS by_rule, (coalesce(b, true) AND m) <> (coalesce(b, false) OR m) AS disagree FROM r""")
def member_assessments(spark, sf_dir):
    """File times against the candidate, by the value's rule (both) and the validator's (either), and where they disagree."""
    k = F.col("o_orderkey")
    birth = F.when(k % 3 != 0, k * 1000 + k % 5 * 400)
    b, m = F.abs(birth - k * 1000) <= 1000, F.abs(k % 4 * 500) <= 1000
    value, rule = F.coalesce(b, F.lit(True)) & m, F.coalesce(b, F.lit(False)) | m
    name = lambda c: F.when(c, "matches").otherwise("differs")
    return table(spark, sf_dir, "orders").select(k.alias("member"), name(value).alias("by_value"), name(rule).alias("by_rule"), (value != rule).alias("disagree"))


@query("""WITH s AS (SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 AS wall, 60 * (o_orderkey % 14) AS minutes, epoch_us(o_orderdate) // 1000000 - 3600 * (o_orderkey % 14) + CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS instant FROM orders) SELECT o_orderkey, wall - 60 * minutes AS expected, instant FROM s WHERE instant <> wall - 60 * minutes""")
def stored_value_violations(spark, sf_dir):
    """Stored instants recomputed from wall time and offset; only planted errors differ."""
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select("o_orderkey", M.seconds("o_orderdate").alias("wall"), (60 * (k % 14)).alias("minutes"))
    s = s.withColumn("instant", F.col("wall") - 3600 * (k % 14) + F.when(k % 50 == 0, 1).otherwise(0)).withColumn("expected", M.instant_seconds(F.col("wall"), F.col("minutes")))
    return s.filter("instant != expected").select("o_orderkey", "expected", "instant")


@query("""WITH p AS (SELECT l_orderkey AS member_group, l_linenumber AS rank, l_partkey AS report, l_returnflag = 'R' AS ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS n FROM lineitem)
  SELECT member_group, min(n) FILTER (WHERE ok) AS tried, arg_min(report, n) FILTER (WHERE ok) AS report FROM p WHERE n <= 4 GROUP BY member_group""")
def probe_fallback(spark, sf_dir):
    """The first of up to four probes that verifies."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("member_group"), F.col("l_partkey").alias("report"), (F.col("l_returnflag") == "R").alias("ok"), F.row_number().over(w).cast("bigint").alias("n")).filter("n <= 4")
    n = F.when(F.col("ok"), F.col("n"))
    return p.groupBy("member_group").agg(F.min(n).alias("tried"), F.min_by("report", n).alias("report"))

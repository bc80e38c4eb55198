"""Capture-time evidence: atoms from fields, conflicts, candidates and a decision, without guessing zones.

``fields``: ``analysis``, ``source``, ``lineage``, ``scope``, ``kind`` (``dto``, ``offset``, ``subsec``, ``create``, ``modify``, ``qt_text``, ``mvhd``),
``raw`` (text), ``verified`` (boolean). All steps are keyed by analysis and run for all analyses at once; tables that are ``dealt`` by analysis
before their fields are made are shuffled just once, and no task holds more than a fixed number of their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.functions import time as M

LEVELS = ("conflict", "low", "medium", "high")
PRIORITY = {"dto": 5, "qt_text": 4, "create": 3, "modify": 2, "mvhd": 1}
TOLERANCE = 2  # seconds; callers may set up to 5
ROWS = 1 << 14  # analyses of one task, about


def dealt(df: DataFrame, key: str = "analysis", rows: int = ROWS) -> DataFrame:
    """``df`` dealt by ``key`` into as many partitions as its rows need, so that the memory of a task doesn't grow with the table."""
    return df.repartition(max(1, -(-df.count() // rows)), key)


def rank(confidence: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), confidence).cast("int") - 1


def level(rank_: Column) -> Column:
    return F.get(F.array(*map(F.lit, LEVELS)), rank_.cast("int"))


def lowered(confidence: Column) -> Column:
    """One level lower, but never from evidence into conflict."""
    r = rank(confidence)
    return level(F.when(r > 1, r - 1).otherwise(r))


def priority(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, p in PRIORITY.items():
        out = F.when(kind == k, p).otherwise(out)
    return out


def graded(fields: DataFrame) -> DataFrame:
    """Every field with the time it states, if any: ``wall``, ``nanos``, ``precision``, ``minutes``, ``instant``, ``confidence``, ``strong``;

    and ``invalid``: a companion of its scope can't be read, a companion has no original time, or its own text states no time.
    An original time is high with an offset in its own scope and medium without. QuickTime text is medium, create
    times are medium, and both fall a level without an offset; modify and movie times are low. Companions are found
    by windows over the scope, so fields dealt by analysis aren't shuffled again.
    """
    raw, kind = F.col("raw"), F.col("kind")
    w = Window.partitionBy("analysis", "source", "lineage", "scope")
    offset = F.when(kind == "offset", M.offset_minutes(raw))
    nanos, precision = F.when(kind == "subsec", M.subsecond_nanos(raw)), F.when(kind == "subsec", M.subsecond_precision(raw))
    known = F.col("scope").isNotNull() & F.col("lineage").isNotNull()

    def only(value: Column, companion: str) -> Column:
        """The single distinct value among the companions; null if there are several or one can't be read."""
        least, ok = F.min(value).over(w), F.min((kind != companion) | value.isNotNull()).over(w)
        return F.when(known & ok & (least == F.max(value).over(w)), least)

    bad = ((kind == "offset") & offset.isNull()) | ((kind == "subsec") & nanos.isNull())
    f = fields.select("*", only(offset, "offset").alias("minutes"), only(nanos, "subsec").alias("nanos"), only(precision, "subsec").alias("precision"), F.max(bad).over(w).alias("bad_companion"), (~F.max(kind == "dto").over(w) & kind.isin("offset", "subsec")).alias("orphan"))
    movie = F.when(kind == "mvhd", F.expr("try_cast(raw AS bigint)") - M.MOVIE_EPOCH)
    f = f.withColumn("wall", F.when(kind == "mvhd", movie).when(kind == "qt_text", M.iso_wall(raw)).when(kind.isin(*PRIORITY), M.exif_wall(raw)))
    f = f.withColumn("minutes", F.when(kind == "mvhd", 0).when(kind == "qt_text", M.iso_offset(raw)).when(kind == "dto", F.col("minutes")))
    f = f.withColumn("nanos", F.when(kind == "qt_text", M.iso_nanos(raw)).when(kind == "dto", F.coalesce("nanos", F.lit(0))).otherwise(F.lit(0)).cast("bigint"))
    f = f.withColumn("precision", F.when(kind == "dto", F.coalesce("precision", F.lit(1_000_000_000))).otherwise(F.lit(1_000_000_000)).cast("bigint"))
    zoned = F.col("minutes").isNotNull()
    first = F.when(kind == "dto", F.when(zoned, "high").otherwise("medium")).when(kind.isin("qt_text", "create"), F.when(zoned, "medium").otherwise("low")).otherwise("low")
    invalid = F.col("bad_companion") | F.col("orphan") | (kind.isin(*PRIORITY) & F.col("wall").isNull())
    return f.select(
        "analysis", "source", "lineage", "scope", "kind", "wall", "nanos", "precision", "minutes", M.instant_seconds(F.col("wall"), F.col("minutes")).alias("instant"), first.alias("confidence"), kind.isin("dto", "qt_text").alias("strong"), "verified", "bad_companion", invalid.alias("invalid"),
    )


def atoms(fields: DataFrame) -> DataFrame:
    """Those of ``graded`` that state a time."""
    return graded(fields).filter("wall IS NOT NULL").drop("bad_companion", "invalid")


def _semantic() -> Column:
    """What a time means: two offsets of one instant agree."""
    zoned = F.col("instant").isNotNull()
    return F.struct(zoned.alias("utc"), F.when(zoned, F.col("instant")).otherwise(F.col("wall")).alias("s"), F.col("nanos"), F.when(~zoned, F.col("precision")).alias("p"))


def lineage_conflicts(a: DataFrame) -> DataFrame:
    """Lineages in which a kind states more than one time; two offsets of one instant agree."""
    return a.groupBy("analysis", "lineage", "kind").agg(F.count_distinct(_semantic()).alias("n")).filter("n > 1").select("analysis", "lineage", "kind")


def strong_conflicts(a: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Analyses whose strong atoms are further apart than the tolerance; ``code`` tells likely zone mistakes apart.

    Instants are compared with each other, floating times on the wall scale with all.
    """
    limit = min(tolerance, 5)
    s = a.filter("strong")
    g = s.groupBy("analysis").agg(F.min("instant").alias("i0"), F.max("instant").alias("i1"), F.min("wall").alias("w0"), F.max("wall").alias("w1"), F.min(F.when(F.col("instant").isNull(), F.col("wall"))).alias("f0"), F.max(F.when(F.col("instant").isNull(), F.col("wall"))).alias("f1"))
    apart = F.greatest(F.col("i1") - F.col("i0"), F.col("w1") - F.col("f0"), F.col("f1") - F.col("w0"), F.lit(0))
    g = g.withColumn("apart", apart).filter(F.col("apart") > limit)
    return g.select("analysis", "apart", F.when(M.whole_hours_apart(F.col("apart"), limit), "possible_time_zone").otherwise("strong").alias("code"))


def candidates(a: DataFrame) -> DataFrame:
    """Atoms of one normalised time merged: kinds, sources and lineages as sorted sets, best confidence and priority."""
    key = ["analysis", "wall", "nanos", "precision", "minutes", "instant"]
    merged = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s")
    return a.groupBy(*key).agg(merged("kind"), merged("source"), merged("lineage"), level(F.max(rank(F.col("confidence")))).alias("confidence"), F.max(priority(F.col("kind"))).alias("priority"), F.max("strong").alias("strong"), F.min("verified").alias("verified"))


#: Issue codes that make a whole analysis a conflict.
CONFLICT_CODES = (
    "invalid_companion", "repeated_field", "lineage", "strong", "possible_time_zone", "report_untrusted", "report_contradiction", "parser_mismatch", "encoding_mismatch", "container_mismatch", "locator_mismatch",
    "duplicate_source", "unknown_parser", "budget_contradiction",
)


def source_trust(reports: DataFrame, parser: str) -> DataFrame:
    """Issue codes of each source, whether its fields are dropped, and whether it makes the extraction untrusted.

    ``reports``: ``analysis``, ``source``, ``parser``, ``status`` (``extracted``, ``partial``, ``failed``, ``none``), ``budget_ok``, ``fields``,
    ``issues`` (counts), and of its fields how many contradict it: ``other_parser``, ``bad_encoding``, ``bad_container``, ``bad_locator``.
    A source that is given twice is untrusted; a report's status must agree with its fields and issues.
    """
    twice = F.count("*").over(Window.partitionBy("analysis", "source")) > 1
    trusted, broken = F.col("status") == "extracted", F.col("status").isin("partial", "failed")
    contradiction = F.when(trusted, (F.col("fields") == 0) | (F.col("issues") > 0)).when(broken, F.col("fields") > 0).otherwise((F.col("fields") > 0) | (F.col("issues") > 0))
    found = {
        "duplicate_source": twice, "unknown_parser": ~F.col("parser").eqNullSafe(parser), "budget_contradiction": ~F.coalesce("budget_ok", F.lit(False)), "parser_mismatch": F.col("other_parser") > 0, "encoding_mismatch": F.col("bad_encoding") > 0,
        "container_mismatch": F.col("bad_container") > 0, "locator_mismatch": F.col("bad_locator") > 0, "report_untrusted": broken, "report_contradiction": contradiction,
    }
    dropping = [c for n, c in found.items() if n not in ("duplicate_source", "report_untrusted")]
    dropped = ~F.coalesce(trusted, F.lit(False))
    for c in dropping:
        dropped = dropped | F.coalesce(c, F.lit(False))
    codes = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in found.items())))
    return reports.select("analysis", "source", codes.alias("codes"), dropped.alias("dropped"), (twice | broken | contradiction).alias("untrusted"))


def assessed(g: DataFrame, tolerance: int = TOLERANCE, future_after: int = 4102444800, since: int = 631152000, untrusted: DataFrame | None = None) -> DataFrame:
    """Candidates of graded fields with anomalies, blockers (none: eligible) and near ambiguity; no shuffle if they are dealt by analysis.

    An analysis without any time gives one row with a null ``wall``. ``since`` and ``future_after`` bound the automatic range. Analyses in
    ``untrusted`` have reports that can't be trusted. Instants are compared with each other, floating times on the wall scale.
    """
    limit = min(tolerance, 5)
    known = F.col("wall").isNotNull()
    by, line = Window.partitionBy("analysis"), Window.partitionBy("analysis", "lineage", "kind")
    strong = known & F.col("strong")
    edge = lambda f, c, more=F.lit(True): f(F.when(strong & more, F.col(c))).over(by)
    floating = F.col("instant").isNull()
    apart = F.greatest(edge(F.max, "instant") - edge(F.min, "instant"), edge(F.max, "wall") - edge(F.min, "wall", floating), edge(F.max, "wall", floating) - edge(F.min, "wall"), F.lit(0))
    said = F.when(known, _semantic())
    split = F.coalesce(F.min(said).over(line) != F.max(said).over(line), F.lit(False))
    g = g.withColumn("split", split).withColumn("conflict", (apart > limit) | F.max("split").over(by) | F.max("bad_companion").over(by)).withColumn("invalid", F.max("invalid").over(by))
    key = ["analysis", "wall", "nanos", "precision", "minutes", "instant"]
    g = g.withColumn("nanos", F.when(known, F.col("nanos"))).withColumn("precision", F.when(known, F.col("precision"))).withColumn("minutes", F.when(known, F.col("minutes")))
    c = g.groupBy(*key).agg(level(F.max(rank(F.col("confidence")))).alias("confidence"), F.max(priority(F.col("kind"))).alias("priority"), F.min("verified").alias("verified"), F.max("conflict").alias("conflict"), F.max("invalid").alias("invalid"), F.max(F.col("kind") == "mvhd").alias("movie"))
    c = c.withColumn("some", F.max(known).over(by)).filter(known | ~F.col("some")).drop("some")
    if untrusted is not None:
        c = c.join(untrusted.select("analysis").distinct().withColumn("untrusted", F.lit(True)), "analysis", "left")
    c = c.withColumn("untrusted", F.coalesce("untrusted", F.lit(False)) if untrusted is not None else F.lit(False)).withColumn("conflict", F.col("conflict") | F.col("untrusted"))
    year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("wall") / 86400).cast("int")))
    at = F.coalesce("instant", "wall")
    c = c.withColumn("sentinel", M.sentinel(year)).withColumn("future", at > future_after).withColumn("no_instant", known & floating).withColumn("out_of_range", (at < since) | (at > future_after))
    c = c.withColumn("confidence", F.when(F.col("conflict"), "conflict").when(F.col("sentinel") | F.col("future") | F.col("out_of_range"), "low").otherwise(F.col("confidence")))
    c = c.withColumn("missing_offset", F.col("no_instant")).withColumn("movie_epoch", F.col("movie")).withColumn("invalid_companion", F.col("invalid"))
    named = lambda *p: F.array_compact(F.array(*(F.when(F.col(x), F.lit(x)) for x in p)))
    c = c.withColumn("anomalies", named("missing_offset", "movie_epoch", "sentinel", "future", "out_of_range", "invalid_companion"))
    w = Window.partitionBy("analysis", "confidence", "priority").orderBy("instant")
    exact = F.when((F.col("confidence") == "high") & ~floating, F.col("instant"))
    # Neighbours within the tolerance but not at the same instant; equal ones are refinements of each other.
    c = c.withColumn("ambiguous", exact.isNotNull() & (F.count(exact).over(w.rangeBetween(-limit, limit)) > F.count(exact).over(w.rangeBetween(0, 0))))
    c = c.withColumn("not_high", F.col("confidence") != "high").withColumn("unverified", ~F.col("verified"))
    c = c.withColumn("blockers", named("not_high", "no_instant", "conflict", "sentinel", "future", "out_of_range", "movie_epoch", "invalid", "untrusted", "unverified", "ambiguous"))
    return c.withColumn("eligible", known & (F.size("blockers") == 0))


def preferred(c: DataFrame) -> DataFrame:
    """The best candidate of each analysis: confidence, zone known, priority, finer precision, earlier time."""
    w = Window.partitionBy("analysis").orderBy(F.desc("eligible"), F.desc(rank(F.col("confidence"))), F.desc(F.col("instant").isNotNull()), F.desc("priority"), "precision", "wall", "nanos", "minutes")
    return c.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def decisions(fields: DataFrame, tolerance: int = TOLERANCE, untrusted: DataFrame | None = None) -> DataFrame:
    """``conflict``, ``none``, ``eligible`` or ``review`` for each analysis, and the time selected by the last two."""
    best = preferred(assessed(graded(fields), tolerance, untrusted=untrusted))
    decision = F.when(F.col("conflict"), "conflict").when(F.col("wall").isNull(), "none").when(F.col("eligible"), "eligible").otherwise("review")
    chosen = F.col("decision").isin("eligible", "review")
    return best.withColumn("decision", decision).select("analysis", "decision", *(F.when(chosen, F.col(x)).alias(x) for x in ("wall", "nanos", "minutes", "confidence")))

"""What must hold when drafts close, sessions hand over and attempts follow one another; each function gives what contradicts it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1024


def codes(*checks: tuple[str, Column]) -> Column:
    """The names of the checks that are true, joined by commas."""
    return F.concat_ws(",", *(F.when(check, F.lit(name)) for name, check in checks))


def unequal_extractions(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys whose rows in two passes aren't the same bag; repeated rows count. One shuffle, no digests that could collide."""
    both = first.withColumn("__n", F.lit(1)).unionByName(second.withColumn("__n", F.lit(-1)))
    return both.groupBy(*first.columns).agg(F.sum("__n").alias("__n")).filter("__n != 0").select(key).distinct()


def unsupported_candidates(candidates: DataFrame, fields: DataFrame) -> DataFrame:
    """Eligible candidates (``analysis``, ``wall``, ``minutes``) that no scope proves.

    A scope of a source proves a candidate if all its original times are verified and equal the wall time, and all its offsets,
    one at least, are verified and equal the offset.
    """
    value = lambda kind, f: f(F.when(F.col("kind") == kind, F.col("value")))
    scope = fields.filter(F.col("kind").isin("dto", "offset")).groupBy("analysis", "source", "scope").agg(
        value("dto", F.min).alias("wall"), value("dto", F.max).alias("__wall"), value("offset", F.min).alias("minutes"), value("offset", F.max).alias("__minutes"), F.bool_and("verified").alias("__verified"),
    )
    proofs = scope.filter("wall = __wall AND minutes = __minutes AND __verified").select("analysis", "wall", "minutes")
    return candidates.filter("eligible").join(proofs, ["analysis", "wall", "minutes"], "left_anti")


def evidence_arrays(rows: DataFrame, key: str, column: str, known: DataFrame, known_key: str) -> DataFrame:
    """``key`` and ``problem`` of JSON arrays of ids: no array, not canonical (sorted, distinct, compact), or with ids unknown."""
    parsed = rows.select(key, F.col(column).alias("__text"), F.from_json(column, "array<bigint>").alias("__ids"))
    canonical = F.concat(F.lit("["), F.concat_ws(",", F.array_sort(F.array_distinct("__ids")).cast("array<string>")), F.lit("]"))
    shape = parsed.select(key, F.when(F.col("__ids").isNull(), "no_array").when(F.col("__text") != canonical, "not_canonical").alias("problem")).filter("problem IS NOT NULL")
    wanted = parsed.select(key, F.explode(F.array_distinct("__ids")).alias("__id"))
    dangling = wanted.join(known.select(F.col(known_key).alias("__id")), "__id", "left_anti").select(key).distinct()
    return shape.union(dangling.select(key, F.lit("dangling")))


def incomplete_builds(builds: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """Verified builds (``build``, ``state``, ``expected``) whose members or edges are not all there, or with under two members.

    Members have ordinals from 1 without gaps; every member but the representative has one edge.
    """
    m = members.groupBy("build").agg(F.count("*").alias("__m"), F.count_distinct("ordinal").alias("__d"), F.min("ordinal").alias("__a"), F.max("ordinal").alias("__z"))
    e = edges.groupBy("build").agg(F.count("*").alias("__e"))
    none = lambda c: F.coalesce(c, F.lit(0))
    r = builds.join(m, "build", "left").join(e, "build", "left")
    found = codes(
        ("members", none("__m") != F.col("expected")), ("too_few", none("__m") < 2), ("ordinals", (F.col("__a") != 1) | (F.col("__z") != F.col("__m")) | (F.col("__d") != F.col("__m"))),
        ("edges", none("__e") != F.greatest(none("__m") - 1, F.lit(0))),
    )
    return r.filter("state = 'verified'").select("build", found.alias("codes")).filter("codes != ''")


def seal_totals(seals: DataFrame, rows: DataFrame) -> DataFrame:
    """Stages (``run``, ``stage``) whose ``items`` and ``bytes`` aren't those of the rows, or that have only one of both."""
    side = lambda df, items, bytes_: df.select("run", "stage", *(F.lit(None).cast("bigint").alias(c) if v is None else v.cast("bigint").alias(c) for c, v in {"sealed_items": items[0], "sealed_bytes": items[1], "items": bytes_[0], "bytes": bytes_[1]}.items()))
    both = side(seals, (F.col("items"), F.col("bytes")), (None, None)).union(side(rows, (None, None), (F.lit(1), F.col("bytes"))))
    total = both.groupBy("run", "stage").agg(*(F.sum(c).alias(c) for c in ("sealed_items", "sealed_bytes", "items", "bytes")))
    return total.filter(~(F.col("sealed_items").eqNullSafe(F.col("items")) & F.col("sealed_bytes").eqNullSafe(F.col("bytes"))))


def child_contradictions(seals: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Seals (``analysis``, ``at`` and ``n_<child>`` for each child table) whose counts differ or that are earlier than a child."""
    every = reduce(DataFrame.union, (df.select("analysis", "at", F.lit(name).alias("__child")) for name, df in children.items()))
    counted = every.groupBy("analysis").agg(F.max("at").alias("__last"), *(F.count_if(F.col("__child") == name).alias(f"__{name}") for name in children))
    r = seals.join(counted, "analysis", "left")
    checks = [(name, F.coalesce(f"__{name}", F.lit(0)) != F.col(f"n_{name}")) for name in children]
    return r.select("analysis", codes(*checks, ("too_early", F.col("at") < F.col("__last"))).alias("codes")).filter("codes != ''")


def lease_violations(leases: DataFrame) -> DataFrame:
    """Versions of leases (``run``, ``version``, ``session``, ``state``) that jump, take what another holds, or release what they don't hold."""
    w = Window.partitionBy("run").orderBy("version")
    v = leases.select("*", *(F.lag(c).over(w).alias(f"__{c}") for c in ("version", "session", "state")))
    held, before = F.coalesce(F.col("__state") == "held", F.lit(False)), F.col("session") == F.col("__session")
    found = codes(
        ("generation", F.col("version") != F.col("__version") + 1), ("held_by_other", held & (F.col("state") == "held") & ~before), ("foreign_release", held & (F.col("state") == "released") & ~before),
        ("nothing_held", ~held & (F.col("state") == "released")),
    )
    return v.select("run", "version", found.alias("codes")).filter("codes != ''")


def checkpoint_violations(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints (``run``, ``version``, ``items``, ``bytes``) with a counter below the one before."""
    w = Window.partitionBy("run").orderBy("version")
    fell = (F.col("items") < F.lag("items").over(w)) | (F.col("bytes") < F.lag("bytes").over(w))
    return checkpoints.withColumn("__fell", fell).filter("__fell").drop("__fell")


def attempt_violations(attempts: DataFrame) -> DataFrame:
    """Attempts (``attempt``, ``parent``, ``mode``, ``scope``, ``state``, ``at``) that don't follow from their parent."""
    p = attempts.select(F.col("attempt").alias("parent"), *(F.col(c).alias(f"__{c}") for c in ("scope", "state", "at")))
    r = attempts.filter("parent IS NOT NULL").join(p, "parent", "left")
    found = codes(
        ("no_parent", F.col("__state").isNull()), ("parent_open", ~F.col("__state").isin("completed", "failed", "cancelled")), ("not_full", F.col("mode") != "full"), ("other_scope", F.col("scope") != F.col("__scope")),
        ("before_parent", F.col("at") < F.col("__at")),
    )
    return r.select("attempt", found.alias("codes")).filter("codes != ''")


def audit_gaps(changes: DataFrame, events: DataFrame, *key: str) -> DataFrame:
    """State changes without just one event row, and event rows without a change."""
    both = changes.select(*key, F.lit(1).alias("__c"), F.lit(0).alias("__e")).union(events.select(*key, F.lit(0), F.lit(1)))
    n = both.groupBy(*key).agg(F.sum("__c").alias("__c"), F.sum("__e").alias("__e"))
    gap = F.when(F.col("__c") == 0, "no_change").when(F.col("__e") == 0, "no_event").when((F.col("__c") > 1) | (F.col("__e") > 1), "repeated")
    return n.select(*key, gap.alias("gap")).filter("gap IS NOT NULL")


def manifests(rows: DataFrame, group: list[str], ordinal: str, leaf: Column) -> DataFrame:
    """Count and ordered digest of the leaves of each group, as a tree over ranges of the ordinal.

    A node covers ``CHUNK`` ordinals, then ``CHUNK`` nodes, so no task holds more than that of a group at the two lower levels.
    """
    def level(df: DataFrame, keys: list[str], order: str) -> DataFrame:
        parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "__d"))), lambda x: x["__d"])
        return df.groupBy(*keys).agg(F.sum("__n").alias("__n"), F.sha2(F.concat_ws(",", parts), 256).alias("__d"))

    at = F.floor(F.col(ordinal) / CHUNK)
    leaves = rows.select(*group, F.col(ordinal).alias("__o"), at.alias("__low"), F.floor(at / CHUNK).alias("__high"), F.lit(1).alias("__n"), F.sha2(leaf, 256).alias("__d"))
    low = level(leaves, [*group, "__high", "__low"], "__o")
    return level(level(low, [*group, "__high"], "__low"), group, "__high").withColumnsRenamed({"__n": "leaves", "__d": "manifest"})


def replay(tickets: DataFrame, found: DataFrame) -> DataFrame:
    """Outcome of each directory ticket (``run``, ``directory``, ``entries``) in strict order: after the first that fails, none is reached."""
    t = tickets.join(found.select("run", "directory", F.col("entries").alias("__now")), ["run", "directory"], "left")
    own = F.when(F.col("__now").isNull(), "missing").when(F.col("__now") != F.col("entries"), "changed").otherwise("verified")
    t = t.select("run", "directory", own.alias("__own"))
    first = t.filter("__own != 'verified'").groupBy("run").agg(F.min("directory").alias("__stop"))
    r = t.join(first, "run", "left")
    return r.select("run", "directory", F.when(F.col("directory") > F.col("__stop"), "not_reached").otherwise(F.col("__own")).alias("outcome"))


def session_budgets(outcomes: DataFrame, budget: int) -> DataFrame:
    """Outcomes of a session (``session``, ``outcome``, ``first``, ``second`` bytes read): counts by kind, and whether either pass stayed in half the budget."""
    n = lambda kind: F.count_if(F.col("outcome") == kind).alias(kind)
    within = (F.sum("first") <= budget // 2) & (F.sum("second") <= budget // 2)
    return outcomes.groupBy("session").agg(n("evidence"), n("unavailable"), n("failed"), F.count("*").alias("total"), within.alias("within"))

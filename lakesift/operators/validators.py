"""Declared rules over tables: each gives the rows that break it, so a sound table gives none."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    violations: Callable[[dict[str, DataFrame]], DataFrame]
    key: str


def report(rules: list[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """``rule`` and ``key`` (text) of every violation of every rule."""
    parts = [r.violations(tables).select(F.lit(r.name).alias("rule"), F.col(r.key).cast("string").alias("key")) for r in rules]
    return reduce(DataFrame.union, parts)


def require_none(rules: list[Rule], tables: dict[str, DataFrame]) -> None:
    """An error that names a broken rule, if there is one."""
    first = report(rules, tables).take(1)
    if first:
        raise ValueError(f"{first[0].rule}: {first[0].key}")


def broken(df: DataFrame, check: Column) -> DataFrame:
    """Rows for which a check is false; like a CHECK constraint, null passes."""
    return df.filter(~F.coalesce(check, F.lit(True)))


def repeated(df: DataFrame, *keys: str, where: Column | None = None) -> DataFrame:
    """Keys that occur more than once, among rows of ``where``: a partial unique index."""
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*keys).count().filter("count > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key isn't null and has no parent: a foreign key."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("__p")), F.col(key) == F.col("__p"), "left_anti")


def illegal_steps(versions: DataFrame, edges: list[tuple[str, str]], entity: str = "entity", state: str = "state", version: str = "version") -> DataFrame:
    """Versions whose step from the one before isn't allowed, or whose number isn't one more."""
    w = Window.partitionBy(entity).orderBy(version)
    v = versions.withColumn("__from", F.lag(state).over(w)).withColumn("__before", F.lag(version).over(w))
    allowed = reduce(lambda a, b: a | b, ((F.col("__from") == x) & (F.col(state) == y) for x, y in edges), F.lit(False))
    return v.filter(F.col("__from").isNotNull() & (~allowed | (F.col(version) != F.col("__before") + 1))).drop("__from", "__before")


# Allowed state changes of jobs, runs and planned items.
JOB_EDGES = [
    ("queued", "running"), ("queued", "failed"), ("queued", "cancelled"), ("running", "paused"), ("running", "completed"), ("running", "failed"), ("running", "cancelled"), ("paused", "running"),
    ("paused", "failed"), ("paused", "cancelled"), ("failed", "running"), ("failed", "cancelled"), ("completed", "running"), ("cancelled", "running"),
]
STAGES = ["enumeration", "sampling", "full_hash", "exact"]


def stage_order(seals: DataFrame) -> DataFrame:
    """Seals (``run``, ``stage``, ``at``) out of order, repeated, or earlier than the one before."""
    w = Window.partitionBy("run").orderBy("at", "rank")
    s = seals.withColumn("rank", F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")))
    return s.withColumn("before", F.coalesce(F.lag("rank").over(w), F.lit(0))).filter("rank != before + 1").drop("rank", "before")


def control_outcome(requests: DataFrame) -> DataFrame:
    """What holds for each run (``run``, ``sequence``, ``kind``): a cancel outweighs all else, then the latest pause or resume."""
    return requests.groupBy("run").agg(F.when(F.max(F.col("kind") == "cancel"), "cancel").otherwise(F.max_by("kind", "sequence")).alias("outcome"), F.max("sequence").alias("sequence"))


def reconciled(runs: DataFrame, live: DataFrame) -> DataFrame:
    """New versions of runs left open by sessions that are gone: a pending cancel is honoured, the rest are interrupted."""
    alive = live.select(F.col("run").alias("__live"))
    r = runs.join(alive, F.col("run") == F.col("__live"), "left")
    stale = F.col("__live").isNull() & F.col("state").isin("running", "paused", "queued")
    state = F.when(stale & F.col("cancel_requested"), "cancelled").when(stale, "interrupted").otherwise(F.col("state"))
    return r.select("run", state.alias("state"), (F.col("version") + stale.cast("int")).alias("version"))

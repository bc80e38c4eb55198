"""Append-only tables of fixed schemas under one folder, written in checked steps.

A table is a folder of Parquet parts. Nothing is changed in place: a new state is a new version, and the current row of a key
is its latest version. The methods cover the write side of an evidence store: volumes, profiles, jobs, runs, observations,
fingerprints, groups, reports and analyses differ only in schema, key and rules.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesift.operators.validators import Rule, require_none


def schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_L, _S, _B = T.LongType(), T.StringType(), T.BooleanType()
SCHEMAS = {
    "volumes": schema(volume=_L, identity=_S, observed_ms=_L),
    "capability_profiles": schema(volume=_L, profile=_S, version=_L, current=_B),
    "jobs": schema(job=_L, volume=_L, scope=_S, config=_S, state=_S, version=_L),
    "runs": schema(run=_L, job=_L, parent=_L, state=_S, version=_L, started_ms=_L, finished_ms=_L, coverage=_S),
    "observations": schema(run=_L, observation=_L, path=_S, size=_L, signature=_S),
    "fingerprints": schema(run=_L, observation=_L, kind=_S, algorithm=_S, algorithm_version=_L, parameters=_S, digest=_S, bytes_read=_L),
    "groups": schema(run=_L, group=_L, state=_S, version=_L, members=_L, independent=_L, reclaimable=_L, manifest=_S),
    "members": schema(run=_L, group=_L, ordinal=_L, observation=_L, leaf=_S),
    "edges": schema(run=_L, group=_L, representative=_L, member=_L, compared_bytes=_L),
    "issues": schema(run=_L, issue=_L, severity=_S, stage=_S, code=_S, message=_S, at_ms=_L, resolved_ms=_L),
    "seals": schema(run=_L, stage=_S, items=_L, bytes=_L, at=_L),
    "control_requests": schema(run=_L, sequence=_L, kind=_S),
    "namespace_profiles": schema(profile=_S, volume=_L, case=_S, unicode=_S, observed_ms=_L),
    "leases": schema(run=_L, version=_L, session=_S, state=_S, at_ms=_L),
    "checkpoints": schema(run=_L, version=_L, cursor=_S, items=_L, bytes=_L, digest=_S),
    "directory_tickets": schema(run=_L, directory=_L, path=_S, entries=_L, digest=_S),
    "coverage": schema(run=_L, outcome=_S, directories=_L, entries=_L, issues=_L, manifest=_S),
    "time_sessions": schema(session=_L, run=_L, state=_S, version=_L, children=_L, manifest=_S),
    "group_outcomes": schema(session=_L, group=_L, outcome=_S, reason=_S),
    "reports": schema(report=_L, session=_L, parser=_S, status=_S, state=_S, version=_L, children=_L, manifest=_S),
    "report_fields": schema(report=_L, ordinal=_L, kind=_S, scope=_S, raw=_S),
    "report_issues": schema(report=_L, ordinal=_L, code=_S, detail=_S),
    "analyses": schema(analysis=_L, session=_L, group=_L, decision=_S, state=_S, version=_L, children=_L, manifest=_S),
    "analysis_sources": schema(analysis=_L, ordinal=_L, report=_L, lineage=_S),
    "analysis_observations": schema(analysis=_L, ordinal=_L, source=_L, kind=_S, wall=_L, minutes=_L),
    "analysis_candidates": schema(analysis=_L, ordinal=_L, wall=_L, minutes=_L, confidence=_S, eligible=_B),
    "analysis_issues": schema(analysis=_L, ordinal=_L, code=_S),
    "analysis_members": schema(analysis=_L, ordinal=_L, observation=_L, relation=_S),
    "analysis_recommendations": schema(analysis=_L, ordinal=_L, candidate=_L),
}
#: What is built as a draft, its key, and the tables that hold its parts.
BUILDS = {
    "time_sessions": ("session", ["group_outcomes", "reports", "analyses"]),
    "reports": ("report", ["report_fields", "report_issues"]),
    "analyses": ("analysis", ["analysis_sources", "analysis_observations", "analysis_candidates", "analysis_issues", "analysis_members", "analysis_recommendations"]),
}
KEYS = {
    "volumes": ["volume"], "capability_profiles": ["volume", "version"], "jobs": ["job", "version"], "runs": ["run", "version"], "observations": ["run", "observation"],
    "fingerprints": ["run", "observation", "kind", "algorithm", "algorithm_version", "parameters"], "groups": ["run", "group", "version"], "members": ["run", "group", "ordinal"],
    "edges": ["run", "group", "member"], "issues": ["run", "issue"], "seals": ["run", "stage"], "control_requests": ["run", "sequence"],
    "namespace_profiles": ["profile"], "leases": ["run", "version"], "checkpoints": ["run", "version"], "directory_tickets": ["run", "directory"], "coverage": ["run"], "time_sessions": ["session", "version"], "group_outcomes": ["session", "group"],
    "reports": ["report", "version"], "analyses": ["analysis", "version"], **{n: ["report", "ordinal"] for n in ("report_fields", "report_issues")}, **{n: ["analysis", "ordinal"] for n in BUILDS["analyses"][1]},
}


@dataclass
class Store:
    spark: SparkSession
    root: str
    rules: dict[str, list[Rule]] = field(default_factory=dict)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, name: str) -> DataFrame:
        """All versions; an error if stored columns or types differ from the schema."""
        want, path = SCHEMAS[name], self._path(name)
        if not self._fs(path).exists(path):
            return self.spark.createDataFrame([], want)
        got = self.spark.read.option("recursiveFileLookup", True).parquet(str(path))
        if [(f.name, f.dataType) for f in got.schema] != [(f.name, f.dataType) for f in want]:
            raise ValueError(f"{name}: stored schema differs")
        return got

    def current(self, name: str, *key: str) -> DataFrame:
        """The latest version of each key."""
        w = Window.partitionBy(*key).orderBy(F.desc("version"))
        return self.read(name).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows as one part: staged, checked for repeated keys and against the table's rules, then moved into place.

        A part that fails a check is removed and nothing of it can be read.
        """
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in SCHEMAS[name]))
        staged, final = self._path(f"_staged/{uuid.uuid4().hex}"), self._path(f"{name}/{uuid.uuid4().hex}")
        fs = self._fs(staged)
        try:
            rows.write.mode("errorifexists").parquet(str(staged))
            fresh = self.spark.read.schema(SCHEMAS[name]).parquet(str(staged))
            keys = KEYS[name]
            again = fresh.groupBy(*keys).count().filter("count > 1").select(*keys)
            old = self.read(name).select(*keys)
            if again.union(fresh.select(*keys).join(old, keys, "left_semi")).take(1):
                raise ValueError(f"{name}: key already present")
            if self.rules.get(name):
                require_none(self.rules[name], {name: fresh})
            fs.mkdirs(final.getParent())
            if not fs.rename(staged, final):
                raise OSError(f"{name}: can't move the new part into place")
        finally:
            fs.delete(staged, True)

    def append_new(self, name: str, rows: DataFrame) -> None:
        """``append`` of those rows whose key isn't there yet."""
        rows = rows.dropDuplicates(KEYS[name])
        self.append(name, rows.join(self.read(name).select(*KEYS[name]), KEYS[name], "left_anti"))

    def transition(self, name: str, key: str, value: int, expected: int, state: str, **more: object) -> None:
        """A new version with another state, if the latest version is still the expected one.

        The new version is claimed by a file that can be created once only, so of two writers one fails.
        """
        row = self.current(name, key).filter(F.col(key) == value)
        found = row.select("version").first()
        if found is None or found.version != expected:
            raise ValueError(f"{name}: version {expected} is not the latest")
        changed = {"state": F.lit(state), "version": F.col("version") + 1, **{c: F.lit(v) for c, v in more.items()}}
        self._claimed(name, value, expected + 1, row.withColumns(changed))

    def _claimed(self, name: str, value: object, version: int, rows: DataFrame) -> None:
        claim = self._path(f"_claims/{name}/{value}-{version}")
        fs = self._fs(claim)
        try:
            fs.create(claim, False).close()
        except Exception as e:  # the file system's own error for a file that exists
            raise ValueError(f"{name}: version {version} of {value} is taken") from e
        try:
            self.append(name, rows)
        except BaseException:
            fs.delete(claim, False)
            raise

    def begin(self, name: str, **row: object) -> None:
        """Open a draft of a session, report or analysis."""
        key = BUILDS[name][0]
        row |= {"state": "draft", "version": 1, "children": 0, "manifest": None}
        self._claimed(name, row[key], 1, self._rows(name, row))

    def add(self, name: str, part: str, value: int, rows: DataFrame) -> None:
        """Append parts of a draft; a sealed or abandoned one takes none."""
        key, parts = BUILDS[name]
        if part not in parts:
            raise ValueError(f"{part} is no part of {name}")
        self._draft(name, key, value)
        self.append(part, rows.withColumn(key, F.lit(value)))

    def seal(self, name: str, value: int, counts: dict[str, int], **more: object) -> None:
        """Close a draft if it holds just the declared number of rows of each part, all of its own drafts are closed, and

        ordinals run from 1 without gaps; ``manifest`` becomes an order-free digest of all parts.
        """
        key, parts = BUILDS[name]
        version, total, mark = self._draft(name, key, value), 0, 0
        for part in parts:
            rows = self.read(part).filter(F.col(key) == value)
            if part in BUILDS:
                rows = self.current(part, BUILDS[part][0]).filter(F.col(key) == value)
                if rows.filter("state = 'draft'").take(1):
                    raise ValueError(f"{part}: still open")
            ordinals = [F.count_distinct("ordinal"), F.coalesce(F.min("ordinal"), F.lit(1)), F.coalesce(F.max("ordinal"), F.lit(0))] if "ordinal" in rows.columns else [F.count("*"), F.lit(1), F.count("*")]
            n, bits, different, first, last = rows.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*rows.columns)), F.lit(0)), *ordinals).first()
            if n != counts.get(part, 0) or (different, first, last) != (n, 1, n):
                raise ValueError(f"{part}: {n} rows do not agree with what was declared")
            total, mark = total + n, mark ^ bits
        self.transition(name, key, value, version, "sealed", children=total, manifest=f"{mark & (1 << 64) - 1:016x}", **more)

    def abandon(self, name: str, value: int) -> None:
        key = BUILDS[name][0]
        self.transition(name, key, value, self._draft(name, key, value), "abandoned")

    def upsert_volume(self, volume: int, identity: str, observed_ms: int) -> None:
        """Insert a volume, or do nothing if it is known; another identity for the same volume is an error."""
        known = self.read("volumes").filter(F.col("volume") == volume).first()
        if known is None:
            self.append("volumes", self._rows("volumes", {"volume": volume, "identity": identity, "observed_ms": observed_ms}))
        elif known.identity != identity:
            raise ValueError(f"volume {volume} has another identity")

    def recovery(self, scope: str) -> tuple[str, int | None]:
        """``none``, ``unique`` with the run, or ``ambiguous``: interrupted runs of the scope's jobs that no later run has as parent."""
        jobs = self.current("jobs", "job").filter(F.col("scope") == scope).select("job")
        runs = self.current("runs", "run").join(jobs, "job", "left_semi")
        followed = runs.select(F.col("parent").alias("run"))
        left = [r.run for r in runs.filter("state = 'interrupted'").join(followed, "run", "left_anti").select("run").take(2)]
        return ("none", None) if not left else ("unique", left[0]) if len(left) == 1 else ("ambiguous", None)

    def start_attempt(self, volume: int, identity: str, scope: str, config: str, at_ms: int) -> int:
        """Bind the volume, choose what to recover, and bring a new job and run, of the number after the highest, to running.

        Of two starts at once one fails, as a job's and a run's first version can be claimed once only.
        """
        self.upsert_volume(volume, identity, at_ms)
        kind, parent = self.recovery(scope)
        if kind == "ambiguous":
            raise ValueError(f"{scope}: several runs could be recovered")
        job, run = (self.read(n).agg(F.coalesce(F.max(k), F.lit(0))).first()[0] + 1 for n, k in (("jobs", "job"), ("runs", "run")))
        self._claimed("jobs", job, 1, self._rows("jobs", {"job": job, "volume": volume, "scope": scope, "config": config, "state": "queued", "version": 1}))
        row = {"run": run, "job": job, "parent": parent, "state": "queued", "version": 1, "started_ms": at_ms, "finished_ms": None, "coverage": None}
        self._claimed("runs", run, 1, self._rows("runs", row))
        self.transition("jobs", "job", job, 1, "running")
        self.transition("runs", "run", run, 1, "running")
        return run

    def acquire_lease(self, run: int, session: str, at_ms: int) -> None:
        """Bind a session to a run that no other holds."""
        held = self.current("leases", "run").filter(F.col("run") == run).first()
        if held is not None and held.state == "held":
            raise ValueError(f"run {run} is held by {held.session}")
        version = 1 if held is None else held.version + 1
        self._claimed("leases", run, version, self._rows("leases", {"run": run, "version": version, "session": session, "state": "held", "at_ms": at_ms}))

    def leased_transition(self, run: int, session: str, expected: int, state: str) -> None:
        """A run's new state by the session that holds it; a state at the end also gives the lease back."""
        held = self.current("leases", "run").filter(F.col("run") == run).first()
        if held is None or held.state != "held" or held.session != session:
            raise ValueError(f"run {run} is not held by {session}")
        self.transition("runs", "run", run, expected, state)
        if state in ("completed", "failed", "cancelled"):
            self.transition("leases", "run", run, held.version, "released")

    def save_checkpoint(self, run: int, cursor: str, items: int, bytes_: int, digest: str) -> None:
        """Progress of a run; counters never fall."""
        last = self.current("checkpoints", "run").filter(F.col("run") == run).first()
        if last is not None and (items < last["items"] or bytes_ < last["bytes"]):
            raise ValueError(f"run {run}: progress can't fall")
        version = 1 if last is None else last.version + 1
        self._claimed("checkpoints", run, version, self._rows("checkpoints", {"run": run, "version": version, "cursor": cursor, "items": items, "bytes": bytes_, "digest": digest}))

    def _rows(self, name: str, row: dict) -> DataFrame:
        return self.spark.createDataFrame([tuple(row[f.name] for f in SCHEMAS[name])], SCHEMAS[name])

    def _draft(self, name: str, key: str, value: int) -> int:
        """Version of a draft that is open."""
        row = self.current(name, key).filter(F.col(key) == value).first()
        if row is None or row.state != "draft":
            raise ValueError(f"{name}: {value} is not open")
        return row.version

    def backup(self, target: str) -> dict[str, int]:
        """Copy all tables to a new place; rows and an order-free digest of each copy must equal the source's."""
        counts = {}
        for name in SCHEMAS:
            source = self.read(name)
            source.write.mode("errorifexists").parquet(f"{target}/{name}")
            mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns))).first())
            if mark(source) != mark(self.spark.read.schema(SCHEMAS[name]).parquet(f"{target}/{name}")):
                raise ValueError(f"{name}: copy differs")
            counts[name] = mark(source)[0]
        return counts


def demo_groups(spark: SparkSession, groups: int = 3) -> DataFrame:
    """A small fixed table of files with exact copies."""
    rows = [(10 * g + k, f"demo/{g}/{k}.jpg", 4 + g, f"copy{'x' * g}", None) for g in range(groups) for k in range(2 + g)]
    return spark.createDataFrame(rows, "file_id bigint, path string, size bigint, content string, object_key bigint")

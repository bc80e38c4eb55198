import pytest
from pyspark.sql import functions as F

from lakesift.operators import dedup, validators
from lakesift.sources.store import SCHEMAS, Store, demo_groups


def test_append_transition_and_backup(spark, tmp_path):
    rule = validators.Rule("known state", lambda t: validators.broken(t["jobs"], F.col("state").isin("queued", "running")), "job")
    store = Store(spark, str(tmp_path / "store"), {"jobs": [rule]})
    job = lambda n, state: spark.createDataFrame([(n, 1, "s", "{}", state, 1)], SCHEMAS["jobs"])
    store.append("jobs", job(1, "queued"))
    with pytest.raises(ValueError, match="already present"):
        store.append("jobs", job(1, "queued"))
    with pytest.raises(ValueError, match="known state"):
        store.append("jobs", job(2, "odd"))
    store.append_new("jobs", job(1, "queued").union(job(3, "queued")))
    store.transition("jobs", "job", 1, 1, "running")
    with pytest.raises(ValueError, match="not the latest"):
        store.transition("jobs", "job", 1, 1, "running")
    assert sorted((r.job, r.state, r.version) for r in store.current("jobs", "job").collect()) == [(1, "running", 2), (3, "queued", 1)]
    assert store.backup(str(tmp_path / "copy"))["jobs"] == 3


def test_demo(spark):
    got = dedup.group_measures(dedup.verified_members(demo_groups(spark))).collect()
    assert sorted(r.files for r in got) == [2, 3, 4]
    assert sorted(r.reclaimable for r in got) == [4, 10, 18]


def test_drafts_leases_and_checkpoints(spark, tmp_path):
    """Sessions, reports and analyses are built as drafts and sealed with their counts; leases and versions are taken once."""
    s = Store(spark, str(tmp_path / "st"))
    rows = lambda text, schema: spark.createDataFrame(text, schema)
    s.begin("time_sessions", session=1, run=7)
    s.begin("reports", report=5, session=1, parser="p1", status="extracted")
    fields = rows([(1, "dto", "ifd0", "2020:01:01 00:00:00"), (2, "offset", "ifd0", "+01:00")], "ordinal bigint, kind string, scope string, raw string")
    s.add("reports", "report_fields", 5, fields)
    with pytest.raises(ValueError):
        s.add("reports", "report_fields", 5, fields)  # the same keys
    with pytest.raises(ValueError):
        s.seal("reports", 5, {"report_fields": 3})
    with pytest.raises(ValueError):
        s.seal("time_sessions", 1, {"reports": 1})  # its report is still open
    s.seal("reports", 5, {"report_fields": 2})
    with pytest.raises(ValueError):
        s.add("reports", "report_issues", 5, rows([(1, "x", "y")], "ordinal bigint, code string, detail string"))
    s.begin("analyses", analysis=9, session=1, group=3, decision=None)
    s.add("analyses", "analysis_candidates", 9, rows([(2, 10, None, "high", True)], "ordinal bigint, wall bigint, minutes bigint, confidence string, eligible boolean"))
    with pytest.raises(ValueError):
        s.seal("analyses", 9, {"analysis_candidates": 1})  # its ordinal isn't 1
    s.abandon("analyses", 9)
    s.append("group_outcomes", rows([(1, 4, "unavailable", "offline")], "session bigint, group bigint, outcome string, reason string"))
    s.seal("time_sessions", 1, {"reports": 1, "analyses": 1, "group_outcomes": 1})
    found = s.current("time_sessions", "session").first()
    assert (found.state, found.version, found.children, len(found.manifest)) == ("sealed", 2, 3, 16)
    s.append("runs", rows([(7, 1, None, "running", 1, 0, None, None)], SCHEMAS["runs"]))
    s.acquire_lease(7, "a", 1)
    for wrong in (lambda: s.acquire_lease(7, "b", 2), lambda: s.leased_transition(7, "b", 1, "paused"), lambda: s.leased_transition(7, "a", 2, "paused")):
        with pytest.raises(ValueError):
            wrong()
    s.leased_transition(7, "a", 1, "completed")
    assert s.current("leases", "run").first().state == "released" and s.current("runs", "run").first().state == "completed"
    s.acquire_lease(7, "b", 3)
    s.save_checkpoint(7, "c1", 5, 50, "d")
    with pytest.raises(ValueError):
        s.save_checkpoint(7, "c0", 4, 60, "d")
    s.save_checkpoint(7, "c2", 6, 60, "d")
    assert s.current("checkpoints", "run").first().cursor == "c2"
    with pytest.raises(ValueError):  # a second writer of the same version
        s._claimed("checkpoints", 7, 2, s.current("checkpoints", "run"))
    for name, row in (("namespace_profiles", ("p", 1, "sensitive", "nfc", 0)), ("directory_tickets", (7, 1, "/a", 3, "d")), ("coverage", (7, "complete", 1, 3, 0, "m"))):
        s.append_new(name, rows([row], SCHEMAS[name]))
        s.append_new(name, rows([row], SCHEMAS[name]))
        assert s.read(name).count() == 1


def test_start_attempt(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = store.start_attempt(1, "disk", "photos", "{}", 10)
    assert (first, store.recovery("photos")) == (1, ("none", None))
    store.transition("runs", "run", first, 2, "interrupted")
    assert store.recovery("photos") == ("unique", 1)
    with pytest.raises(ValueError, match="another identity"):
        store.start_attempt(1, "other disk", "photos", "{}", 20)
    second = store.start_attempt(1, "disk", "photos", "{}", 20)
    row = store.current("runs", "run").filter(F.col("run") == second).first()
    assert (row.parent, row.state, row.job, store.recovery("photos")) == (1, "running", 2, ("none", None))

"""Cases with known results: duplicates, times, pages, validators, exports, containers, trees and streams."""

import base64
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from lakesift.functions import text as X
from lakesift.functions import time as M
from lakesift.operators import dedup, history, pages, timepolicy, validators
from lakesift.sources import containers, tree
from lakesift.streaming import enumeration


def files(spark, contents, keys=None):
    rows = [(i, f"f{i}", len(c), bytearray(c), None if keys is None else keys[i]) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "file_id bigint, path string, size bigint, content binary, object_key bigint")


def test_duplicates_of_other_names(spark):
    g = dedup.group_measures(dedup.verified_members(files(spark, [b"Z" * 200000] * 2))).collect()
    assert [(r.files, r.independent, r.reclaimable) for r in g] == [(2, 2, 200000)]


def test_early_reject_and_sample_collision(spark):
    assert dedup.stage_summary(files(spark, [b"AAAA1111", b"BBBB2222"]), 4).orderBy("stage").select("files").collect() == [(2,), (2,), (0,), (0,)]
    same_sample = files(spark, [b"AAAAxxxxMMMMzzzzTTTT", b"AAAAyyyyMMMMyyyyTTTT"])
    assert dedup.verified_members(same_sample, 4).count() == 0


def test_hard_links_are_one_copy(spark):
    g = dedup.group_measures(dedup.verified_members(files(spark, [b"x" * 10] * 2, [7, 7]))).first()
    assert (g.independent, g.reclaimable) == (1, 0)


def evaluate(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_times(spark):
    lit = F.lit
    assert evaluate(spark, M.exif_wall(lit("2024:06:07 08:09:10"))) == 1717747750
    assert evaluate(spark, M.exif_wall(lit("2023:02:29 08:09:10"))) is None
    assert evaluate(spark, M.exif_wall(lit("2024:06:07 08:09:60"))) is None
    assert [evaluate(spark, M.offset_minutes(lit(z))) for z in ("+08:00", "-14:00", "+14:01", "-14:01", "-00:00", "+8:00")] == [480, -840, None, None, None, None]
    assert evaluate(spark, M.subsecond_nanos(lit("123"))) == 123_000_000 and evaluate(spark, M.subsecond_nanos(lit("1234567890"))) is None
    text = lit("2024-06-07T08:09:10.123456789-05:30")
    assert (evaluate(spark, M.iso_nanos(text)), evaluate(spark, M.iso_offset(text))) == (123456789, -330)
    assert evaluate(spark, M.iso_offset(lit("2024-06-07T08:09:10"))) is None
    assert evaluate(spark, M.days(lit(1), lit(1), lit(1))) == -719162


def decide(spark, rows):
    schema = "analysis bigint, source int, lineage string, scope string, kind string, raw string, verified boolean"
    full = [(1, s, line, "0", k, raw, True) for s, line, k, raw in rows]
    return timepolicy.decisions(spark.createDataFrame(full, schema)).first()


def test_time_policy(spark):
    one = [(1, "a", "dto", "2024:06:07 08:09:10"), (1, "a", "offset", "+00:00")]
    assert decide(spark, one).decision == "eligible"
    assert decide(spark, one[:1]).decision == "review"  # no offset, never guessed
    near = [(2, "b", "dto", "2024:06:07 08:09:11"), (2, "b", "offset", "+00:00")]
    assert decide(spark, one + near).decision == "review"
    far = [(2, "b", "dto", "2024:06:07 12:09:11"), (2, "b", "offset", "+00:00")]
    assert decide(spark, one + far).decision == "conflict"
    for year in (1904, 1970, 1980):
        assert decide(spark, [(1, "a", "dto", f"{year}:06:07 08:09:10"), (1, "a", "offset", "+00:00")]).decision == "review"


def test_zone_mistake_or_strong(spark):
    def code(hours):
        rows = [(1, 1, "a", "0", "dto", "2024:06:07 00:00:00", True), (1, 1, "a", "0", "offset", "+00:00", True), (1, 2, "b", "0", "dto", f"2024:06:07 {hours}:00:00", True), (1, 2, "b", "0", "offset", "+00:00", True)]
        f = spark.createDataFrame(rows, "analysis bigint, source int, lineage string, scope string, kind string, raw string, verified boolean")
        return timepolicy.strong_conflicts(timepolicy.atoms(f)).first().code

    assert (code(14), code(15)) == ("possible_time_zone", "strong")


def test_pages(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    rows, cursor = pages.fetch(df, [("k", True)], 4, "list", "run-1")
    assert [r.k for r in rows] == [0, 1, 2, 3]
    rows, cursor = pages.fetch(df, [("k", True)], 4, "list", "run-1", cursor)
    rows, cursor = pages.fetch(df, [("k", True)], 4, "list", "run-1", cursor)
    assert [r.k for r in rows] == [8, 9] and cursor is None
    with pytest.raises(ValueError):
        pages.page(df, [("k", True)], 257)
    with pytest.raises(ValueError):
        pages.Cursor.decode(pages.Cursor("list", "run-1", (3,)).encode(), "list", "run-2", 1)
    with pytest.raises(ValueError):
        pages.Cursor.decode(pages.Cursor("list", "run-1", (-3,)).encode(), "list", "run-1", 1)


def test_validators(spark):
    v = spark.createDataFrame([(1, 1, "queued"), (1, 2, "running"), (1, 3, "queued"), (2, 1, "queued"), (2, 3, "running")], "entity int, version int, state string")
    assert sorted((r.entity, r.version) for r in validators.illegal_steps(v, validators.JOB_EDGES).collect()) == [(1, 3), (2, 3)]
    rule = validators.Rule("positive", lambda t: validators.broken(t["t"], F.col("n") > 0), "n")
    validators.require_none([rule], {"t": spark.createDataFrame([(1,), (None,)], "n int")})
    with pytest.raises(ValueError, match="positive"):
        validators.require_none([rule], {"t": spark.createDataFrame([(-1,)], "n int")})


def test_export_order_and_digest(spark, tmp_path):
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    parts = {"summary": d([(1,)], "groups int"), "group": d([(5,)], "g int"), "member": d([(5, 1, "a,b"), (5, 0, 'c"')], "g int, o int, p string"), "issue": d([(9,)], "i int")}
    rows = list(history.ordered(history.records(parts, {"summary": [], "group": ["g"], "member": ["g", "o"], "issue": ["i"]})))
    assert [s for s, _ in rows] == ["summary", "group", "member", "member", "issue"]
    assert json.loads(rows[2][1]) == {"g": "5", "o": "0", "p": 'c"'}
    document = json.loads("".join(history.json_document(iter(rows))))
    assert document["integrity"]["digest"] == history.logical_digest(iter(rows)) and len(document["records"]) == 5
    lines = list(history.csv_lines(iter(rows)))
    assert lines[0].endswith("record_json\r\n") and lines[1] == '1,complete,summary,0,"{""groups"":""1""}"\r\n'
    target = tmp_path / "out.csv"
    history.publish(iter(lines), str(target))
    with pytest.raises(FileExistsError):
        history.publish(iter(lines), str(target))
    assert len(list(tmp_path.iterdir())) == 1


def tiff_bytes(order="<", text=b"2024:06:07 08:09:10\0", tag=0x9003, kind=2, next_=0):
    mark = b"II*\0" if order == "<" else b"MM\0*"
    return mark + struct.pack(order + "IHHHIII", 8, 1, tag, kind, len(text), 26, next_) + text


def test_containers(spark):
    for order in "<>":
        r = containers.extract(tiff_bytes(order))
        assert (r.format, r.status, r.fields[0]["kind"], r.fields[0]["raw"]) == ("tiff", "extracted", "dto", b"2024:06:07 08:09:10\0")
    assert "directory_cycle" in containers.extract(tiff_bytes(next_=8)).issues
    assert containers.extract(tiff_bytes(kind=3)).status == "failed"
    assert containers.extract(tiff_bytes()[:30]).issues == ["out_of_range"]
    exif = b"Exif\0\0" + tiff_bytes()
    assert containers.extract(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xd9").fields[0]["header_offset"] == 12
    box = lambda kind, body: struct.pack(">I", len(body) + 8) + kind + body
    for version, width in ((0, 4), (1, 8)):
        movie = box(b"moov", box(b"mvhd", bytes([version, 0, 0, 0]) + (3_800_000_000).to_bytes(width, "big")))
        assert containers.extract(movie).fields[0]["raw"] == b"3800000000"
    key = containers.CREATION_KEY
    keys = box(b"keys", b"\0" * 4 + struct.pack(">I", 1) + box(b"mdta", key))
    ilst = box(b"ilst", struct.pack(">I", 8 + 16 + 4) + b"\0\0\0\1" + box(b"data", b"\0" * 8 + b"2024"))
    assert containers.extract(box(b"moov", box(b"meta", b"\0" * 4 + keys + ilst))).fields[0]["raw"] == b"2024"
    assert containers.extract(box(b"moov", box(b"udta", box(b"\xa9day", b"\0\4\0\0" + b"2023")))).fields[0]["raw"] == b"2023"
    assert containers.extract(b"").status == "no_fields" and containers.extract(b"plain text here").status == "unsupported"
    assert containers.extract(tiff_bytes(), (10, 10, 10)).status == "failed"
    rows = containers.extract_table(spark.createDataFrame([(1, bytearray(tiff_bytes())), (2, None)], "id bigint, c binary"), "id", "c").collect()
    assert sorted((r.id, r.kind) for r in rows) == [(1, "dto"), (2, None)]


def test_tree_and_stream_agree(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    for name, data in (("a.jpg", b"one"), ("sub/b.jpg", b"one"), ("sub/c.txt", b"two")):
        (root / name).write_bytes(data)
    scanned = tree.scan(spark, [f"file://{root}"])
    assert dedup.group_measures(dedup.verified_members(scanned)).first().files == 2
    assert tree.media_files(scanned).count() == 2
    query = enumeration.append_batches(tree.stream(spark, f"file://{root}", 2), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.path for r in streamed.collect()) == sorted(r.path for r in scanned.collect())
    with pytest.raises(FileNotFoundError):
        tree.scan(spark, [str(tmp_path / "none")])
    deep, issues = tree.within_depth(scanned, f"file:{root}", 0)
    assert (deep.count(), issues.count()) == (1, 2)
    e = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 2, None)], "path string, device int, inode int")
    first, again = tree.first_by_identity(e)
    assert sorted(r.path for r in first.collect()) == ["a", "c"] and [r.path for r in again.collect()] == ["b"]
    assert [r.path for r in tree.same_device(e, 1)[1].collect()] == ["c"]


def test_text_functions(spark):
    assert evaluate(spark, X.utf8_truncate(F.lit("aé漢"), 5)) == "aé"
    assert evaluate(spark, X.from_base64_unpadded(F.lit("YQ"))) == bytearray(b"a")
    assert evaluate(spark, X.from_base64_unpadded(F.lit("YQ=="))) is None
    assert evaluate(spark, X.valid_path(F.lit("a/../b"))) is False
    assert evaluate(spark, X.format_bytes(F.lit(1536))) == "1.5 KiB"
    assert evaluate(spark, X.csv_field(F.lit('a"b'))) == '"a""b"'


def test_whole_tables_are_joined(spark, tmp_path):
    """Rows outside the subsets of the queries checked by the older SQL: keys, customers and documents of any number."""
    from lakesift.plans import relational

    rng = random.Random(3)
    orders = [(k, rng.randrange(1, 60)) for k in range(1, 401)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    got = [tuple(r) for r in relational.overlap_by_either_key(spark, str(tmp_path)).collect()]
    want = {(g, h) for g, a in orders for h, b in orders if g < h and (a == b or (g % 97 == h % 97 and a % 2 == b % 2))}
    assert len(got) == len(want) and set(got) == want
    got = {tuple(r) for r in relational.parent_child(spark, str(tmp_path)).collect()}
    assert got == {(c, p) for (p, a), (c, b) in zip(orders, orders[1:]) if a != b}
    spark.createDataFrame([(1, "en"), (2500, "de"), (2502, "en"), (9000, "fr"), (9001, None)], "doc_id bigint, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in relational.null_safe_join(spark, str(tmp_path)).collect()} == {(1, 1), (2500, 2), (2502, 3), (9000, 3), (9001, 3)}
    spark.createDataFrame([(k, "a" if k % 2 else "b", k, k // 100) for k in range(1, 400)], "event_id bigint, event_type string, user_id bigint, ts bigint").write.parquet(f"{tmp_path}/events.parquet")
    events = [(e, k, u, t) for e, k, u, t in ((r.event_id, r.event_type, r.user_id % 7, r.ts) for r in spark.read.parquet(f"{tmp_path}/events.parquet").collect())]
    spark.createDataFrame(events, "event_id bigint, event_type string, user_id bigint, ts bigint").write.mode("overwrite").parquet(f"{tmp_path}/again/events.parquet")
    earlier = lambda o: max(((t, e) for e, k, u, t in events if k != "a" and u == o[2] and t < o[3]), default=(None, None))[1]
    assert {tuple(r) for r in relational.latest_match(spark, f"{tmp_path}/again").collect()} == {(o[0], earlier(o)) for o in events if o[1] == "a"}


def test_overlaps_are_found_once(spark, monkeypatch):
    """Keys of several blocks, repeated groups with several keys and nulls; pairs aren't compared with each other where groups are single."""
    from lakesift.plans import relational

    monkeypatch.setattr(relational, "BLOCK", 3)
    rng = random.Random(4)
    orders = [(k, rng.randrange(1, 9)) for k in range(1, 250)]
    several = [*orders, *((k, a + 1) for k, a in orders if k % 5 == 0), (97, 1), (97, 1), (300, None), (None, 3), (None, None)]
    for rows in (orders, several):
        df = relational._overlaps(spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint"))
        got = [tuple(r) for r in df.collect()]
        have = [(g, a) for g, a in rows if g is not None and a is not None]
        want = {(g, h) for g, a in have for h, b in have if g < h and (a == b or (g % 97 == h % 97 and a % 2 == b % 2))}
        assert len(got) == len(want) and set(got) == want
        assert rows is several or "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_overlaps_shuffle_members_not_pairs(spark, monkeypatch):
    """A key of many members is shuffled as a few blocks; groups of several keys of either sign are still found once."""
    from lakesift.plans import relational

    def written(plan):
        kind = plan.getClass().getSimpleName()
        inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
        inner += [] if inner or kind == "ReusedExchangeExec" else [plan.children().apply(k) for k in range(plan.children().size())]
        return (plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0) + sum(written(p) for p in inner)

    monkeypatch.setattr(relational, "BLOCK", 3)
    df = relational._overlaps(spark.createDataFrame([(97 * k, 2 * k) for k in range(400)], "o_orderkey bigint, o_custkey bigint"))
    got = {tuple(r) for r in df.collect()}
    assert len(got) == 400 * 399 // 2 and 400 < written(df._jdf.queryExecution().executedPlan()) < 3 * 400
    rng = random.Random(5)
    rows = [(rng.randrange(-300, 300), rng.randrange(-9, 9)) for _ in range(500)]
    got = [tuple(r) for r in relational._overlaps(spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint")).collect()]
    by = lambda x, n: x - n * int(x / n)  # noqa: E731  # the remainder has the sign of x
    want = {(g, h) for g, a in rows for h, b in rows if g < h and (a == b or (by(g, 97) == by(h, 97) and by(a, 2) == by(b, 2)))}
    assert len(got) == len(want) and set(got) == want


def test_time_policy_deals_analyses_once(spark, tmp_path, monkeypatch):
    """As many partitions as the rows need, of about equal size, and no other shuffle of what is derived from them."""
    from lakesift.operators import timepolicy
    from lakesift.plans import timing

    monkeypatch.setattr(timepolicy.dealt, "__defaults__", ("analysis", 50))
    spark.range(1000).selectExpr("id AS o_orderkey", "timestamp_seconds(1500000000 + 1000 * id) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(timing, "table", lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    for query in (timing.time_decisions, timing.lineage_conflicts, timing.time_candidates, timing.time_conflicts, timing.evidence_gates):
        df = query(spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
        assert shuffles and all("REPARTITION_BY_NUM" in x and ", 20)" in x for x in shuffles), (query.__name__, shuffles)
    assert len(shuffles) == 2  # evidence_gates also reads the analyses that aren't trusted


def test_first_difference_wherever_it_is(spark, tmp_path):
    from lakesift.plans import duplicates

    base = "abcdefghij" * 50
    texts = [base, base, base[:499] + "X", base[:8] + "X" + base[9:], "X" + base[1:], base[:250] + "X" + base[251:], "é" + "a" * 20, "aa" + "é" + "a" * 18, "", "", "漢字" * 40 + "a", "漢字" * 40 + "b", "x" * 7, "x" * 6 + "y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in duplicates.compare_neighbours(spark, str(tmp_path)).collect()}
    by_size = {}
    for k, t in enumerate(texts):
        by_size.setdefault(len(t.encode()), []).append(k)
    pairs = {(a, b) for ks in by_size.values() for a, b in zip(ks, ks[1:])}
    assert {(r.doc_id, r.other_id) for r in got.values()} == pairs
    for a, b in pairs:
        where = next((k for k, (x, y) in enumerate(zip(texts[a], texts[b])) if x != y), None)
        assert (got[a].same, got[a].first_difference) == (texts[a] == texts[b], where)


def test_whole_texts_are_fields_and_base64(spark, tmp_path):
    from lakesift.plans import scalars

    long = "plain " * 60 + 'a "quoted", \nlast  '
    spark.createDataFrame([(3, long, "en", "s"), (7, "no mark " * 50, "en", "s")], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in scalars.field_text(spark, str(tmp_path)).collect()}
    assert got[3].field == '"' + long.replace('"', '""') + '"' and got[3].trimmed == long.rstrip() and got[7].field == "no mark " * 50
    got = {r.doc_id: r for r in scalars.base64_round_trip(spark, str(tmp_path)).collect()}
    assert got[3].unpacked == "s" + long and got[3].packed == base64.b64encode(("s" + long).encode()).decode().rstrip("=")


def heif_bytes(infe=2, iloc=0, index=0):
    box = lambda kind, body: struct.pack(">I", len(body) + 8) + kind + body
    wide, number = (">I" if infe == 3 else ">H"), (">I" if iloc == 2 else ">H")
    entry = bytes([infe, 0, 0, 0]) + struct.pack(wide, 7) + b"\0\0Exif\0"
    exif = b"\0\0\0\0" + tiff_bytes()

    def whole(at):
        item = struct.pack(number, 7) + (b"\0\0" if iloc else b"") + b"\0\0" + b"\0\1" + bytes(index) + struct.pack(">II", at, len(exif))
        places = bytes([iloc, 0, 0, 0, 0x44, index]) + struct.pack(number, 1) + item
        meta = b"\0\0\0\0" + box(b"hdlr", bytes(8) + b"pict" + bytes(13)) + box(b"iinf", bytes(4) + b"\0\1" + box(b"infe", entry)) + box(b"iloc", places)
        return box(b"ftyp", b"heic\0\0\0\0heic") + box(b"meta", meta)

    front = whole(0)
    return whole(len(front) + 8) + box(b"mdat", exif)


def test_heif_versions():
    want = [(f["kind"], f["raw"]) for f in containers.extract(tiff_bytes()).fields]
    assert want
    for infe, iloc, index in ((2, 0, 0), (2, 1, 0), (2, 1, 4), (3, 0, 0), (2, 2, 0), (3, 2, 8)):
        report = containers.extract(heif_bytes(infe, iloc, index))
        assert [(f["kind"], f["raw"]) for f in report.fields] == want and not report.issues, (infe, iloc, index)
    for infe, iloc in ((4, 0), (2, 3)):
        report = containers.extract(heif_bytes(infe, iloc))
        assert not report.fields and report.issues == ["unsupported_version"]

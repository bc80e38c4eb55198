"""Queries on scalar functions over columns derived from the tables. Survey rows C1-C4, C18, C25, C26, C29, I1-I44, I49-I58, A14."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakesift.functions import text as T
from lakesift.functions import time as M
from lakesift.registry import query, table

_KINDS = "CASE WHEN e IN ({i}) THEN 'image' WHEN e IN ({r}) THEN 'raw' WHEN e IN ({v}) THEN 'video' END".format(**{k: ", ".join(f"'{x}'" for x in v) for k, v in (("i", T.IMAGE), ("r", T.RAW), ("v", T.VIDEO))})
_NAMES = "['a.JPG', '._b.jpg', 'c.dng', 'd.mp4', '.hidden', 'e', 'f.tar.GZ', 'g.heic', 'h.MOV', 'i.3fr', 'j.txt']"


@query(f"""WITH n AS (SELECT doc_id, lang || '/' || {_NAMES}[1 + doc_id % 11] AS path FROM documents), m AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '')[-1] AS name FROM n),
  x AS (SELECT *, CASE WHEN starts_with(name, '._') THEN '' ELSE lower(regexp_extract(name, '^.+\\.([A-Za-z0-9]+)$', 1)) END AS e FROM m) SELECT doc_id, name, e AS extension, {_KINDS} AS kind FROM x""")
def media_filter(spark, sf_dir):
    """Extension and kind of a file name."""
    names = F.expr("array(" + _NAMES[1:-1] + ")")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", F.get(names, (F.col("doc_id") % 11).cast("int"))).alias("path"))
    return d.select("doc_id", T.file_name(F.col("path")).alias("name"), T.extension(F.col("path")).alias("extension"), T.media_kind(F.col("path")).alias("kind"))


@query("""WITH n AS (SELECT doc_id, ['Cache', '.Trash-501', 'My.photoslibrary', 'photos', 'node_modules'][1 + doc_id % 5] AS name FROM documents)
  SELECT doc_id, name, CASE WHEN lower(name) IN ('cache', 'node_modules') THEN 'name' WHEN starts_with(lower(name), '.trash-') THEN 'prefix' WHEN ends_with(lower(name), '.photoslibrary') THEN 'suffix' END AS reason FROM n""")
def directory_exclusion(spark, sf_dir):
    """The first rule that leaves a directory out."""
    name = F.expr("get(array('Cache', '.Trash-501', 'My.photoslibrary', 'photos', 'node_modules'), int(doc_id % 5))")
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), T.exclusion(name, ["cache", "node_modules"]).alias("reason"))


@query("SELECT n_nationkey, array_to_string(list_sort(list_distinct(list_filter([lower(ltrim(x, '.')) FOR x IN ['.' || n_name, n_name, '', '..', lower(n_name)]], lambda x: x <> ''))), ',') AS options FROM nation")
def normal_options(spark, sf_dir):
    """Options trimmed, lowered, sorted, each once."""
    raw = F.array(F.concat(F.lit("."), "n_name"), F.col("n_name"), F.lit(""), F.lit(".."), F.lower("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(T.normal_extensions(raw), ",").alias("options"))


_PATHS = "[source || '/' || doc_id, '/' || source, source || '//x', '../' || lang, 'a/./b', 'con.txt', 'x/aux', 'y./z', 'q?', lang]"


@query(f"""WITH p AS (SELECT doc_id, {_PATHS}[1 + doc_id % 10] AS path FROM documents), q AS (SELECT *, string_split(path, '/') AS a FROM p),
  v AS (SELECT *, len(list_filter(a, lambda x: x IN ('', '.', '..') OR strlen(x) > 16384)) = 0 AND len(a) <= 1024 AND strlen(path) <= 65536 AS ok FROM q)
  SELECT doc_id, path, ok AS valid, ok AND len(list_filter(a, lambda x: regexp_matches(lower(x), '^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\\..*)?$') OR regexp_matches(x, '[<>:"\\\\|?*]') OR regexp_matches(x, '[. ]$'))) = 0 AS valid_windows FROM v""")
def path_validity(spark, sf_dir):
    """Relative paths that may be stored."""
    path = F.expr("get(array(concat(source, '/', doc_id), concat('/', source), concat(source, '//x'), concat('../', lang), 'a/./b', 'con.txt', 'x/aux', 'y./z', 'q?', lang), int(doc_id % 10))")
    d = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return d.select("doc_id", "path", T.valid_path(F.col("path")).alias("valid"), T.valid_windows_path(F.col("path")).alias("valid_windows"))


@query("""SELECT doc_id, strlen(text) AS bytes, length(text) AS chars, lower(hex(substring(text, 1, 8))) AS head, sha256(text) AS digest, regexp_matches(sha256(text), '^[0-9a-f]{64}$') AS is_digest,
  sha256('path-key-1|' || lang || '|utf-8|' || strlen(source) || '|' || source) AS path_key FROM documents""")
def bytes_and_digests(spark, sf_dir):
    """Lengths, hexadecimal and digests."""
    h = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length("text").cast("bigint").alias("bytes"), F.length("text").cast("bigint").alias("chars"), F.lower(F.hex(F.encode(F.substring("text", 1, 8), "UTF-8"))).alias("head"),
        h.alias("digest"), T.is_digest(h).alias("is_digest"), T.path_key(F.col("lang"), F.lit("utf-8"), F.col("source")).alias("path_key"),
    )


@query("SELECT doc_id, rtrim(base64(encode(source || text)), '=') AS packed, source || text AS unpacked FROM documents")
def base64_round_trip(spark, sf_dir):
    """I11 on whole texts."""
    return _there_and_back(spark, sf_dir, F.concat("source", "text"))


def _there_and_back(spark, sf_dir, raw):
    d = table(spark, sf_dir, "documents").select("doc_id", T.base64_unpadded(raw).alias("packed"))
    return d.select("doc_id", "packed", T.from_base64_unpadded(F.col("packed")).cast("string").alias("unpacked"))


@query("""WITH x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN source || ', ' || lang WHEN 2 THEN 'say "' || lang || '"' ELSE text END AS v FROM documents)
  SELECT doc_id, CASE WHEN regexp_matches(v, '[,"\r\n]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS field, rtrim(v || chr(32) || chr(9) || chr(13) || chr(10), ' ' || chr(9) || chr(10) || chr(13)) AS trimmed FROM x""")
def field_text(spark, sf_dir):
    """B9, I9, I17 on whole texts."""
    return _fields(spark, sf_dir, "text")


def _fields(spark, sf_dir, text):
    v = F.expr(f"""CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN concat(source, ', ', lang) WHEN 2 THEN concat('say "', lang, '"') ELSE {text} END""")
    return table(spark, sf_dir, "documents").select("doc_id", T.csv_field(v).alias("field"), T.field_trim(F.concat(v, F.lit(" \t\r\n"))).alias("trimmed"))


@query("""SELECT doc_id, CASE WHEN strlen(text) <= 21 THEN text ELSE (SELECT max(p) FROM (SELECT unnest([substring(text, 1, i) FOR i IN range(0, 22)]) AS p) WHERE strlen(p) <= 21) END AS cut FROM documents""")
def text_cut_to_bytes(spark, sf_dir):
    """At most 21 bytes, ending between characters."""
    return table(spark, sf_dir, "documents").select("doc_id", T.utf8_truncate(F.col("text"), 21).alias("cut"))


@query("""WITH x AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN '0' || doc_id WHEN 2 THEN '+' || doc_id WHEN 3 THEN '-' || doc_id WHEN 4 THEN '-0' ELSE '0' END AS v FROM documents)
  SELECT doc_id, v, v = '0' OR regexp_matches(v, '^-?[1-9][0-9]*$') AS canonical, CAST(v AS BIGINT) AS number FROM x""")
def canonical_decimals(spark, sf_dir):
    """Integers as text."""
    v = F.expr("CASE doc_id % 6 WHEN 0 THEN string(doc_id) WHEN 1 THEN concat('0', doc_id) WHEN 2 THEN concat('+', doc_id) WHEN 3 THEN concat('-', doc_id) WHEN 4 THEN '-0' ELSE '0' END")
    return table(spark, sf_dir, "documents").select("doc_id", v.alias("v"), T.canonical_decimal(v).alias("canonical"), v.cast("bigint").alias("number"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'root' END AS root, concat_ws('/', nullif(CASE WHEN page_id % 3 = 0 THEN '' ELSE 'root' END, ''), nullif(CASE WHEN page_id % 5 = 0 THEN '' ELSE 'page' || page_id END, '')) AS path FROM pages""")
def joined_paths(spark, sf_dir):
    """Root and relative path, either possibly empty."""
    root, rel = F.expr("IF(page_id % 3 = 0, '', 'root')"), F.expr("IF(page_id % 5 = 0, '', concat('page', page_id))")
    return table(spark, sf_dir, "pages").select("page_id", root.alias("root"), T.join_path(root, rel).alias("path"))


@query("""WITH x AS (SELECT o_orderkey, (o_orderkey * 7919 * o_orderkey) % 1125899906842624 // CAST(pow(1024, o_orderkey % 5) AS BIGINT) AS n FROM orders),
  y AS (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 ELSE 4 END AS p FROM x), z AS (SELECT *, n / [1, 1024, 1048576, 1073741824, 1099511627776][1 + p] AS v FROM y)
  SELECT o_orderkey, n, CASE WHEN v >= 10 OR p = 0 THEN CAST(CAST(floor(v + 0.5) AS BIGINT) AS VARCHAR) ELSE CAST(floor(v * 10 + 0.5) AS BIGINT) // 10 || '.' || CAST(floor(v * 10 + 0.5) AS BIGINT) % 10 END || ' ' || ['B', 'KiB', 'MiB', 'GiB', 'TiB'][1 + p] AS shown FROM z""")
def shown_bytes(spark, sf_dir):
    """Sizes for people."""
    n = F.expr("(o_orderkey * 7919 * o_orderkey) % 1125899906842624 div bigint(pow(1024, o_orderkey % 5))")
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), T.format_bytes(n).alias("shown"))


_DATED = "SELECT o_orderkey, o_orderdate AS t, ['+08:00', '-05:30', '+14:01', '-00:00', '+14:00', 'x'][1 + o_orderkey % 6] AS z, ['1', '12', '123', '', '123456789', '1234567890', '000'][1 + o_orderkey % 7] AS f FROM orders"
_MINUTES = "CASE WHEN z IN ('+08:00', '-05:30', '+14:00') THEN (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (CAST(z[2:3] AS INT) * 60 + CAST(z[5:6] AS INT)) END"


def _dated(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("t"), F.expr("get(array('+08:00', '-05:30', '+14:01', '-00:00', '+14:00', 'x'), int(o_orderkey % 6))").alias("z"), F.expr("get(array('1', '12', '123', '', '123456789', '1234567890', '000'), int(o_orderkey % 7))").alias("f"))


@query(f"""WITH d AS ({_DATED}) SELECT o_orderkey, CAST(epoch(t) AS BIGINT) // 86400 * 86400 + CAST(epoch(t) AS BIGINT) % 86400 AS wall, {_MINUTES} AS minutes, CAST(epoch(t) AS BIGINT) - 60 * {_MINUTES} AS instant,
  CASE WHEN regexp_matches(f, '^[0-9]{{1,9}}$') THEN CAST(rpad(f, 9, '0') AS BIGINT) END AS nanos, CASE WHEN regexp_matches(f, '^[0-9]{{1,9}}$') THEN CAST(rpad('1', CAST(10 - length(f) AS INT), '0') AS BIGINT) END AS precision FROM d""")
def exif_times(spark, sf_dir):
    """Text of a date, offset and fraction parsed back; without a valid offset there is no instant."""
    d = _dated(spark, sf_dir)
    wall = M.exif_wall(F.date_format("t", "yyyy:MM:dd HH:mm:ss"))
    minutes = M.offset_minutes(F.col("z"))
    return d.select("o_orderkey", wall.alias("wall"), minutes.alias("minutes"), M.instant_seconds(wall, minutes).alias("instant"), M.subsecond_nanos(F.col("f")).alias("nanos"), M.subsecond_precision(F.col("f")).alias("precision"))


@query("""WITH d AS (SELECT event_id, ts, ['Z', 'z', '+02:00', '-0330', '', '+15:00'][1 + event_id % 6] AS z FROM events) SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS wall, (epoch_us(ts) % 1000000) * 1000 AS nanos,
  CASE WHEN z IN ('Z', 'z') THEN 0 WHEN z = '+02:00' THEN 120 WHEN z = '-0330' THEN -210 END AS minutes FROM d""")
def iso_times(spark, sf_dir):
    """Strict ISO text with zone or without."""
    z = F.expr("get(array('Z', 'z', '+02:00', '-0330', '', '+15:00'), int(event_id % 6))")
    shown = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), z)
    d = table(spark, sf_dir, "events").select("event_id", shown.alias("s"))
    return d.select("event_id", M.iso_wall(F.col("s")).alias("wall"), M.iso_nanos(F.col("s")).alias("nanos"), M.iso_offset(F.col("s")).alias("minutes"))


@query("""WITH d AS (SELECT o_orderkey, 1 + (o_orderkey * 37) % 9999 AS y, 1 + o_orderkey % 14 AS m, 1 + (o_orderkey * 7) % 32 AS dd FROM orders), v AS (SELECT *, try_cast(lpad(CAST(y AS VARCHAR), 4, '0') || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(dd AS VARCHAR), 2, '0') AS DATE) AS d FROM d)
  SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', d) AS BIGINT) AS day, CASE WHEN d IS NOT NULL THEN lpad(CAST(y AS VARCHAR), 4, '0') || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(dd AS VARCHAR), 2, '0') END AS civil FROM v""")
def calendar_days(spark, sf_dir):
    """Days of valid dates of years 1 to 9999, and back."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", M.days(F.expr("1 + (o_orderkey * 37) % 9999"), F.expr("1 + o_orderkey % 14"), F.expr("1 + (o_orderkey * 7) % 32")).alias("day"))
    return d.select("o_orderkey", "day", M.civil(F.col("day")).alias("civil"))


@query("""WITH d AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) + 2082844800 AS raw FROM orders) SELECT o_orderkey, raw - 2082844800 AS instant, CAST((raw - 2082844800)::HUGEINT * 1000000000 + o_orderkey AS VARCHAR) AS total_nanos,
  (raw - 4000000000) * 1 AS s, strftime(make_timestamp((raw - 2082844800) * 1000000), '%Y-%m-%d %H:%M:%S UTC') AS shown FROM d""")
def movie_times(spark, sf_dir):
    """Seconds from 1904, total nanoseconds, and text."""
    raw = M.seconds("o_orderdate") + M.MOVIE_EPOCH
    d = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    i = M.movie_seconds(F.col("raw"))
    return d.select("o_orderkey", i.alias("instant"), M.total_nanos(i, F.col("o_orderkey")).cast("string").alias("total_nanos"), (F.col("raw") - 4_000_000_000).alias("s"), M.display_utc(i).alias("shown"))


@query("""WITH d AS (SELECT o_orderkey, (o_orderkey - 700) * 1234567891 AS n FROM orders) SELECT o_orderkey, n, CAST(floor(n::DECIMAL(38,0) / 1000000000) AS BIGINT) AS seconds, ((n % 1000000000) + 1000000000) % 1000000000 AS nanos FROM d""")
def epoch_split(spark, sf_dir):
    """Floor seconds with nanoseconds above zero, also before 1970."""
    n = F.expr("(o_orderkey - 700) * 1234567891")
    s, r = M.split_nanos(n)
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), s.alias("seconds"), r.alias("nanos"))


@query("""WITH d AS (SELECT o_orderkey, (o_orderkey * 1801) % 60000 AS diff, 1900 + o_orderkey % 90 AS y FROM orders), h AS (SELECT *, (diff + 2) // 3600 AS hours FROM d)
  SELECT o_orderkey, hours BETWEEN 1 AND 14 AND abs(diff - hours * 3600) <= 2 AS whole_hours, y IN (1904, 1970, 1980) AS sentinel, diff > 30000 + 86400 - 60000 AS future, diff BETWEEN 100 AND 50000 AS in_range FROM h""")
def time_suspicions(spark, sf_dir):
    """Whole hours apart, sentinel years, future and out-of-range times."""
    diff = F.expr("(o_orderkey * 1801) % 60000")
    return table(spark, sf_dir, "orders").select("o_orderkey", M.whole_hours_apart(diff).alias("whole_hours"), M.sentinel(F.expr("1900 + o_orderkey % 90")).alias("sentinel"), M.obvious_future(diff, F.lit(30000 - 60000)).alias("future"), diff.between(100, 50000).alias("in_range"))


@query("""WITH d AS (SELECT o_orderkey, o_orderkey * 1000 AS a, o_orderkey * 1000 + (o_orderkey % 7) * 300 AS b, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 1000 END AS g, 100 * (1 + o_orderkey % 20) AS p FROM orders)
  SELECT o_orderkey, CASE WHEN g IS NULL THEN 'review' WHEN abs(a - b) <= greatest(g, p) THEN 'matches' ELSE 'differs' END AS relation FROM d""")
def file_time_relations(spark, sf_dir):
    """Two times compared at the coarser precision."""
    a, b = F.expr("o_orderkey * 1000"), F.expr("o_orderkey * 1000 + (o_orderkey % 7) * 300")
    return table(spark, sf_dir, "orders").select("o_orderkey", M.file_time_relation(a, b, F.expr("IF(o_orderkey % 11 = 0, NULL, 1000)"), F.expr("100 * (1 + o_orderkey % 20)")).alias("relation"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey // 7 AS quotient, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE greatest(l_partkey, l_suppkey) END AS strict_max, least(l_partkey * l_suppkey, 1000) AS saturated, coalesce(nullif(l_returnflag, 'N'), '-') AS flag FROM lineitem""")
def integer_arithmetic(spark, sf_dir):
    """Truncating division, a maximum that is null if any part is, saturation, coalesce."""
    five = F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey"))
    strict = F.when(five.isNotNull() & F.col("l_partkey").isNotNull(), F.greatest("l_partkey", five))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_partkey div 7").alias("quotient"), strict.alias("strict_max"), F.least(F.col("l_partkey") * F.col("l_suppkey"), F.lit(1000)).alias("saturated"), F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.lit("-")).alias("flag"))


@query("""SELECT event_id, json_valid(props) AS valid, json_type(props) AS kind, len(json_keys(props)) AS n_keys FROM events""")
def json_shapes(spark, sf_dir):
    """Validity, kind and number of keys of JSON text."""
    from pyspark.sql import types

    v = F.try_parse_json("props")
    keys = F.size(F.json_object_keys("props"))
    kind = F.when(F.ltrim("props").startswith("{"), "OBJECT").when(F.ltrim("props").startswith("["), "ARRAY")
    return table(spark, sf_dir, "events").select("event_id", v.isNotNull().alias("valid"), kind.alias("kind"), keys.cast(types.LongType()).alias("n_keys"))


@query("""WITH a AS (SELECT o_orderkey, [o_orderkey % 3, o_orderkey % 5, o_orderkey % 3] AS v FROM orders), e AS (SELECT o_orderkey, unnest(v) AS x FROM a)
  SELECT o_orderkey, count(*) AS items, count(DISTINCT x) AS distinct_items, bool_and(x >= 0) AS non_negative, sum(x) AS total FROM e GROUP BY o_orderkey""")
def json_array_items(spark, sf_dir):
    """JSON arrays parsed, unnested and checked."""
    text = F.to_json(F.array(F.col("o_orderkey") % 3, F.col("o_orderkey") % 5, F.col("o_orderkey") % 3))
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.from_json(text, "array<bigint>")).alias("x"))
    return d.groupBy("o_orderkey").agg(F.count("*").alias("items"), F.countDistinct("x").alias("distinct_items"), F.min(F.col("x") >= 0).alias("non_negative"), F.sum("x").alias("total"))


_RANK = "CASE c WHEN 'conflict' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END"


@query(f"""WITH d AS (SELECT event_id, ['conflict', 'low', 'medium', 'high'][1 + event_id % 4] AS c, ['dto', 'qt_text', 'create', 'modify', 'mvhd'][1 + event_id % 5] AS k, event_id % 2 = 0 AS s, event_id % 3 = 0 AS u FROM events)
  SELECT event_id, {_RANK} AS rank, CASE {_RANK} WHEN 3 THEN 'medium' WHEN 2 THEN 'low' WHEN 1 THEN 'low' ELSE 'conflict' END AS lowered, CASE k WHEN 'dto' THEN 5 WHEN 'qt_text' THEN 4 WHEN 'create' THEN 3 WHEN 'modify' THEN 2 ELSE 1 END AS priority,
  CASE WHEN s AND u THEN 'sensitive_unicode' WHEN s THEN 'sensitive' WHEN u THEN 'insensitive_unicode' ELSE 'insensitive' END AS case_behaviour FROM d""")
def ranks_and_names(spark, sf_dir):
    """Confidence ranks, priorities and enum names."""
    from lakesift.operators import timepolicy as P

    c = F.expr("get(array('conflict', 'low', 'medium', 'high'), int(event_id % 4))")
    k = F.expr("get(array('dto', 'qt_text', 'create', 'modify', 'mvhd'), int(event_id % 5))")
    s, u = F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0
    behaviour = F.when(s & u, "sensitive_unicode").when(s, "sensitive").when(u, "insensitive_unicode").otherwise("insensitive")
    return table(spark, sf_dir, "events").select("event_id", P.rank(c).alias("rank"), P.lowered(c).alias("lowered"), P.priority(k).alias("priority"), behaviour.alias("case_behaviour"))


@query("""SELECT page_id, least(page_id * 1000, 16384) AS hardened, CASE WHEN page_id % 2 = 1 THEN url END AS shown, CASE WHEN page_id % 2 = 1 THEN 'display' ELSE 'redacted' END AS tag FROM pages""")
def redaction(spark, sf_dir):
    """Limits held to a ceiling; text shown only where allowed."""
    ok = F.col("page_id") % 2 == 1
    return table(spark, sf_dir, "pages").select("page_id", F.least(F.col("page_id") * 1000, F.lit(16384)).alias("hardened"), F.when(ok, F.col("url")).alias("shown"), F.when(ok, "display").otherwise("redacted").alias("tag"))


@query("""WITH b AS (SELECT doc_id, ['FFD8FFE1', '49492A00', '4D4D002A', '0000001866747970', '00000008776964650000', '3C68746D6C'][1 + doc_id % 6] AS h FROM documents)
  SELECT doc_id, CASE WHEN starts_with(h, 'FFD8') THEN 'jpeg' WHEN starts_with(h, '49492A00') OR starts_with(h, '4D4D002A') THEN 'tiff' WHEN substring(h, 9, 8) IN ('66747970', '6D6F6F76', '77696465', '66726565') THEN 'iso-bmff' ELSE 'unknown' END AS format FROM b""")
def format_detection(spark, sf_dir):
    """Container format by its first bytes."""
    content = F.unhex(F.expr("get(array('FFD8FFE1', '49492A00', '4D4D002A', '0000001866747970', '00000008776964650000', '3C68746D6C'), int(doc_id % 6))"))
    return table(spark, sf_dir, "documents").select("doc_id", T.container_format(content).alias("format"))

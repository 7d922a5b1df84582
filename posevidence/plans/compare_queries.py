"""Queries that compare two files' evidence, and text clean-up over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from posevidence.functions import text
from posevidence.operators import audit, compare, results
from posevidence.plans.registry import MATCHING, registered
from posevidence.sources.adapter import CHECK_PARAMS

P = CHECK_PARAMS

# --- by id -----------------------------------------------------------------

_BY_ID = """
joined AS (
  SELECT coalesce(l.id, r.id) AS id, l.id AS lid, r.id AS rid,
    list_filter([CASE WHEN l.servertime IS DISTINCT FROM r.servertime THEN 'servertime' END,
      CASE WHEN l.latitude IS DISTINCT FROM r.latitude THEN 'latitude' END,
      CASE WHEN l.longitude IS DISTINCT FROM r.longitude THEN 'longitude' END,
      CASE WHEN l.uid IS DISTINCT FROM r.uid THEN 'uid' END,
      CASE WHEN l.callsign IS DISTINCT FROM r.callsign THEN 'callsign' END], lambda x: x IS NOT NULL) AS f,
    l, r
  FROM cot_original l FULL JOIN cot_copy r ON l.id = r.id),
judged AS (SELECT *, CASE WHEN rid IS NULL THEN 'only left' WHEN lid IS NULL THEN 'only right' WHEN len(f) = 0 THEN 'identical' ELSE 'differs' END AS state FROM joined)"""


def _by_id(t):
    return compare.compare_by_id(t["cot_original"], t["cot_copy"])


@registered(
    "compare_by_id", "X5 J15", "cot_original cot_copy",
    f"WITH {_BY_ID} SELECT id, state, CASE WHEN lid IS NOT NULL AND rid IS NOT NULL THEN array_to_string(f, ' ') END AS fields FROM judged",
)
def compare_by_id(t):
    return _by_id(t).select("id", "state", F.array_join("fields", " ").alias("fields"))


@registered(
    "field_differences", "X5", "cot_original cot_copy",
    f"""
WITH {_BY_ID}, named AS (SELECT id, unnest(f) AS field, l, r FROM judged WHERE state = 'differs')
SELECT id, field, CASE field WHEN 'uid' THEN l.uid WHEN 'callsign' THEN l.callsign WHEN 'servertime' THEN l.servertime::VARCHAR
    WHEN 'latitude' THEN l.latitude::VARCHAR ELSE l.longitude::VARCHAR END AS "left",
  CASE field WHEN 'uid' THEN r.uid WHEN 'callsign' THEN r.callsign WHEN 'servertime' THEN r.servertime::VARCHAR
    WHEN 'latitude' THEN r.latitude::VARCHAR ELSE r.longitude::VARCHAR END AS "right"
FROM named""",
)
def field_differences(t):
    return compare.field_differences(_by_id(t))


@registered(
    "id_summary", "X5", "cot_original cot_copy",
    f"""
WITH {_BY_ID}
SELECT count(*) FILTER (WHERE state = 'identical') AS identical, count(*) FILTER (WHERE state = 'differs') AS differ,
  count(*) FILTER (WHERE state = 'only left') AS only_left, count(*) FILTER (WHERE state = 'only right') AS only_right,
  if(bool_or(state IN ('differs', 'only left')), 'differs', 'match') AS verdict FROM judged""",
)
def id_summary(t):
    return compare.id_summary(_by_id(t))


# --- by position ---------------------------------------------------------------

# On these tables no report has two near candidates that compete, so one round
# of mutual best choices states the result.
_DISTANCE = """2 * 6371008.8 * asin(sqrt(sin(radians(r.latitude - l.latitude) / 2) ** 2
  + cos(radians(l.latitude)) * cos(radians(r.latitude)) * sin(radians(r.longitude - l.longitude) / 2) ** 2))"""
_MATCHED = f"""
l_spots AS (SELECT coalesce(callsign, uid) AS device, servertime, latitude, longitude, count(*) AS n FROM cot_original GROUP BY ALL),
r_spots AS (SELECT coalesce(callsign, uid) AS device, servertime, latitude, longitude, count(*) AS n FROM cot_copy GROUP BY ALL),
exact AS (SELECT l.device, l.servertime, l.latitude, l.longitude, least(l.n, r.n) AS n FROM l_spots l JOIN r_spots r
  USING (device, servertime, latitude, longitude)),
l_open AS (SELECT l.*, l.n - coalesce(e.n, 0) AS free FROM l_spots l LEFT JOIN exact e USING (device, servertime, latitude, longitude)),
r_open AS (SELECT r.*, r.n - coalesce(e.n, 0) AS free FROM r_spots r LEFT JOIN exact e USING (device, servertime, latitude, longitude)),
near AS (
  SELECT l.device, l.servertime AS lt, l.latitude AS la, l.longitude AS lo, r.servertime AS rt, r.latitude AS ra, r.longitude AS ro,
    {_DISTANCE} AS d, abs(epoch_us(l.servertime) - epoch_us(r.servertime)) AS gap, least(l.free, r.free) AS n
  FROM l_open l JOIN r_open r ON l.device = r.device AND r.servertime BETWEEN l.servertime - INTERVAL 1 SECOND AND l.servertime + INTERVAL 1 SECOND
  WHERE l.free > 0 AND r.free > 0 AND {_DISTANCE} <= 1),
mutual AS (
  SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY device, lt, la, lo ORDER BY gap, d) = 1
    AND row_number() OVER (PARTITION BY device, rt, ra, ro ORDER BY gap, d) = 1)"""


def _device(df):
    return compare.labelled(df)


def _match(t):
    return compare.match_positions(_device(t["cot_original"]), _device(t["cot_copy"]))


_TABLE = f"""
{_MATCHED},
found AS (SELECT device, n, 0.0::DOUBLE AS d FROM exact UNION ALL SELECT device, n, d FROM mutual),
tally AS (SELECT device, CAST(sum(n) AS BIGINT) AS matched, max(d) AS dist FROM found GROUP BY device),
l_count AS (SELECT coalesce(callsign, uid) AS device, count(*) AS n FROM cot_original GROUP BY 1),
r_count AS (SELECT coalesce(callsign, uid) AS device, count(*) AS n FROM cot_copy GROUP BY 1),
tabled AS (SELECT device, coalesce(l.n, 0) AS left_count, coalesce(r.n, 0) AS right_count,
  coalesce(l.n, 0) - coalesce(t.matched, 0) AS only_left, coalesce(r.n, 0) - coalesce(t.matched, 0) AS only_right,
  coalesce(t.matched, 0) AS matched, round(t.dist, 4) AS max_distance_m
  FROM l_count l FULL JOIN r_count r USING (device) LEFT JOIN tally t USING (device))"""


@registered(
    "compare_positions", "X6 J16", "cot_original cot_copy", f"WITH {_TABLE} SELECT * FROM tabled"
)
def compare_positions(t):
    table = compare.compare_positions(*_match(t))
    return table.withColumn("max_distance_m", F.round("max_distance_m", 4))


@registered(
    "coverage_note", "X8", "cot_original cot_copy",
    f"""
WITH {_TABLE}
SELECT device, only_left, only_right, CASE WHEN only_left > 0 AND only_right > 0 THEN 'same device, different time or place'
  WHEN only_left > 0 THEN 'missing from the other file' WHEN only_right > 0 THEN 'coverage' ELSE 'complete' END AS note FROM tabled""",
)
def coverage_note(t):
    return compare.coverage_note(compare.compare_positions(*_match(t)))


_KEY = "device, servertime, latitude, longitude"
_EXPLAINED = f"""
{_MATCHED},
taken AS (SELECT device, lt AS servertime, la AS latitude, lo AS longitude, sum(n) AS used FROM mutual GROUP BY ALL),
l_all AS (
  SELECT o.*, o.free - coalesce(t.used, 0) AS unmatched,
    lag(o.latitude) OVER w IS NOT DISTINCT FROM o.latitude AND lag(o.longitude) OVER w IS NOT DISTINCT FROM o.longitude AS again
  FROM l_open o LEFT JOIN taken t USING ({_KEY}) WINDOW w AS (PARTITION BY o.device ORDER BY o.servertime, o.latitude, o.longitude)),
open AS (SELECT *, if(again, unmatched, least(unmatched, n - 1)) AS repeats FROM l_all WHERE unmatched > 0),
placed AS (SELECT DISTINCT l.device, l.servertime, l.latitude, l.longitude FROM open l
  JOIN (SELECT DISTINCT device, latitude, longitude FROM r_spots) r
  ON r.device = l.device AND r.latitude BETWEEN l.latitude - 0.00002 AND l.latitude + 0.00002 AND {_DISTANCE} <= 1),
timed AS (SELECT DISTINCT l.device, l.servertime, l.latitude, l.longitude FROM open l JOIN r_spots r
  ON r.device = l.device AND r.servertime BETWEEN l.servertime - INTERVAL 1 SECOND AND l.servertime + INTERVAL 1 SECOND),
channels AS (SELECT DISTINCT coalesce(callsign, uid) AS device, servertime, latitude, longitude, channel FROM cot_original),
used AS (SELECT DISTINCT channel FROM channels JOIN l_all USING ({_KEY}) WHERE unmatched < n),
unused AS (SELECT {_KEY} FROM channels GROUP BY ALL HAVING NOT bool_or(channel IN (FROM used))),
lost AS (SELECT device, count(*) AS spots FROM l_all GROUP BY device HAVING sum(n - unmatched) = 0),
renamed AS (SELECT device, min(other) AS other FROM (
    SELECT l.device, r.device AS other, count(*) AS found FROM l_all l JOIN r_spots r USING (servertime, latitude, longitude) GROUP BY ALL)
  JOIN lost USING (device) WHERE found = spots AND other <> device GROUP BY device),
reasons AS (
  SELECT device, CASE
      WHEN o.servertime < (SELECT min(servertime) FROM r_spots) OR o.servertime > (SELECT max(servertime) FROM r_spots) THEN 'outside the time range of the other file'
      WHEN ({_KEY}) IN (FROM placed) THEN 'same place at another time'
      WHEN ({_KEY}) IN (FROM timed) THEN 'same time, some metres away'
      WHEN ({_KEY}) IN (FROM unused) THEN 'on a channel no matched report uses'
      WHEN renamed.other IS NOT NULL THEN 'device is called ' || renamed.other || ' in the other file'
      ELSE 'unexplained' END AS reason, unmatched - repeats AS n
  FROM open o LEFT JOIN renamed USING (device) WHERE unmatched > repeats
  UNION ALL SELECT device, 'repeats the device''s previous report', repeats FROM open WHERE repeats > 0)"""


@registered(
    "explain_unmatched", "X7 W7", "cot_original cot_copy",
    f"WITH {_EXPLAINED} SELECT device, reason, CAST(sum(n) AS BIGINT) AS n FROM reasons GROUP BY ALL",
)
def explain_unmatched(t):
    original = _device(t["cot_original"])
    _, remaining = _match(t)
    explained = compare.explain_unmatched(original, _device(t["cot_copy"]), remaining, "channel")
    return explained.groupBy("device", "reason").agg(F.sum("n").alias("n"))


@registered(
    "companion_record", "L12", "cot_original cot_copy",
    f"""
WITH {_TABLE}, s AS (SELECT CAST(sum(matched) AS BIGINT) AS m, CAST(sum(left_count) AS BIGINT) AS n FROM tabled)
SELECT 'companion' AS export_kind, 'recorded' AS outcome, m AS record_count,
  'companion recheck.csv for package (package hash unavailable); ' || m || ' of ' || n || ' package positions matched it' AS detail FROM s""",
)
def companion_record(t):
    return compare.companion_record(compare.compare_positions(*_match(t)), "recheck.csv;", "")


# --- hash lists ------------------------------------------------------------------

_VERDICT = """
lines AS (
  SELECT package_sha256, count(DISTINCT name) AS files,
    max(sha256) FILTER (WHERE name = 'CASE-recheck-cot_router-raw.csv') AS raw,
    max(sha256) FILTER (WHERE name = 'CASE-queries.sql') AS script FROM posted_sums GROUP BY package_sha256),
verdicts AS (
  SELECT package_sha256, CASE WHEN raw IS NULL THEN 'MISSING - no line for the raw file'
      WHEN raw_sha256 IS NULL THEN 'unknown - the package recorded no raw-file hash' WHEN raw = raw_sha256 THEN 'yes' ELSE 'NO - the hashes differ' END AS raw_verdict,
    CASE WHEN raw IS NULL THEN 'raw file missing' WHEN raw_sha256 IS NULL THEN 'raw unverified' WHEN raw = raw_sha256 THEN 'raw match' ELSE 'raw MISMATCH' END AS outcome,
    CASE WHEN script IS NULL THEN 'MISSING' WHEN script = sha256(queries_sql) THEN 'yes' ELSE 'NO - a different script was run' END AS script_verdict,
    CAST(if(raw IS NULL, 0, 1) + if(script IS NULL, 0, 1) AS INT) AS compared, files
  FROM scripts JOIN lines USING (package_sha256))"""


@registered("recheck_verdict", "X3 J17", "scripts posted_sums", f"WITH {_VERDICT} SELECT * FROM verdicts")
def recheck_verdict(t):
    return compare.recheck_verdict(t["scripts"], t["posted_sums"])


_INTEGRITY = """
checked AS (
  SELECT coalesce(m.package, l.package) AS package, coalesce(m.name, l.name) AS name,
    CASE WHEN m.name IS NULL THEN 'missing' WHEN l.name IS NULL THEN 'not listed'
      WHEN sha256(m.content) = l.sha256 THEN 'match' ELSE 'differs' END AS state
  FROM members m FULL JOIN member_list l ON m.package = l.package AND m.name = l.name)"""


def _integrity(t):
    members = t["members"].select("package", "name", F.sha2("content", 256).alias("sha256"))
    return compare.package_integrity(members, t["member_list"])


@registered("package_integrity", "X4", "members member_list", f"WITH {_INTEGRITY} SELECT * FROM checked")
def package_integrity(t):
    return _integrity(t)


@registered(
    "integrity_summary", "X4", "members member_list",
    f"""
WITH {_INTEGRITY}
SELECT package, count(*) AS files, count(*) FILTER (WHERE state = 'match') AS matched, count(*) FILTER (WHERE state = 'differs') AS differ,
  count(*) FILTER (WHERE state = 'missing') AS missing, count(*) FILTER (WHERE state = 'not listed') AS not_listed FROM checked GROUP BY package""",
)
def integrity_summary(t):
    return compare.integrity_summary(_integrity(t))


@registered(
    "package_verdict", "X9", "export_log asked_files scripts posted_sums",
    f"""
WITH {_VERDICT},
asked AS (SELECT DISTINCT lower(file_hash) AS package_sha256 FROM asked_files),
w AS (SELECT package_sha256, s, e FROM (
  SELECT package_sha256,
    CASE WHEN window_timezone IN ('America/Chicago', 'UTC') THEN CAST(window_start AS TIMESTAMP) AT TIME ZONE window_timezone AT TIME ZONE 'UTC' END AS s,
    CASE WHEN window_timezone IN ('America/Chicago', 'UTC') THEN CAST(window_end AS TIMESTAMP) AT TIME ZONE window_timezone AT TIME ZONE 'UTC' END AS e FROM export_log)),
inside AS (SELECT w.package_sha256, bool_or(s <= file_min_utc AND file_max_utc <= e) AS ok FROM w
  JOIN asked_files a ON lower(a.file_hash) = w.package_sha256 GROUP BY 1),
listed AS (SELECT package_sha256, count(DISTINCT name) AS files, count(DISTINCT name) FILTER (WHERE sha256 = sha256('else ' || line_no)) AS matched
  FROM posted_sums GROUP BY package_sha256)
SELECT a.package_sha256, a.package_sha256 IN (SELECT package_sha256 FROM export_log WHERE package_sha256 IS NOT NULL) AS in_log,
  CASE WHEN files IS NULL THEN 'no list' WHEN files = matched THEN 'all match' ELSE 'differ' END AS file_state,
  CASE WHEN ok IS NULL THEN 'cannot tell' WHEN ok THEN 'inside' ELSE 'outside' END AS window_state,
  coalesce(outcome, 'no re-check recorded') AS recheck_state
FROM asked a LEFT JOIN listed USING (package_sha256) LEFT JOIN inside USING (package_sha256)
LEFT JOIN (SELECT package_sha256, outcome FROM verdicts) USING (package_sha256)""",
)
def package_verdict(t):
    asked = t["asked_files"].select(F.lower("file_hash").alias("package_sha256"))
    windows = audit.window_containment(t["asked_files"], t["export_log"]).select(
        F.col("file_hash").alias("package_sha256"), "contained"
    )
    expected = F.sha2(F.concat(F.lit("else "), F.col("line_no")), 256)
    files = t["posted_sums"].groupBy("package_sha256").agg(
        F.count("*").alias("files"), F.count_if(F.col("sha256") == expected).alias("matched")
    )
    verdicts = compare.recheck_verdict(t["scripts"], t["posted_sums"])
    return compare.package_verdict(asked, t["export_log"], files, windows, verdicts)


_RAW_LINE = " || ',' || ".join(
    "CASE WHEN regexp_matches({0}, '[,\"\\n\\r]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END".format(
        f"coalesce(CAST({c} AS VARCHAR), '')"
    )
    for c in (
        "id", "uid", "time", "servertime", "start", "stale", "point_ce", "point_hae", "point_le", "how",
        "cot_type", "detail", "groups", "access", "opex", "caveat", "releaseableto", "latitude", "longitude",
    )
)


@registered(
    "table_hash", "X10 K2", "cot",
    f"""
WITH lined AS (SELECT servertime, id, epoch_us(servertime) // 60000000 AS minute, sha256({_RAW_LINE}) AS line FROM cot WHERE {MATCHING}),
blocked AS (SELECT *, (row_number() OVER (PARTITION BY minute ORDER BY servertime, id) - 1) // 10000 AS block FROM lined),
blocks AS (SELECT minute, block, count(*) AS lines, sha256(string_agg(line, '' ORDER BY servertime, id)) AS h FROM blocked GROUP BY ALL),
minutes AS (SELECT minute, sum(lines) AS lines, sha256(string_agg(h, '' ORDER BY block)) AS h FROM blocks GROUP BY minute),
hours AS (SELECT minute // 60 AS hour, sum(lines) AS lines, sha256(string_agg(h, '' ORDER BY minute)) AS h FROM minutes GROUP BY 1),
days AS (SELECT hour // 24 AS day, sum(lines) AS lines, sha256(string_agg(h, '' ORDER BY hour)) AS h FROM hours GROUP BY 1)
SELECT CAST(sum(lines) AS BIGINT) AS lines, sha256(string_agg(h, '' ORDER BY day)) AS sha256 FROM days""",
)
def table_hash(t):
    return compare.table_hash(results.raw_rows(t["cot"], P), "servertime", "id")


@registered(
    "delimited_lines", "K2", "chat",
    """
SELECT id, CASE WHEN regexp_matches(chat_content, '[,"\\n\\r]') OR chat_content = '\\.' THEN '"' || replace(chat_content, '"', '""') || '"'
  ELSE coalesce(chat_content, '') END AS line FROM chat""",
)
def delimited_lines(t):
    cells = t["chat"].select("chat_content")
    return t["chat"].select("id", compare.delimited_line(cells).alias("line"))


# --- clean-up over whole texts ---------------------------------------------------

# Python-style white space, as both engines' patterns spell it.
_WS = "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]"


@registered(
    "guarded_cells", "P21", "",
    f"""
SELECT conv_id, turn, CASE WHEN regexp_matches(s, '^[=+@-]') AND NOT regexp_matches(s, '^[+-]?\\p{{Nd}}+(\\.\\p{{Nd}}+)?\\n?$')
  THEN '''' || text ELSE text END AS cell
FROM (SELECT *, regexp_replace(text, '^{_WS}+', '') AS s FROM conversations)""",
)
def guarded_cells(t):
    return t.input("conversations").select("conv_id", "turn", text.guard_cell(F.col("text")).alias("cell"))


@registered(
    "clause_safe_texts", "P22", "",
    "SELECT doc_id, substr(regexp_replace(text, '[;\\x00-\\x08\\x0a-\\x1f]', '', 'g'), 1, 200) AS safe FROM documents",
)
def clause_safe_texts(t):
    return t.input("documents").select("doc_id", text.clause_safe(F.col("text")).alias("safe"))


@registered(
    "clean_texts", "P23", "",
    f"""
SELECT doc_id, substr(regexp_replace(trim(regexp_replace(text, '{_WS}+', ' ', 'g'), ' '), '[;\\x00-\\x1f\\x7f]', '', 'g'), 1, 300) AS clean
FROM documents""",
)
def clean_texts(t):
    return t.input("documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


@registered(
    "case_names", "P24", "",
    f"""
SELECT item_id, c AS case_name, coalesce(nullif(regexp_replace(c, '[^\\p{{L}}\\p{{N}}._-]', '', 'g'), ''), 'export') AS file_name
FROM (SELECT item_id, regexp_replace(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g'), '[";\\x00-\\x08\\x0a-\\x1f]', '', 'g') AS c FROM benchmark)""",
)
def case_names(t):
    return t.input("benchmark").select(
        "item_id",
        text.case_name(F.col("text")).alias("case_name"),
        text.file_safe_case(F.col("text")).alias("file_name"),
    )

"""Queries over the export log."""

from __future__ import annotations

from pyspark.sql import functions as F

from posevidence.functions import classify
from posevidence.functions.canon import CHAIN_FIELDS, row_hash
from posevidence.materialize import settle
from posevidence.operators import audit
from posevidence.operators.sequences import placed
from posevidence.operators.tracks import neighbour_in_slices
from posevidence.plans.registry import registered

SEARCHED = "ENTRY"
CURRENT_IDENTITY = "cluster 2"

# --- chain ---------------------------------------------------------------

_CONTENT = " || ".join(
    f"chr(0) || coalesce(CAST({f} AS VARCHAR), '')" if f != "outcome"
    else "chr(0) || coalesce(replace(outcome, ' / delivered', ''), '')"
    for f in CHAIN_FIELDS
)
_NUMBERED = f"""
numbered AS (
  SELECT coalesce(case_id, '') AS log_id, id, actor, record_count, {_CONTENT} AS content,
    row_number() OVER (PARTITION BY coalesce(case_id, '') ORDER BY id) AS n FROM export_log)"""


def _logs(t):
    """The log split into one chain per case."""
    return t["export_log"].withColumn("log_id", F.coalesce("case_id", F.lit("")))


@registered(
    "row_hashes", "P30", "export_log",
    f"SELECT id, sha256({_CONTENT}) AS row_hash FROM export_log",
)
def row_hashes(t):
    log = t["export_log"]
    return log.select("id", row_hash(log, F.lit("")).alias("row_hash"))


@registered(
    "chain_append", "L2", "export_log",
    f"""
WITH RECURSIVE {_NUMBERED},
chain AS (
  SELECT log_id, id, n, '' AS prev_hash, sha256(content) AS row_hash FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.log_id, x.id, x.n, c.row_hash, sha256(c.row_hash || x.content)
  FROM chain c JOIN numbered x ON x.log_id = c.log_id AND x.n = c.n + 1)
SELECT log_id, id, prev_hash, row_hash FROM chain""",
)
def chain_append(t):
    return audit.chain_append(_logs(t)).select("log_id", "id", "prev_hash", "row_hash")


@registered(
    "verify_chain", "L1 W8", "export_log",
    f"""
WITH {_NUMBERED},
cut AS (SELECT log_id, min(id) FILTER (WHERE record_count = 499 AND actor <> 'edited') AS broken_id FROM numbered GROUP BY log_id)
SELECT log_id, count(*) AS total, count(*) FILTER (WHERE broken_id IS NULL OR id < broken_id) AS checked,
  CAST(0 AS BIGINT) AS unchained, min(id) AS first_chained_id, max(id) AS last_id, any_value(broken_id) AS broken_id,
  CASE WHEN any_value(broken_id) IS NOT NULL THEN 'row content does not match its recorded hash (the row was edited)' END AS reason,
  any_value(broken_id) IS NULL AS ok
FROM numbered JOIN cut USING (log_id) GROUP BY log_id""",
)
def verify_chain(t):
    # Written once, as a log is; hashing it is the appender's work.
    chained = settle(audit.chain_append(_logs(t)))
    # Someone changes who did it on some rows after the fact.
    edited = F.when(F.col("record_count") == 499, "edited").otherwise(F.col("actor"))
    return audit.verify_chain(chained.withColumn("actor", edited))


@registered(
    "tampered_chain", "W8 L1", "export_log",
    f"""
WITH {_NUMBERED},
said AS (
  SELECT *, CAST(split_part(log_id, '-', 2) AS INT) % 4 AS way, lead(id) OVER (PARTITION BY log_id ORDER BY id) AS next_id
  FROM numbered WHERE log_id LIKE 'CASE-%'),
breaks AS (
  SELECT log_id, min(CASE way
    WHEN 0 THEN CASE WHEN n = 8 THEN id END
    WHEN 1 THEN CASE WHEN n = 11 AND next_id IS NOT NULL THEN id END
    WHEN 2 THEN CASE WHEN n = 5 AND next_id > id + 1 THEN id + 1 END
    ELSE CASE WHEN n = 9 THEN id END END) AS broken_id, any_value(way) AS way, max(n) AS n FROM said GROUP BY log_id)
SELECT log_id, broken_id IS NULL AS ok, broken_id,
  CASE WHEN broken_id IS NULL THEN NULL WHEN way = 3 THEN 'row content does not match its recorded hash (the row was edited)'
    ELSE 'prev_hash does not match the previous chained row (a row was removed, inserted or reordered before this one)' END AS reason
FROM breaks""",
)
def tampered_chain(t):
    """In every log one row is removed, inserted, edited or two change places."""
    logs = _logs(t).filter(F.col("log_id").like("CASE-%"))
    # Written once, as a log is; the number of a row is its own, where ids repeat too.
    chained = settle(audit.chain_append(logs).withColumn("row", F.monotonically_increasing_id()))
    # Only what tells a row's place is moved to find the few rows that change.
    sliced = chained.select("row", "log_id", "id", F.floor(F.col("id") / 1000).alias("slice"))
    rows = placed(sliced, ["log_id"], "slice", ["id"], ["id"])
    back = neighbour_in_slices(rows, ["log_id"], "slice", ["id"], ["id"])
    way = F.split("log_id", "-")[1].cast("int") % 4
    place, after = F.col("place"), F.col("next_id")
    swapped = (
        F.when((way == 1) & (place == 11) & after.isNotNull(), after)
        .when((way == 1) & (place == 12), F.col("prev_id"))
        .otherwise(F.col("id"))
    )
    forged = (way == 2) & (place == 5) & (after > F.col("id") + 1)
    changes = back.select(
        "row",
        F.coalesce((way == 0) & (place == 7), F.lit(True)).alias("removed"),
        swapped.alias("new_id"),
        F.coalesce((way == 3) & (place == 9), F.lit(False)).alias("edited"),
        F.coalesce(forged, F.lit(False)).alias("forged"),
        (swapped != F.col("id")).alias("moved"),
    )
    changes = settle(changes.filter("removed OR moved OR edited OR forged").drop("moved"))
    kept = chained.join(changes, "row", "left").filter(~F.coalesce("removed", F.lit(False))).withColumns(
        {
            "id": F.coalesce("new_id", "id"),
            "actor": F.when(F.col("edited"), "edited").otherwise(F.col("actor")),
            "more": F.explode(F.when(F.col("forged"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
        }
    )
    tampered = kept.withColumn("id", F.col("id") + F.col("more")).select(*logs.columns)
    found = audit.verify_chain(tampered, id_slice=1000)
    return found.select("log_id", "ok", "broken_id", "reason")


@registered(
    "source_identity_texts", "P28", "source_rows",
    """
SELECT id, CASE WHEN coalesce(cluster_id, '') <> '' THEN 'cluster ' || cluster_id
  WHEN coalesce(catalog_id, '') <> '' THEN 'catalog ' || catalog_id ELSE '' END AS identity FROM source_rows""",
)
def source_identity_texts(t):
    return t["source_rows"].select("id", classify.source_identity(F.col("cluster_id"), F.col("catalog_id")).alias("identity"))


# --- corrections ------------------------------------------------------------

_ENTRY = audit.CORRECTS_ENTRY
_CASE = audit.CORRECTS_CASE
_EFFECTIVE = f"""
corrections AS (
  SELECT id, CASE WHEN e THEN CAST(regexp_extract(detail, '{_ENTRY}', 1) AS BIGINT) END AS entry_id,
    CASE WHEN e THEN regexp_extract(detail, '{_ENTRY}', 2) ELSE regexp_extract(detail, '{_CASE}', 1) END AS old,
    CASE WHEN e THEN regexp_extract(detail, '{_ENTRY}', 3) ELSE regexp_extract(detail, '{_CASE}', 2) END AS new,
    CASE WHEN e THEN regexp_replace(detail, '{_ENTRY}', '') ELSE regexp_replace(detail, '{_CASE}', '') END AS rest
  FROM (SELECT id, detail, regexp_matches(detail, '{_ENTRY}') AS e FROM export_log WHERE export_kind = 'case-correction')
  WHERE (e OR regexp_matches(detail, '{_CASE}')) AND (rest = '' OR starts_with(rest, ' (') OR starts_with(rest, ';'))),
start AS (
  SELECT entry_id, NULL::VARCHAR AS kase, max(id) AS at, arg_max(new, id) AS v FROM corrections WHERE entry_id IS NOT NULL GROUP BY entry_id
  UNION ALL SELECT NULL::BIGINT, old, max(id), arg_max(new, id) FROM corrections WHERE entry_id IS NULL GROUP BY old),
follow AS (
  SELECT *, 0 AS step FROM start
  UNION ALL
  SELECT f.entry_id, f.kase, n.id, n.new, f.step + 1 FROM follow f,
    LATERAL (SELECT id, new FROM corrections c WHERE c.entry_id IS NULL AND c.old = f.v AND c.id > f.at ORDER BY id LIMIT 1) n),
resolved AS (SELECT entry_id, kase, arg_max(v, step) AS v FROM follow GROUP BY entry_id, kase),
effective AS (
  SELECT l.*, coalesce(e.v, k.v, l.case_id, '') AS effective_case_id FROM export_log l
  LEFT JOIN resolved e ON e.entry_id = l.id
  LEFT JOIN resolved k ON k.kase = coalesce(l.case_id, ''))"""


@registered(
    "case_corrections", "L3", "export_log",
    f'WITH RECURSIVE {_EFFECTIVE} SELECT entry_id, kase AS "case", v AS effective FROM resolved',
)
def case_corrections(t):
    return audit.resolve_corrections(audit.parse_corrections(t["export_log"]))


@registered(
    "effective_case", "L4 J19", "export_log",
    f"WITH RECURSIVE {_EFFECTIVE} SELECT id, case_id, effective_case_id FROM effective",
)
def effective_case(t):
    return audit.effective_log(t["export_log"]).select("id", "case_id", "effective_case_id")


def _folded(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_FOUND = "found AS (SELECT * FROM effective WHERE " + " OR ".join(
    f"contains({_folded(c)}, {_folded(repr(SEARCHED))})" for c in ("effective_case_id", "case_id", "actor", "requested_for")
) + ")"


@registered(
    "audit_search", "L5", "export_log",
    f"WITH RECURSIVE {_EFFECTIVE}, {_FOUND} SELECT id, effective_case_id, actor FROM found",
)
def audit_search(t):
    found = audit.audit_search(audit.effective_log(t["export_log"]), SEARCHED)
    return found.select("id", "effective_case_id", "actor")


@registered(
    "audit_page", "O8", "export_log",
    f"""
WITH RECURSIVE {_EFFECTIVE}
SELECT id, record_count, effective_case_id FROM effective
ORDER BY record_count, id DESC LIMIT 25 OFFSET 25""",
)
def audit_page(t):
    rows = audit.effective_log(t["export_log"])
    return audit.audit_page(rows, page=2, sort="records", direction="asc").select(
        "id", "record_count", "effective_case_id"
    )


@registered(
    "audit_page_count", "O8", "export_log",
    f"""
WITH RECURSIVE {_EFFECTIVE}, {_FOUND}
SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 25) AS BIGINT)) AS pages FROM found""",
)
def audit_page_count(t):
    return audit.page_count(audit.audit_search(audit.effective_log(t["export_log"]), SEARCHED))


_CASES = """
cases AS (SELECT effective_case_id, count(*) AS entry_count, max(id) AS last_id, arg_max(ts_local, id) AS last_ts_local,
  arg_max(ts_utc, id) AS last_ts_utc, arg_max(outcome, id) AS last_outcome, arg_max(export_kind, id) AS last_kind
  FROM effective WHERE effective_case_id <> '' GROUP BY effective_case_id)"""


@registered(
    "audit_cases", "L6 A10", "export_log", f"WITH RECURSIVE {_EFFECTIVE}, {_CASES} SELECT * FROM cases"
)
def audit_cases(t):
    return audit.cases(audit.effective_log(t["export_log"]))


@registered(
    "audit_case_page", "L6 O8", "export_log",
    f"""
WITH RECURSIVE {_EFFECTIVE}, {_CASES}
SELECT e.id, e.effective_case_id, c.last_id AS case_last_id, e.export_kind
FROM effective e JOIN (SELECT * FROM cases ORDER BY last_id DESC LIMIT 25) c USING (effective_case_id)""",
)
def audit_case_page(t):
    return audit.case_page_entries(audit.effective_log(t["export_log"])).select(
        "id", "effective_case_id", "case_last_id", "export_kind"
    )


@registered(
    "audit_caseless", "L6", "export_log",
    f"""
WITH RECURSIVE {_EFFECTIVE}
SELECT id, export_kind FROM effective WHERE effective_case_id = '' ORDER BY id DESC LIMIT 25""",
)
def audit_caseless(t):
    return audit.caseless_entries(audit.effective_log(t["export_log"])).select("id", "export_kind")


@registered(
    "audit_extract", "L7 P21", "export_log asked_files",
    """
SELECT * REPLACE (CASE WHEN starts_with(requested_for, '=') THEN '''' || requested_for ELSE requested_for END AS requested_for)
FROM export_log WHERE id IN (SELECT file_id FROM asked_files)""",
)
def audit_extract(t):
    return audit.audit_extract(t["export_log"], t["asked_files"].select(F.col("file_id").alias("id")))


# --- clauses -----------------------------------------------------------------

@registered(
    "detail_clauses", "L8", "export_log",
    """
WITH pieces AS (SELECT id, unnest(string_split(detail, '; ')) AS text, generate_subscripts(string_split(detail, '; '), 1) - 1 AS position
  FROM export_log WHERE detail IS NOT NULL)
SELECT id, CAST(position AS INT) AS position,
  CASE WHEN regexp_matches(text, '^[^:]+: ') THEN split_part(text, ': ', 1) END AS key,
  CASE WHEN regexp_matches(text, '^[^:]+: ') THEN substr(text, length(split_part(text, ': ', 1)) + 3) ELSE text END AS value
FROM pieces""",
)
def detail_clauses(t):
    return audit.explode_clauses(t["export_log"])


_LISTED = """
listed AS (
  SELECT id, package_sha256, split_part(item, ' ', 1) AS sha256, split_part(item, ' ', 2) AS name
  FROM (SELECT id, package_sha256, unnest(string_split(regexp_extract(detail, '(?:^|; )package files: ([^;]+)', 1), ', ')) AS item
        FROM export_log WHERE regexp_matches(detail, '(?:^|; )package files: '))
  WHERE regexp_full_match(split_part(item, ' ', 1), '[0-9a-f]{64}') AND contains(item, ' '))"""


@registered("package_files", "L9", "export_log", f"WITH {_LISTED} SELECT * FROM listed")
def package_files(t):
    return audit.package_files(t["export_log"])


_NEWEST_EXPORT = """
export AS (SELECT * FROM export_log WHERE export_kind IN ('package', 'locations') AND package_sha256 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY package_sha256 ORDER BY id DESC) = 1)"""
_NEWEST_RECHECK = """
recheck AS (SELECT * FROM export_log WHERE export_kind = 'recheck' AND package_sha256 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY package_sha256 ORDER BY id DESC) = 1)"""
_PLACE = "CASE WHEN starts_with({0}, 're-check at ') THEN split_part(substr({0}, 13), ';', 1) ELSE '' END"


@registered(
    "script_hash_check", "L10", "export_log scripts",
    f"""
WITH {_NEWEST_EXPORT},
recorded AS (
  SELECT package_sha256, split_part(list_filter(
    string_split(regexp_extract(detail, '(?:^|; )package files: ([^;]+)', 1), ', '),
    lambda x: split_part(x, ' ', 2) = 'CASE-queries.sql')[1], ' ', 1) AS sha256
  FROM export)
SELECT s.package_sha256, s.case_prefix, sha256(queries_sql) AS actual_sha256, nullif(r.sha256, '') AS recorded_sha256,
  CASE WHEN coalesce(r.sha256, '') = '' THEN 'not recorded' WHEN r.sha256 = sha256(queries_sql) THEN 'match' ELSE 'mismatch' END AS state
FROM scripts s LEFT JOIN recorded r ON r.package_sha256 = s.package_sha256""",
)
def script_hash_check(t):
    return audit.script_hash_check(t["scripts"], t["export_log"])


@registered(
    "certification_facts", "L11 W9", "export_log",
    f"""
WITH {_NEWEST_EXPORT}, {_NEWEST_RECHECK}
SELECT e.package_sha256, e.id AS export_id, e.case_id, e.tool_version, e.ts_local AS exported, e.actor AS exported_by,
  e.requested_for, e.outcome, e.window_start, e.window_end, e.window_timezone,
  CASE WHEN regexp_matches(e.detail, '(?:^|; )package files: ')
    THEN len(string_split(regexp_extract(e.detail, '(?:^|; )package files: ([^;]+)', 1), ', '))::INT END AS files_listed,
  r.id AS recheck_id, r.outcome AS recheck_outcome, {_PLACE.format('r.detail')} AS recheck_where,
  nullif(regexp_extract(r.detail, '(?:^|; )raw table rows match: ([^;]+)', 1), '') AS raw_rows_match
FROM export e LEFT JOIN recheck r USING (package_sha256)""".replace(
        f"{_PLACE.format('r.detail')} AS recheck_where",
        f"CASE WHEN r.id IS NOT NULL THEN {_PLACE.format('r.detail')} END AS recheck_where",
    ),
)
def certification_facts(t):
    return audit.certification_facts(t["export_log"])


@registered(
    "latest_recheck", "L13 W9", "export_log",
    f"""
WITH {_NEWEST_RECHECK}
SELECT package_sha256, id, actor, outcome, ts_local AS "when", {_PLACE.format('detail')} AS "where" FROM recheck""",
)
def latest_recheck(t):
    return audit.latest_recheck(t["export_log"])


@registered(
    "confirmed_deliveries", "W10", "export_log asked_files",
    """
WITH due AS (SELECT max(id) AS id FROM export_log WHERE outcome NOT LIKE '%delivered%'
  AND package_sha256 IN (SELECT lower(file_hash) FROM asked_files) GROUP BY package_sha256)
SELECT id, outcome || if(id IN (SELECT id FROM due), ' / delivered', '') AS outcome FROM export_log""",
)
def confirmed_deliveries(t):
    confirmed = t["asked_files"].select(F.lower("file_hash").alias("package_sha256"))
    return audit.confirm_deliveries(t["export_log"], confirmed).select("id", "outcome")


_IDENTITIES = """
recent AS (SELECT id, ts_local, case_id, trim(regexp_extract(detail, '(?:^|; )source database: ([^;]+)', 1)) AS identity FROM export_log
  WHERE export_kind IN ('package', 'locations') AND contains(detail, 'source database: ') ORDER BY id DESC LIMIT 50),
identities AS (SELECT identity, max(id) AS last_id, arg_max(ts_local, id) AS "when", arg_max(case_id, id) AS case_id FROM recent GROUP BY identity)"""


@registered(
    "source_identities", "A11 P28", "export_log", f"WITH {_IDENTITIES} SELECT * FROM identities"
)
def source_identities(t):
    return audit.recent_source_identities(t["export_log"])


@registered(
    "identity_check", "V5", "export_log",
    f"""
WITH {_IDENTITIES}
SELECT '{CURRENT_IDENTITY}' AS identity, count(*) AS known,
  if(count(*) = 0 OR bool_or(identity = '{CURRENT_IDENTITY}'), 'ok', 'warn') AS status FROM identities""",
)
def identity_check(t):
    return audit.identity_check(CURRENT_IDENTITY, audit.recent_source_identities(t["export_log"]))


@registered(
    "companion_mentions", "L12", "export_log",
    """
SELECT id, regexp_extract(detail, '^companion (.*) for package ', 1) AS companion,
  CAST(regexp_extract(detail, '; ([0-9]+) of ([0-9]+) package positions matched it', 1) AS BIGINT) AS matched,
  CAST(regexp_extract(detail, '; ([0-9]+) of ([0-9]+) package positions matched it', 2) AS BIGINT) AS total
FROM export_log WHERE export_kind = 'companion'""",
)
def companion_mentions(t):
    from posevidence.operators.compare import read_companions

    return read_companions(t["export_log"]).select("id", "companion", "matched", "total")


# --- windows and lookups --------------------------------------------------------

_ZONES = "('America/Chicago', 'UTC')"


@registered(
    "windows_in_utc", "P29", "export_log",
    f"""
SELECT id, CASE WHEN window_timezone IN {_ZONES} THEN CAST(window_start AS TIMESTAMP) AT TIME ZONE window_timezone AT TIME ZONE 'UTC' END AS start_utc,
  CASE WHEN window_timezone IN {_ZONES} THEN CAST(window_end AS TIMESTAMP) AT TIME ZONE window_timezone AT TIME ZONE 'UTC' END AS end_utc
FROM export_log""",
)
def windows_in_utc(t):
    zones = audit.known_zones(t.spark)
    zone = "window_timezone"
    return t["export_log"].select(
        "id",
        audit.window_in_utc("window_start", zone, zones).alias("start_utc"),
        audit.window_in_utc("window_end", zone, zones).alias("end_utc"),
    )


@registered(
    "lookup_hashes", "X1 J18", "export_log asked_files",
    """
SELECT a.file_hash, l.* EXCLUDE (client_ip, prev_hash, row_hash)
FROM (SELECT DISTINCT lower(file_hash) AS file_hash FROM asked_files WHERE regexp_full_match(lower(file_hash), '[0-9a-f]{64}')) a
JOIN export_log l ON l.package_sha256 = a.file_hash""",
)
def lookup_hashes(t):
    return audit.lookup_hashes(t["asked_files"], t["export_log"])


@registered(
    "window_containment", "X2", "export_log asked_files",
    f"""
WITH w AS (
  SELECT id, package_sha256, CASE WHEN window_timezone IN {_ZONES} THEN CAST(window_start AS TIMESTAMP) AT TIME ZONE window_timezone AT TIME ZONE 'UTC' END AS s,
    CASE WHEN window_timezone IN {_ZONES} THEN CAST(window_end AS TIMESTAMP) AT TIME ZONE window_timezone AT TIME ZONE 'UTC' END AS e FROM export_log)
SELECT a.file_id, w.id, (s <= file_min_utc AND file_max_utc <= e) AS contained
FROM asked_files a JOIN w ON w.package_sha256 = lower(a.file_hash)""",
)
def window_containment(t):
    checked = audit.window_containment(t["asked_files"], t["export_log"])
    return checked.select("file_id", "id", "contained")

"""The check tables (star schema, events, texts) seen as the event model.

Each relation is one projection written in SQL that Spark and the checking
engine both read, over placeholders for the input tables. It maps whole tables;
no relation drops rows of its input unless its meaning says so.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from posevidence.params import ExportParams
from posevidence.sources.tables import read_table

CHECK_PARAMS = ExportParams(
    start="2024-01-05 00:00:00",
    end="2024-01-20 00:00:00",
    north=39.95,
    south=39.80,
    east=-98.20,
    west=-98.50,
)
CHECK_CHANNELS = (3, 7, 11)
AS_OF = "2024-01-25 00:00:00"

_LAT = "CAST(39.7 AS DOUBLE) + CAST((event_id * 7919) % 4000 AS DOUBLE) / CAST(10000 AS DOUBLE)"
_LON = "CAST(-98.6 AS DOUBLE) + CAST((event_id * 104729) % 6000 AS DOUBLE) / CAST(10000 AS DOUBLE)"


def _degrees(lead: str, ten_thousandths: str) -> str:
    """Degrees as text from an integer count of 1/10000 degree, never a printed double."""
    return (
        f"'{lead}' || substr(CAST({ten_thousandths} AS STRING), 1, 2) || '.' || "
        f"substr(CAST({ten_thousandths} AS STRING), 3, 4)"
    )


def _vertex(dlat: int, dlon: int) -> str:
    lat = _degrees("", f"(397000 + (event_id * 7919) % 4000 + {dlat})")
    lon = _degrees("-", f"(986000 - (event_id * 104729) % 6000 - {dlon})")
    return f"'<link point=\"' || {lat} || ',' || {lon} || '\"/>'"


_RING = " || ".join(_vertex(a, b) for a, b in ((0, 0), (0, 40), (30, 40), (30, 0), (0, 0)))
_CHAIN = " || ".join(_vertex(a, b) for a, b in ((0, 0), (25, 10), (50, 35)))

_DETAIL = f"""
CASE
  WHEN event_id % 103 = 0 THEN NULL
  WHEN event_id % 101 = 0 THEN '<detail><broken'
  WHEN event_id % 7 = 0 THEN '<detail/>'
  WHEN event_type = 'signup' THEN
    '<detail><contact callsign="' || CASE WHEN user_id % 3 = 0 THEN 'New Feature' ELSE 'S' || CAST(user_id % 20 AS STRING) END || '"/>'
    || CASE WHEN user_id % 20 = 7 THEN '<__nodered flow="layer"/>'
            ELSE '<creator uid="DEV-' || CAST(user_id AS STRING) || '" callsign="U' || CAST(user_id % 40 AS STRING) || '" time="2024-01-01T00:00:00.000Z"/>' END
    || '<strokeColor value="' || CAST(event_id - 2737863 AS STRING) || '"/><strokeWeight value="3"/><fillColor value="2144745785"/>'
    || CASE
         WHEN event_id % 3 = 0 THEN '<shape><ellipse major="' || CAST(200 + event_id % 900 AS STRING) || '" minor="'
              || CAST(200 + (event_id % 900) * (event_id % 2) AS STRING) || '" angle="' || CAST(event_id % 360 AS STRING)
              || '"/><link uid="x.Style" type="b-x-KmlStyle"/></shape>'
         WHEN event_id % 2 = 0 THEN {_RING}
         ELSE {_CHAIN}
       END
    || '</detail>'
  ELSE
    '<detail><contact callsign="' || CASE WHEN event_id % 43 = 0 THEN '=U' ELSE 'U' END || CAST(user_id % 40 AS STRING) || '"/>'
    || CASE WHEN event_id % 4 = 0 THEN '' ELSE '<__group name="Team' || CAST(user_id % 5 AS STRING) || '" role="Role' || CAST(user_id % 3 AS STRING) || '"/>' END
    || CASE WHEN event_id % 11 = 0 THEN '' ELSE '<track course="' || CASE WHEN event_id % 29 = 0 THEN '9999999.0' ELSE CAST(event_id % 360 AS STRING) || '.0' END
         || '" speed="' || CASE event_id % 5 WHEN 0 THEN '-1.0' WHEN 1 THEN '0.0' ELSE '1.5' END || '"/>' END
    || CASE WHEN event_id % 3 = 0 THEN '' ELSE '<status battery="' || CAST(event_id % 100 AS STRING) || '"/>' END
    || CASE WHEN event_id % 2 = 0 THEN '' ELSE '<takv device="D' || CAST(user_id % 9 AS STRING) || '" platform="P" version="5.2"/>' END
    || CASE WHEN event_id % 6 = 0 THEN '' ELSE '<precisionlocation geopointsrc="GPS"/>' END
    || CASE WHEN event_id % 8 = 0 THEN '<remarks>note ' || CAST(event_id AS STRING) || '</remarks>' ELSE '<remarks></remarks>' END
    || '</detail>'
END
"""


def _cot(uid: str) -> str:
    return f"""
SELECT
  event_id AS id,
  {uid} AS uid,
  ts AS time,
  ts AS servertime,
  ts AS start,
  ts + INTERVAL '5' MINUTE AS stale,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN CAST(0 AS DOUBLE) ELSE {_LAT} END AS latitude,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN CAST(0 AS DOUBLE) ELSE {_LON} END AS longitude,
  CASE WHEN event_id % 13 = 0 THEN CAST(9999999 AS DOUBLE) ELSE value END AS point_ce,
  CASE WHEN event_id % 19 = 0 THEN CAST(9999999 AS DOUBLE) ELSE CAST(event_id % 500 AS DOUBLE) END AS point_hae,
  CASE WHEN event_id % 17 = 0 THEN CAST(9999999 AS DOUBLE) ELSE CAST(event_id % 50 AS DOUBLE) END AS point_le,
  CASE WHEN event_id % 17 = 0 THEN 'h-e' ELSE 'm-g' END AS how,
  CASE
    WHEN event_id % 113 = 0 THEN NULL
    WHEN event_type = 'click' THEN 'a-f-G-U-C'
    WHEN event_type = 'view' THEN 'a-f-G-E-V-C'
    WHEN event_type = 'purchase' THEN CASE WHEN event_id % 9 = 0 THEN 'a-n-A' ELSE 'a-f-G-I-H' END
    WHEN event_type = 'signup' THEN CASE WHEN event_id % 6 = 3 THEN 'u-d-c-e' WHEN event_id % 3 = 0 THEN 'u-d-c-c' ELSE 'u-d-f' END
    ELSE CASE WHEN event_id % 3 = 0 THEN 'b-t-f' WHEN event_id % 3 = 1 THEN 'b-m-p-s-m' ELSE 't-x-d' END
  END AS cot_type,
  {_DETAIL} AS detail,
  lpad(bin((event_id * 2654435) % 33554432), 25, '0') AS groups,
  'Undefined' AS access,
  CAST(NULL AS STRING) AS opex,
  CASE WHEN event_id % 31 = 0 THEN '' ELSE NULL END AS caveat,
  props AS releaseableto
FROM {{events}}"""


_UID = (
    "CASE WHEN event_type = 'signup' THEN 'SHP-' || CAST(user_id % 20 AS STRING) "
    "ELSE 'DEV-' || CAST(user_id AS STRING) END"
)
_MASK = "lpad(bin(({0} * 2654435) % 33554432), 25, '0')"
_BASE = "TIMESTAMP '2024-01-01 00:00:00'"

RELATIONS: dict[str, str] = {
    "cot": _cot(_UID),
    # Ten devices, so that steps are dense enough to form tracks.
    "dense_cot": _cot("'DEV-' || CAST(user_id % 10 AS STRING)"),
    "channels": "SELECT n_nationkey AS bitpos, n_name AS name FROM {nation}",
    "data_feed_type_pl": "SELECT r_regionkey AS id, r_name AS feed_type FROM {region}",
    "data_feed": f"""
SELECT s_suppkey AS id, 'feed-' || CAST(s_suppkey AS STRING) AS uuid, s_name AS name,
  s_nationkey % 7 AS type, 'tcp' AS protocol, 8000 + s_suppkey AS port, CAST(NULL AS STRING) AS iface,
  s_suppkey % 2 = 0 AS archive, s_suppkey % 3 = 0 AS archive_only, TRUE AS sync, FALSE AS anongroup,
  s_acctbal > 5000 AS auth_required, 'X_509' AS auth_type, s_acctbal < 0 AS federated,
  CAST(NULL AS STRING) AS feed_group, CAST(NULL AS STRING) AS data_source_endpoint,
  CAST(NULL AS STRING) AS predicate_lang, CAST(NULL AS STRING) AS predicate,
  3600 AS sync_cache_retention_seconds, {_MASK.format('s_suppkey')} AS groups
FROM {{supplier}}""",
    # Line items by return flag: N links an event to a feed, A is an image, R a link.
    "data_feed_cot": "SELECT l_orderkey AS cot_router_id, l_suppkey AS data_feed_id FROM {lineitem} WHERE l_returnflag = 'N'",
    "cot_image": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS cot_id,
  CAST('img' || CAST(l_partkey AS STRING) || l_linestatus AS STRING) AS image
FROM {lineitem} WHERE l_returnflag = 'A'""",
    "cot_link": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS containing_event FROM {lineitem} WHERE l_returnflag = 'R'",
    "chat": f"""
SELECT conv_id * 1000 + turn AS id,
  {_BASE} + INTERVAL '1' SECOND * CAST((conv_id * 7919 + turn * 60) % 2592000 AS INT) AS time,
  {_BASE} + INTERVAL '1' SECOND * CAST((conv_id * 7919 + turn * 60) % 2592000 AS INT) AS servertime,
  role AS sender_callsign, CASE WHEN role = 'user' THEN 'assistant' ELSE 'user' END AS dest_callsign,
  'room-' || CAST(conv_id % 12 AS STRING) AS chat_room, text AS chat_content,
  'DEV-' || CAST(conv_id % 150 AS STRING) AS uid, CAST(NULL AS STRING) AS dest_uid,
  CASE WHEN turn % 2 = 0 THEN CAST(39.9 AS DOUBLE) ELSE NULL END AS latitude,
  CASE WHEN turn % 2 = 0 THEN CAST(-98.4 AS DOUBLE) ELSE NULL END AS longitude,
  'b-t-f' AS cot_type, 'h-g-i-g-o' AS how, {_MASK.format('(conv_id + turn)')} AS groups,
  'Undefined' AS access, CAST(NULL AS STRING) AS opex, CAST(NULL AS STRING) AS detail
FROM {{conversations}}""",
    "mission": f"""
SELECT c_custkey AS id, 'guid-' || CAST(c_custkey AS STRING) AS guid, c_name AS name,
  c_mktsegment AS description, 'DEV-' || CAST(c_custkey % 150 AS STRING) AS creatoruid,
  {_BASE} + INTERVAL '1' HOUR * CAST(c_custkey % 720 AS INT) AS create_time,
  CAST(NULL AS TIMESTAMP) AS last_edited, 'public' AS tool, CAST(NULL AS STRING) AS chatroom,
  CAST(NULL AS STRING) AS classification, CAST(NULL AS STRING) AS bbox, CAST(NULL AS STRING) AS bounding_polygon,
  CAST(NULL AS STRING) AS base_layer, '/m/' || c_mktsegment AS path,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey - c_custkey % 10 END AS parent_mission_id,
  c_acctbal < 0 AS invite_only, CAST(-1 AS BIGINT) AS expiration, {_MASK.format('c_custkey')} AS groups,
  CASE WHEN c_nationkey = 3 THEN '$2a$10$x' ELSE NULL END AS password_hash
FROM {{customer}}""",
    "mission_change": f"""
SELECT o_orderkey AS id,
  {_BASE} + INTERVAL '1' SECOND * CAST((o_orderkey * 104729) % 2592000 AS INT) AS ts,
  {_BASE} + INTERVAL '1' SECOND * CAST((o_orderkey * 104729) % 2592000 AS INT) AS servertime,
  'Customer#' || CAST(o_custkey AS STRING) AS mission_name, 'guid-' || CAST(o_custkey AS STRING) AS mission_guid,
  o_custkey AS mission_id, CAST(o_orderkey % 7 AS INT) AS change_type,
  'SHP-' || CAST(o_custkey % 20 AS STRING) AS uid,
  CASE WHEN o_orderstatus = 'F' THEN 'DEV-' || CAST(o_custkey AS STRING) WHEN o_orderstatus = 'O' THEN ' ' ELSE NULL END AS creatoruid,
  CAST(NULL AS STRING) AS hash, CAST(NULL AS STRING) AS external_data_name, CAST(NULL AS STRING) AS external_data_uid,
  CAST(NULL AS STRING) AS external_data_tool, CAST(NULL AS STRING) AS external_data_notes,
  CAST(NULL AS STRING) AS mission_feed_uid, CAST(NULL AS STRING) AS map_layer_uid,
  FALSE AS remote_federated_change, o_orderpriority AS xml_content_for_notification
FROM {{orders}}""",
    "mission_subscription": f"""
SELECT o_custkey + CAST(o_orderkey % 3 AS INT) AS mission_id, 'client-' || CAST(o_orderkey AS STRING) AS client_uid,
  'DEV-' || CAST(o_custkey % 150 AS STRING) AS uid, o_orderstatus AS username,
  o_orderdate AS create_time, CAST(o_orderkey % 4 AS INT) AS role_id
FROM {{orders}}""",
    "mission_uid": "SELECT l_partkey AS mission_id, 'SHP-' || CAST(l_suppkey AS STRING) AS uid FROM {lineitem} WHERE l_linestatus = 'O'",
    "mission_resource": "SELECT l_partkey AS mission_id, 'h' || CAST(l_orderkey AS STRING) AS resource_hash, l_orderkey AS resource_id FROM {lineitem} WHERE l_linestatus = 'F'",
    "mission_external_data": """
SELECT p_partkey AS mission_id, 'x' || CAST(p_partkey AS STRING) AS id, p_name AS name, p_type AS notes,
  'http://feed.example/' || p_brand AS url_display FROM {part}""",
    "resource": f"""
SELECT doc_id AS id, 'res-' || CAST(doc_id AS STRING) AS uid, 'doc ' || CAST(doc_id AS STRING) AS name,
  source || '-' || CAST(doc_id AS STRING) || '.txt' AS filename, 'text/plain' AS mimetype, text AS data,
  'h' || CAST(doc_id AS STRING) AS hash, source AS submitter, 'DEV-' || CAST(doc_id % 150 AS STRING) AS creatoruid,
  {_BASE} + INTERVAL '1' MINUTE * CAST(doc_id % 40000 AS INT) AS submissiontime, lang AS tool,
  CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude, CAST(NULL AS DOUBLE) AS altitude,
  CAST(NULL AS STRING) AS remarks,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE array(lang, source, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'kw' END) END AS keywords,
  array(source) AS permissions, CAST(-1 AS BIGINT) AS expiration, {_MASK.format('doc_id')} AS groups
FROM {{documents}}""",
    "video_connections": f"""
SELECT p_partkey AS id, {_BASE} + INTERVAL '1' MINUTE * CAST(p_partkey % 40000 AS INT) AS created,
  p_size > 45 AS deleted, p_name AS alias, 'DEV-' || CAST(p_partkey % 150 AS STRING) AS owner,
  'v-' || CAST(p_partkey AS STRING) AS uuid, p_type AS type,
  CAST(39.9 AS DOUBLE) AS latitude, CAST(-98.4 AS DOUBLE) AS longitude, CAST(0 AS DOUBLE) AS heading,
  CAST(p_size AS DOUBLE) AS fov, p_retailprice AS range,
  CASE WHEN p_partkey % 4 = 0 THEN 'rtsp://cam.example/' || p_brand
       ELSE 'rtsp://user' || CAST(p_partkey AS STRING) || ':pw@cam.example/' || p_brand || '?next=http://a:b@two.example' END AS url,
  '<feed><url>rtsp://u:' || CAST(p_size AS STRING) || '@cam</url><alt>http://a:b@c</alt></feed>' AS xml,
  {_MASK.format('p_partkey')} AS groups
FROM {{part}}""",
    "client_endpoint": """
SELECT user_id AS id, 'DEV-' || CAST(user_id AS STRING) AS uid, 'U' || CAST(user_id % 40 AS STRING) AS callsign,
  'user' || CAST(user_id AS STRING) AS username, 'Team' || CAST(user_id % 5 AS STRING) AS team,
  'Role' || CAST(user_id % 3 AS STRING) AS role
FROM {events} GROUP BY user_id""",
    "connection_event_type": "SELECT length(event_type) AS id, min(event_type) AS event_name FROM {events} GROUP BY length(event_type)",
    "client_endpoint_event": f"""
SELECT ts AS created_ts, user_id AS client_endpoint_id, length(event_type) AS connection_event_type_id,
  'v' || CAST(event_id % 4 AS STRING) AS client_version, {_MASK.format('event_id')} AS groups
FROM {{events}}""",
    "fed_event_kind_pl": """
SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 50 ELSE CAST(substr(o_orderpriority, 1, 1) AS INT) END AS id,
  min(o_orderpriority) AS event_kind
FROM {orders} GROUP BY CASE WHEN o_orderpriority = '5-LOW' THEN 50 ELSE CAST(substr(o_orderpriority, 1, 1) AS INT) END""",
    "fed_event": """
SELECT 'fed-' || CAST(o_custkey AS STRING) AS fed_id, 'Fed ' || CAST(o_custkey AS STRING) AS fed_name,
  CAST(substr(o_orderpriority, 1, 1) AS INT) AS event_kind_id, o_orderdate AS event_time,
  o_totalprice > 100000 AS remote, o_orderstatus AS details FROM {orders}""",
}



def _sha(text: str) -> str:
    """A SHA-256 call both engines can be given (see ``relation_sql``)."""
    return f"sha2(/*<*/{text}/*>*/, 256)"


_PACKAGE = _sha("'package ' || CAST(o_orderkey - o_orderkey % 10 AS STRING)")
_CASE = "'CASE-' || CAST(o_custkey % 50 AS STRING)"
_SCRIPT = "'-- case ' || CAST(o_orderkey - o_orderkey % 10 AS STRING) || ' SELECT 1;'"
_KIND = """CASE o_orderkey % 10 WHEN 0 THEN 'package' WHEN 1 THEN 'recheck-fetch' WHEN 2 THEN 'recheck'
  WHEN 3 THEN 'companion' WHEN 4 THEN 'locations' WHEN 5 THEN 'preview' WHEN 6 THEN 'package'
  WHEN 7 THEN 'recheck' WHEN 8 THEN 'audit-download'
  ELSE CASE WHEN o_custkey % 5 = 0 THEN 'case-correction' ELSE 'recheck-issued' END END"""

RELATIONS["export_log"] = f"""
SELECT o_orderkey + 1 AS id,
  CAST(o_orderdate AS STRING) AS ts_utc, CAST(o_orderdate AS STRING) || ' UTC' AS ts_local,
  'authenticated: user' || CAST(o_custkey % 9 AS STRING) AS actor, '10.0.0.' || CAST(o_custkey % 200 AS STRING) AS client_ip,
  CASE WHEN o_orderkey % 10 = 8 THEN NULL WHEN o_orderkey % 10 = 5 THEN '' ELSE {_CASE} END AS case_id,
  {_KIND} AS export_kind,
  CASE WHEN o_orderkey % 10 = 8 THEN NULL ELSE '2024-01-05T0' || CAST(o_orderkey % 9 AS STRING) || ':00' END AS window_start,
  CASE WHEN o_orderkey % 10 = 8 THEN NULL ELSE '2024-01-1' || CAST(o_custkey % 9 AS STRING) || 'T12:30' END AS window_end,
  CAST(39.95 AS DOUBLE) AS north, CAST(39.8 AS DOUBLE) AS south, CAST(-98.5 AS DOUBLE) AS west,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS east,
  o_orderkey % 1000 AS record_count,
  CASE WHEN o_orderkey % 10 = 5 THEN NULL ELSE {_PACKAGE} END AS package_sha256,
  CASE WHEN o_orderkey % 10 IN (2, 7) THEN 'raw match' WHEN o_orderkey % 4 = 0 THEN 'generated / delivered' ELSE 'generated' END AS outcome,
  CASE o_orderkey % 10
    WHEN 0 THEN 'package files: ' || {_sha("'cot ' || CAST(o_orderkey AS STRING)")} || ' CASE-cot.csv, '
      || CASE WHEN o_custkey % 5 = 2 THEN 'ffff CASE-queries.sql, ' ELSE '' END || {_sha(_SCRIPT)} || ' CASE-queries.sql, '
      || CASE WHEN o_custkey % 5 = 1 THEN {_sha("'later ' || CAST(o_orderkey AS STRING)")} || ' CASE-queries.sql, ' ELSE '' END
      || '12ab CASE-bad.csv; source database: cluster ' || CAST(o_custkey % 3 AS STRING) || '; note: first: second'
    WHEN 4 THEN 'source database: catalog cot/1/' || CAST(o_custkey % 4 AS STRING)
    WHEN 6 THEN CASE WHEN o_custkey % 3 = 0 THEN 'no list' ELSE 'package files: ' || {_sha("'other ' || CAST(o_orderkey AS STRING)")} || ' CASE-queries.sql' END
    WHEN 2 THEN 're-check at host' || CAST(o_custkey % 7 AS STRING) || ':/var/r; 3 file(s) hashed on the server; raw table rows match: yes'
    WHEN 7 THEN 're-check at (not reported); raw table rows match: NO - the hashes differ; raw table rows match: yes'
    WHEN 3 THEN 'companion recheck.csv for package ' || {_PACKAGE} || '; ' || CAST(o_custkey % 40 AS STRING) || ' of 40 package positions matched it'
    WHEN 9 THEN CASE o_custkey % 20
      WHEN 0 THEN 'corrects entry ' || CAST(o_orderkey - 5 AS STRING) || ': case "' || {_CASE} || '" -> "ENTRY-' || CAST(o_custkey % 7 AS STRING) || '"; reason: typo'
      WHEN 5 THEN 'corrects case "' || {_CASE} || '" -> "CASE-' || CAST((o_custkey * 3) % 50 AS STRING) || '" (4 entries)'
      WHEN 10 THEN 'corrects case "' || {_CASE} || '" -> "B" -> "C" (1 entries)'
      WHEN 15 THEN 'corrects case "ENTRY-' || CAST(o_custkey % 7 AS STRING) || '" -> "MOVED"'
      ELSE 'issued' END
    ELSE NULL END AS detail,
  CASE WHEN o_orderkey % 6 = 0 THEN 'video.csv' ELSE NULL END AS files_excluded,
  CASE WHEN o_orderkey % 7 = 0 THEN 'NATION_3' ELSE NULL END AS channels_excluded,
  CASE o_orderkey % 4 WHEN 0 THEN 'America/Chicago' WHEN 1 THEN 'UTC' WHEN 2 THEN NULL ELSE 'Not/AZone' END AS window_timezone,
  CASE WHEN o_custkey % 8 = 0 THEN '=requester ' || CAST(o_custkey AS STRING) ELSE NULL END AS requested_for,
  '1.20' AS tool_version,
  CAST(NULL AS STRING) AS prev_hash, CAST(NULL AS STRING) AS row_hash
FROM {{orders}}"""
# A file asked about per order: some hashes are known, some are not.
RELATIONS["asked_files"] = f"""
SELECT o_orderkey AS file_id,
  CASE WHEN o_orderstatus = 'P' THEN 'not a hash' WHEN o_orderstatus = 'F' THEN upper({_PACKAGE})
    ELSE {_sha("'nothing ' || CAST(o_orderkey AS STRING)")} END AS file_hash,
  TIMESTAMP '2024-01-05 08:00:00' + INTERVAL '1' HOUR * CAST(o_orderkey % 12 AS INT) AS file_min_utc,
  TIMESTAMP '2024-01-12 00:00:00' + INTERVAL '1' HOUR * CAST(o_custkey % 96 AS INT) AS file_max_utc
FROM {{orders}}"""
# One kept script per package, and what a server posted back for it.
RELATIONS["scripts"] = f"""
SELECT DISTINCT {_PACKAGE} AS package_sha256, 'CASE' AS case_prefix,
  {_SCRIPT} AS queries_sql,
  CASE WHEN (o_orderkey - o_orderkey % 10) % 30 = 20 THEN NULL ELSE {_sha("'raw ' || CAST(o_orderkey - o_orderkey % 10 AS STRING)")} END AS raw_sha256
FROM {{orders}}"""
# What a source says of itself; either part may be missing or empty.
RELATIONS["source_rows"] = """
SELECT o_orderkey AS id,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS STRING) WHEN 1 THEN '' ELSE NULL END AS cluster_id,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'cot/1/' || CAST(o_custkey % 4 AS STRING) END AS catalog_id
FROM {orders}"""
# Some packages post under a name that nobody keeps a script of, and some lists
# lack the raw file or name the script in another way.
RELATIONS["posted_sums"] = f"""
SELECT CASE WHEN (o_orderkey - o_orderkey % 10) % 70 = 30 THEN {_sha("'unknown ' || CAST(o_orderkey - o_orderkey % 10 AS STRING)")} ELSE {_PACKAGE} END AS package_sha256,
  o_orderkey AS line_no,
  CASE WHEN o_orderkey % 10 = 0 AND o_custkey % 9 <> 5 THEN 'CASE-recheck-cot_router-raw.csv'
    WHEN o_orderkey % 10 = 1 AND o_custkey % 9 <> 7 THEN 'CASE-queries.sql' ELSE 'CASE-' || CAST(o_orderkey AS STRING) || '.csv' END AS name,
  CASE WHEN o_orderkey % 10 = 0 AND o_custkey % 4 > 0 THEN {_sha("'raw ' || CAST(o_orderkey AS STRING)")}
    WHEN o_orderkey % 10 = 1 AND o_custkey % 4 > 0 THEN {_sha(_SCRIPT)}
    ELSE {_sha("'else ' || CAST(o_orderkey AS STRING)")} END AS sha256
FROM {{orders}}"""
# The positions as another program exported them: some renumbered, moved a
# little, moved a lot, shifted in time, or under another name.
RELATIONS["cot_copy"] = """
SELECT CASE WHEN event_id % 59 = 0 THEN -event_id ELSE event_id END AS id,
  'DEV-' || CAST(user_id % 10 AS STRING) AS uid,
  CASE WHEN user_id % 10 = 6 THEN 'R6' ELSE 'U' || CAST(user_id % 10 AS STRING) END AS callsign,
  ts + CASE WHEN event_id % 37 = 0 THEN INTERVAL '0.5' SECOND WHEN event_id % 53 = 0 THEN INTERVAL '2' HOUR ELSE INTERVAL '0' SECOND END AS servertime,
  CAST(39.7 AS DOUBLE) + CAST((event_id * 7919) % 4000 AS DOUBLE) / CAST(10000 AS DOUBLE)
    + CASE WHEN event_id % 41 = 0 THEN CAST(0.000005 AS DOUBLE) WHEN event_id % 43 = 0 THEN CAST(0.00045 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS latitude,
  CAST(-98.6 AS DOUBLE) + CAST((event_id * 104729) % 6000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS longitude
FROM {events}"""
RELATIONS["cot_original"] = """
SELECT event_id AS id, 'DEV-' || CAST(user_id % 10 AS STRING) AS uid,
  'U' || CAST(user_id % 10 AS STRING) AS callsign, ts AS servertime,
  CAST(39.7 AS DOUBLE) + CAST((event_id * 7919) % 4000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS latitude,
  CAST(-98.6 AS DOUBLE) + CAST((event_id * 104729) % 6000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS longitude,
  event_type AS channel
FROM {events}"""
# Documents as package members, and the hash list written with the package.
RELATIONS["members"] = "SELECT source AS package, CAST(doc_id AS STRING) AS name, text AS content FROM {documents}"
RELATIONS["member_list"] = f"""
SELECT source AS package, CAST(doc_id AS STRING) || CASE WHEN doc_id % 71 = 0 THEN '.old' ELSE '' END AS name,
  {_sha("text || CASE WHEN lang = 'de' THEN ' ' ELSE '' END")} AS sha256 FROM {{documents}}"""

INPUT_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def relation_sql(name: str) -> str:
    """The relation as text for the checking engine, over its registered views."""
    text = RELATIONS[name].format(**{t: t for t in INPUT_TABLES})
    spellings = {
        "array(": "list_value(",
        "sha2(/*<*/": "sha256(",
        "/*>*/, 256)": ")",
        "INTERVAL '0.5' SECOND": "INTERVAL 500 MILLISECOND",
    }
    for ours, theirs in spellings.items():
        text = text.replace(ours, theirs)
    return text


class CheckTables:
    """Lazy relations of the event model over one directory of check tables."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory
        self._cache: dict[str, DataFrame] = {}

    def input(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, f"{self.directory}/{name}.parquet")
        return self._cache[name]

    def __getitem__(self, relation: str) -> DataFrame:
        key = "relation:" + relation
        if key not in self._cache:
            text = RELATIONS[relation]
            used = {t: self.input(t) for t in INPUT_TABLES if "{" + t + "}" in text}
            self._cache[key] = self.spark.sql(text, **used)
        return self._cache[key]

    def stream(self, relation: str) -> DataFrame:
        """The relation over streaming reads of its input tables."""
        from posevidence.streaming.streams import read_stream

        text = RELATIONS[relation]
        used = {
            t: read_stream(self.spark, f"{self.directory}/{t}.parquet", self.input(t).schema)
            for t in INPUT_TABLES
            if "{" + t + "}" in text
        }
        return self.spark.sql(text, **used)

    @cached_property
    def decoder(self):
        from posevidence.operators.channels import ChannelDecoder

        return ChannelDecoder(self["channels"])

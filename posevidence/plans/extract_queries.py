"""Queries over the result sets of an extract."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from posevidence.functions import classify
from posevidence.functions.predicates import is_map_object, real_position
from posevidence.operators import aggregates, channels, results
from posevidence.plans.registry import (
    IN_BOX,
    IN_WINDOW,
    MATCHING,
    REAL,
    attr,
    decoded,
    on_any_channel,
    registered,
    window_on,
)
from posevidence.sources.adapter import AS_OF, CHECK_CHANNELS, CHECK_PARAMS

P = CHECK_PARAMS
ON_CHANNELS = replace(P, channels=CHECK_CHANNELS)
NO_CHANNELS = replace(P, channels=())

# --- manifest -------------------------------------------------------------

_MANIFEST_CHECK = f"""
WITH marked AS (
  SELECT uid, cot_type, servertime, {attr('callsign')} AS callsign,
         latitude IS NULL AS no_point,
         coalesce(latitude = 0 AND longitude = 0, FALSE) AS zero,
         coalesce({REAL}, FALSE) AS ok,
         coalesce({REAL} AND {IN_BOX}, FALSE) AS boxed,
         %s AS picked
  FROM cot WHERE {IN_WINDOW}),
rolled AS (
  SELECT uid, count(*) AS total_events,
         CAST(sum(CAST(ok AS INT)) AS BIGINT) AS events_with_position,
         CAST(sum(CAST(zero AS INT)) AS BIGINT) AS events_at_0_0,
         CAST(sum(CAST(no_point AS INT)) AS BIGINT) AS events_no_geometry,
         CAST(sum(CAST(boxed AS INT)) AS BIGINT) AS events_inside_box,
         CAST(sum(CAST(boxed AND picked AS INT)) AS BIGINT) AS events_exported,
         min(servertime) AS first_event, max(servertime) AS last_event,
         string_agg(DISTINCT cot_type, ' ' ORDER BY cot_type) AS cot_types_seen,
         string_agg(DISTINCT callsign, ' ' ORDER BY callsign) AS callsign_seen
  FROM marked GROUP BY uid)
SELECT *,
       CASE WHEN starts_with(cot_types_seen, 'a-') THEN 'device/entity' ELSE 'message or object' END AS uid_kind,
       if(events_exported > 0, 'yes', 'no') AS in_positional_export,
       CASE WHEN events_exported > 0 THEN 'included'
            WHEN events_with_position > 0 AND events_inside_box > 0
              THEN 'inside the bounding box, but not on a selected channel'
            WHEN events_with_position > 0 THEN 'had positions, none inside the bounding box'
            WHEN events_at_0_0 > 0 THEN 'no valid GPS fix (0,0)'
            ELSE 'no position data in these events' END AS exclusion_reason
FROM rolled"""


def _pieces_check(key: str, size: int) -> str:
    return f"""
WITH seen AS (SELECT DISTINCT {key}, {attr('callsign')} AS callsign FROM cot WHERE {IN_WINDOW}),
placed AS (SELECT *, (row_number() OVER (PARTITION BY {key} ORDER BY callsign) - 1) // {size} + 1 AS piece FROM seen WHERE callsign IS NOT NULL)
SELECT {key}, CAST(piece AS BIGINT) AS piece, count(*) AS n_values, min(callsign) AS first_value, max(callsign) AS last_value,
  string_agg(callsign, ' ' ORDER BY callsign) AS seen FROM placed GROUP BY {key}, piece"""


@registered("callsigns_of_devices", "A5", "cot", _pieces_check("uid", results.PIECE))
def callsigns_of_devices(t):
    return results.seen_in_pieces(t["cot"], P)


@registered("callsigns_of_types", "A5", "cot", _pieces_check("cot_type", 7))
def callsigns_of_types(t):
    return results.seen_in_pieces(t["cot"], P, ("cot_type",), 7)


@registered("manifest", "A2 P14 P15 A5 A6 F1 F2 F3 S1", "cot", _MANIFEST_CHECK % "TRUE")
def manifest(t):
    return results.manifest(t["cot"], P)


@registered("manifest_on_channels", "A2 F6", "cot", _MANIFEST_CHECK % on_any_channel())
def manifest_on_channels(t):
    return results.manifest(t["cot"], ON_CHANNELS)


@registered(
    "manifest_ordered", "O2", "cot",
    f"""
WITH n AS (SELECT uid, count(*) AS total_events,
  count(*) FILTER (WHERE {REAL} AND {IN_BOX}) AS events_exported FROM cot WHERE {IN_WINDOW} GROUP BY uid)
SELECT uid, total_events, events_exported FROM n
ORDER BY events_exported DESC, total_events DESC, uid LIMIT 10""",
)
def manifest_ordered(t):
    return results.preview("manifest", results.manifest(t["cot"], P), 10).select(
        "uid", "total_events", "events_exported"
    )


# --- positions and their variants -------------------------------------------

_REPORT = f"""
  r.id, r.time AS event_time, r.servertime, r.latitude, r.longitude, r.uid,
  {attr('callsign')} AS callsign, r.point_ce AS ce_m, r.how, r.cot_type,
  {attr('geopoint_src')} AS geopoint_src, d.channels,
  {attr('reported_team')} AS reported_team, {attr('reported_role')} AS reported_role,
  {attr('course_deg')} AS course_deg, {attr('speed_ms')} AS speed_ms,
  r.point_hae AS hae_m, r.point_le AS le_m, r.start AS event_start, r.stale,
  {attr('battery_pct')} AS battery_pct, {attr('device_model')} AS device_model,
  {attr('tak_platform')} AS tak_platform, {attr('tak_version')} AS tak_version,
  {attr('remarks')} AS remarks, r.access, r.opex, r.caveat, r.releaseableto,
  r.detail AS raw_detail"""

_POSITIONS_CHECK = f"""
WITH {decoded('cot')},
names AS (SELECT l.cot_router_id, string_agg(DISTINCT f.name, ', ' ORDER BY f.name) AS data_feed_names
          FROM data_feed_cot l JOIN data_feed f ON f.id = l.data_feed_id GROUP BY 1),
shots AS (SELECT cot_id, count(*) AS n FROM cot_image GROUP BY 1)
SELECT {_REPORT}, d.channel_numbers, names.data_feed_names, coalesce(shots.n, 0) AS attached_images
FROM (SELECT * FROM cot WHERE {MATCHING} AND %s) r
LEFT JOIN decoded d ON d.mask = r.groups
LEFT JOIN names ON names.cot_router_id = r.id
LEFT JOIN shots ON shots.cot_id = r.id"""
_POSITIONS_RELATIONS = "cot channels data_feed data_feed_cot cot_image"


def _positions(t, params):
    return results.positions(
        t["cot"], params, t.decoder, t["data_feed_cot"], t["data_feed"], t["cot_image"]
    )


@registered(
    "positions", "P1 P3 P4 P5 P6 J1 J2 J3 F4 F5", _POSITIONS_RELATIONS, _POSITIONS_CHECK % "TRUE"
)
def positions(t):
    return _positions(t, P)


@registered("positions_on_channels", "P1 F6", _POSITIONS_RELATIONS, _POSITIONS_CHECK % on_any_channel())
def positions_on_channels(t):
    return _positions(t, ON_CHANNELS)


@registered(
    "positions_no_channel_selected", "F6", "cot",
    f"SELECT cot_type, count(*) AS matching, 0 AS selected FROM cot WHERE {MATCHING} GROUP BY cot_type",
)
def positions_no_channel_selected(t):
    """Matching positions of each type, and those of them that no channel selects."""
    every = results.matching_positions(t["cot"], P).groupBy("cot_type").agg(F.count("*").alias("matching"))
    none = results.matching_positions(t["cot"], NO_CHANNELS).groupBy("cot_type").agg(F.count("*").alias("selected"))
    return every.join(none, "cot_type", "left").select(
        "cot_type", "matching", F.coalesce("selected", F.lit(0)).cast("int").alias("selected")
    )


@registered(
    "locations", "P2", "cot channels",
    f"WITH {decoded('cot')} SELECT {_REPORT} FROM (SELECT * FROM cot WHERE {MATCHING}) r "
    "LEFT JOIN decoded d ON d.mask = r.groups",
)
def locations(t):
    return results.locations(t["cot"], P, t.decoder)


@registered(
    "positions_ordered", "O1", "cot",
    f"""
SELECT id, uid, servertime, row_number() OVER (ORDER BY uid, servertime, id) AS place
FROM cot WHERE {MATCHING} ORDER BY place LIMIT 50""",
)
def positions_ordered(t):
    df = results.matching_positions(t["cot"], P).select("id", "uid", "servertime")
    top = results.ordered("positions", df).limit(50)
    from pyspark.sql.window import Window

    # Numbering fifty rows, after the limit.
    place = F.row_number().over(Window.orderBy("uid", "servertime", "id"))
    return top.withColumn("place", place)


@registered(
    "positions_preview", "O4", "cot channels data_feed data_feed_cot cot_image",
    _POSITIONS_CHECK % "TRUE" + " ORDER BY r.uid, r.servertime, r.id LIMIT 5",
)
def positions_preview(t):
    return results.preview("positions", positions(t))


@registered(
    "positions_plain", "S3", "cot",
    f"SELECT id, uid, {attr('callsign')} AS callsign, servertime, latitude, longitude "
    f"FROM cot WHERE {IN_WINDOW} AND {IN_BOX}",
)
def positions_plain(t):
    return results.positions_plain(t["cot"], P)


@registered(
    "raw_rows", "S2 P36", "cot",
    f"""
SELECT CAST(id AS VARCHAR) AS id, uid, CAST(time AS VARCHAR) AS time, CAST(servertime AS VARCHAR) AS servertime,
  CAST(start AS VARCHAR) AS start, CAST(stale AS VARCHAR) AS stale, CAST(point_ce AS VARCHAR) AS point_ce,
  CAST(point_hae AS VARCHAR) AS point_hae, CAST(point_le AS VARCHAR) AS point_le, how, cot_type, detail, groups,
  access, opex, caveat, releaseableto, CAST(latitude AS VARCHAR) AS latitude, CAST(longitude AS VARCHAR) AS longitude
FROM cot WHERE {MATCHING}""",
)
def raw_rows(t):
    return results.raw_rows(t["cot"], P)


# --- counts ---------------------------------------------------------------

@registered(
    "record_count", "A1 F7", "cot",
    f"""
SELECT count(*) AS records, count(DISTINCT uid) AS uids,
  count(DISTINCT CASE WHEN cot_type LIKE 'a-%-G-U-%' THEN uid END) AS personnel,
  count(DISTINCT CASE WHEN cot_type LIKE 'a-%-G-E-%' THEN uid END) AS equipment,
  count(DISTINCT CASE WHEN cot_type LIKE 'a-%-G-I%' THEN uid END) AS infrastructure,
  count(DISTINCT CASE WHEN cot_type LIKE 'u-d-%' OR cot_type LIKE 'b-m-%' THEN uid END) AS map_objects
FROM cot WHERE {MATCHING}""",
)
def record_count(t):
    return aggregates.record_count(t["cot"], P)


_QUALITY_TESTS = {
    "speed unavailable (-1.0)": f"({attr('speed_ms')}) IN ('-1.0', '-1')",
    "speed measured as stationary (0.0)": f"({attr('speed_ms')}) = '0.0'",
    "course unavailable": f"({attr('course_deg')}) IN ('9999999.0', '-1.0', '-1')",
    "no track element sent": "NOT contains(detail, '<track')",
    "horizontal accuracy unknown": "point_ce >= 9999999",
    "vertical accuracy unknown": "point_le >= 9999999",
    "altitude unknown": "point_hae >= 9999999",
    "no callsign sent": "NOT contains(detail, '<contact')",
    "no battery status sent": "NOT contains(detail, '<status')",
    "no device/version info sent": "NOT contains(detail, '<takv')",
    "no precision-location element": "NOT contains(detail, '<precisionlocation')",
}


@registered(
    "quality_summary", "A3 A6 P27", "cot",
    f"WITH m AS (SELECT * FROM cot WHERE {MATCHING}), t AS (SELECT count(*) AS total FROM m), c AS ("
    + " UNION ALL ".join(
        f"SELECT '{label}' AS \"check\", (SELECT count(*) FROM m WHERE {test}) AS n"
        for label, test in _QUALITY_TESTS.items()
    )
    + ') SELECT "check", n, total, round(n * 100.0::DOUBLE / nullif(total, 0), 1) AS percent FROM c, t',
)
def quality_summary(t):
    return aggregates.quality_summary(t["cot"], P)


@registered(
    "extent", "A4", "cot",
    f"""
WITH p AS (SELECT * FROM cot WHERE {REAL}),
w AS (SELECT 1 AS k, '7 days' AS basis, latitude, longitude FROM p WHERE servertime > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY
  UNION ALL SELECT 2, '90 days', latitude, longitude FROM p WHERE servertime > TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY
  UNION ALL SELECT 3, 'all data', latitude, longitude FROM p),
q AS (SELECT k, basis, quantile_cont(latitude, 0.1) AS s, quantile_cont(latitude, 0.9) AS n,
  quantile_cont(longitude, 0.1) AS w, quantile_cont(longitude, 0.9) AS e,
  quantile_cont(latitude, 0.5) AS mlat, quantile_cont(longitude, 0.5) AS mlon FROM w GROUP BY k, basis),
f AS (SELECT *, (n - s > 2 OR e - w > 2) AS wide FROM q ORDER BY k LIMIT 1)
SELECT round(if(wide, mlat - 0.15::DOUBLE, s), 9) AS south, round(if(wide, mlat + 0.15::DOUBLE, n), 9) AS north,
  round(if(wide, mlon - 0.15::DOUBLE, w), 9) AS west, round(if(wide, mlon + 0.15::DOUBLE, e), 9) AS east,
  basis || if(wide, ', further narrowed - matching data was too spread out to fit', '') AS basis
FROM f""",
)
def extent(t):
    # The engines interpolate between the same two values in different forms.
    box = aggregates.extent(t["cot"], AS_OF)
    return box.select(*[F.round(c, 9).alias(c) for c in ("south", "north", "west", "east")], "basis")


@registered(
    "log_extent", "S9 A7", "cot",
    "SELECT count(*) AS total, min(servertime) AS oldest, max(servertime) AS newest FROM cot",
)
def log_extent(t):
    return aggregates.log_extent(t["cot"])


_CENSUSED = {
    "cot_image": "attached images",
    "cot_link": "event links",
    "mission_uid": "mission map items",
    "mission_resource": "mission files",
    "mission_external_data": "mission external data",
    "fed_event": "federation records",
    "video_connections": "video connections",
    "data_feed": "configured data feeds",
    "data_feed_cot": "feed linkage",
}
_NOT_THERE = (
    "thumbnails", "mission logs", "mission invitations", "properties", "video connections (v2)",
)


@registered(
    "census", "S8", "channels " + " ".join(_CENSUSED),
    " UNION ALL ".join(
        [f"SELECT '{label}' AS label, count(*) AS n, 'counted' AS state FROM {r}" for r, label in _CENSUSED.items()]
        + ["SELECT 'channels defined', count(*), 'counted' FROM channels"]
        + [f"SELECT '{label}', CAST(NULL AS BIGINT), 'unavailable'" for label in _NOT_THERE]
    ),
)
def census(t):
    tables = {r: t[r] for r in _CENSUSED}
    tables["groups"] = t["channels"]
    return aggregates.census(tables)


@registered(
    "mask_widths", "A13", "cot",
    "SELECT DISTINCT length(groups) AS mask_bits FROM cot WHERE groups IS NOT NULL ORDER BY 1 LIMIT 4",
)
def mask_widths(t):
    return aggregates.mask_widths(t["cot"])


@registered(
    "geometry_sanity", "G16", "cot",
    """
SELECT count(latitude) AS with_position, count(*) FILTER (WHERE abs(latitude) > 90 OR abs(longitude) > 180) AS out_of_range,
  CASE WHEN count(latitude) = 0 THEN 'skip' WHEN count(*) FILTER (WHERE abs(latitude) > 90 OR abs(longitude) > 180) > 0
  THEN 'fail' ELSE 'ok' END AS status FROM cot""",
)
def geometry_sanity(t):
    return aggregates.geometry_sanity(t["cot"])


# --- channels ---------------------------------------------------------------

_AVAILABLE = f"""
SELECT DISTINCT c.bitpos, c.name
FROM (SELECT DISTINCT reverse(groups) AS bits FROM cot WHERE {MATCHING}) m
JOIN channels c ON substr(m.bits, c.bitpos + 1, 1) = '1'"""


@registered("available_channels", "J10", "cot channels", _AVAILABLE)
def available_channels(t):
    return t.decoder.present(results.matching_positions(t["cot"], P))


@registered(
    "excluded_channels", "J11 U4", "cot channels",
    f"SELECT 'verified' AS state, coalesce(string_agg(name, ', ' ORDER BY name), '') AS names FROM ({_AVAILABLE}) WHERE bitpos NOT IN ({', '.join(map(str, CHECK_CHANNELS))})",
)
def excluded_channels(t):
    found = channels.excluded_channels(available_channels(t), CHECK_CHANNELS)
    return found.withColumn("names", F.array_join("names", ", "))


@registered(
    "decoded_masks", "J1 P5 P6", "cot channels",
    f"WITH {decoded('cot')} SELECT id, channels, channel_numbers FROM cot LEFT JOIN decoded ON mask = groups",
)
def decoded_masks(t):
    return t.decoder.add(t["cot"].select("id", "groups")).drop("groups")


# --- the other result sets ------------------------------------------------

@registered(
    "connections", "J4",
    "client_endpoint client_endpoint_event connection_event_type channels",
    f"""
WITH {decoded('client_endpoint_event')}
SELECT e.created_ts, k.event_name, p.uid, p.callsign, p.username, p.team, p.role, e.client_version,
  d.channels, d.channel_numbers
FROM client_endpoint_event e
JOIN client_endpoint p ON p.id = e.client_endpoint_id
JOIN connection_event_type k ON k.id = e.connection_event_type_id
LEFT JOIN decoded d ON d.mask = e.groups
WHERE {window_on('e.created_ts')}""",
)
def connections(t):
    return results.connections(
        t["client_endpoint_event"], t["client_endpoint"], t["connection_event_type"], P, t.decoder
    )


@registered(
    "chat", "P31", "chat channels",
    f"""
WITH {decoded('chat')}
SELECT id, time AS event_time, servertime, sender_callsign, dest_callsign, chat_room, chat_content,
  uid AS sender_uid, dest_uid, latitude, longitude, cot_type, how, d.channels, d.channel_numbers,
  access, opex, detail AS raw_detail
FROM chat LEFT JOIN decoded d ON d.mask = groups WHERE {IN_WINDOW} AND {on_any_channel()}""",
)
def chat(t):
    return results.chat(t["chat"], ON_CHANNELS, t.decoder)


@registered(
    "missions", "P32 P16", "mission channels",
    f"""
WITH {decoded('mission')}
SELECT mission.* EXCLUDE (groups, password_hash), d.channels, d.channel_numbers,
  if(password_hash IS NULL, 'no', 'yes') AS password_protected
FROM mission LEFT JOIN decoded d ON d.mask = groups WHERE {on_any_channel()}""",
)
def missions(t):
    return results.missions(t["mission"], ON_CHANNELS, t.decoder)


_CHANGE_NAMES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in classify.CHANGE_TYPES.items())


@registered(
    "mission_changes", "P33 P13", "mission_change",
    f"""
SELECT *, CASE change_type {_CHANGE_NAMES} ELSE 'unknown code' END AS change_type_name
FROM mission_change WHERE {window_on('ts')}""",
)
def mission_changes(t):
    return results.mission_changes(t["mission_change"], P)


@registered(
    "mission_subscriptions", "J5", "mission_subscription mission",
    """
SELECT s.mission_id, m.name AS mission_name, s.client_uid, s.uid, s.username, s.create_time, s.role_id
FROM mission_subscription s LEFT JOIN mission m ON m.id = s.mission_id""",
)
def mission_subscriptions(t):
    return results.mission_subscriptions(t["mission_subscription"], t["mission"])


_CONTENTS = """
WITH parts AS (
  SELECT 'map item (mission_uid)' AS record_kind, mission_id, uid AS item_ref,
    NULL::VARCHAR AS item_name, NULL::VARCHAR AS notes, NULL::VARCHAR AS url_display FROM mission_uid
  UNION ALL
  SELECT 'attached file (mission_resource)', r.mission_id, r.resource_hash, f.filename, f.mimetype, NULL
  FROM mission_resource r LEFT JOIN resource f ON f.id = r.resource_id
  UNION ALL
  SELECT 'external data feed', mission_id, id, name, notes, url_display FROM mission_external_data)
SELECT record_kind, mission_id, m.name AS mission_name, item_ref, item_name, notes, url_display
FROM parts LEFT JOIN mission m ON m.id = mission_id"""
_CONTENTS_RELATIONS = "mission mission_uid mission_resource mission_external_data resource"


@registered("mission_contents", "J6 U1", _CONTENTS_RELATIONS, _CONTENTS)
def mission_contents(t):
    return results.mission_contents(
        t["mission_uid"], t["mission_resource"], t["mission_external_data"], t["resource"], t["mission"]
    )


@registered(
    "mission_contents_ordered", "O3", _CONTENTS_RELATIONS,
    "SELECT record_kind, mission_id, item_ref FROM (" + _CONTENTS.replace("WITH parts AS", "WITH parts AS", 1)
    + ") ORDER BY 1, 2, 3 LIMIT 40",
)
def mission_contents_ordered(t):
    return results.preview("mission_contents", mission_contents(t), 40).select(
        "record_kind", "mission_id", "item_ref"
    )


@registered(
    "files", "P34 P19 P20", "resource channels",
    f"""
WITH {decoded('resource')}
SELECT id, uid, name, filename, mimetype, octet_length(encode(data))::INT AS size_bytes, hash, submitter, creatoruid,
  submissiontime, tool, latitude, longitude, altitude, remarks,
  array_to_string(keywords, ' ') AS keywords, array_to_string(permissions, ' ') AS permissions,
  expiration, d.channels, d.channel_numbers
FROM resource LEFT JOIN decoded d ON d.mask = groups WHERE {on_any_channel()}""",
)
def files(t):
    return results.files(t["resource"], ON_CHANNELS, t.decoder)


@registered(
    "attachments", "J7 U2", "cot cot_image cot_link",
    """
SELECT 'image' AS attachment_kind, i.id AS attachment_id, cot_id, octet_length(encode(image))::INT AS size_bytes, uid, cot_type, servertime
FROM cot_image i JOIN cot ON cot.id = cot_id
UNION ALL
SELECT 'link', l.id, containing_event, NULL, uid, cot_type, servertime
FROM cot_link l JOIN cot ON cot.id = containing_event""",
)
def attachments(t):
    return results.attachments(t["cot_image"], t["cot_link"], t["cot"])


_VIDEO_URL = "regexp_replace(url, '://[^/@]*@', '://[CREDENTIALS-REDACTED]@')"
_VIDEO_XML = "regexp_replace(xml, '://[^/@<\"]*@', '://[CREDENTIALS-REDACTED]@', 'g')"


@registered(
    "video", "P35 P17", "video_connections channels",
    f"""
WITH {decoded('video_connections')}
SELECT video_connections.* EXCLUDE (groups, url, xml), {_VIDEO_URL} AS url, {_VIDEO_XML} AS raw_xml, d.channels, d.channel_numbers
FROM video_connections LEFT JOIN decoded d ON d.mask = groups""",
)
def video(t):
    return results.video(t["video_connections"], P, t.decoder)


@registered(
    "video_redactions", "P18", "video_connections",
    f"""
SELECT CAST(sum(len(string_split({_VIDEO_URL}, 'CREDENTIALS-REDACTED')) - 1
  + len(string_split({_VIDEO_XML}, 'CREDENTIALS-REDACTED')) - 1) AS BIGINT) AS redactions FROM video_connections""",
)
def video_redactions(t):
    return aggregates.redaction_count(video(t))


@registered(
    "data_feeds", "J8", "data_feed data_feed_type_pl channels",
    f"""
WITH {decoded('data_feed')}
SELECT data_feed.* EXCLUDE (groups), k.feed_type AS type_name, d.channels, d.channel_numbers
FROM data_feed LEFT JOIN data_feed_type_pl k ON k.id = data_feed.type LEFT JOIN decoded d ON d.mask = groups""",
)
def data_feeds(t):
    return results.data_feeds(t["data_feed"], t["data_feed_type_pl"], P, t.decoder)


@registered(
    "federation", "J9", "fed_event fed_event_kind_pl",
    """
SELECT fed_id, fed_name, event_kind_id, event_kind, event_time, remote, details
FROM fed_event LEFT JOIN fed_event_kind_pl k ON k.id = event_kind_id""",
)
def federation(t):
    return results.federation(t["fed_event"], t["fed_event_kind_pl"])


# --- classification ---------------------------------------------------------

_FIRST_MATCH = """CASE WHEN cot_type LIKE 'a-%-G-U-%' THEN 'Personnel'
  WHEN cot_type LIKE 'a-%-G-E-%' THEN 'Vehicles and equipment'
  WHEN cot_type LIKE 'a-%-G-I%' THEN 'Infrastructure'
  WHEN cot_type LIKE 'u-d-%' OR cot_type LIKE 'b-m-%' THEN 'Map objects' END"""


@registered(
    "type_categories", "P7 P8 F7", "cot",
    f"""
SELECT cot_type, count(*) AS n, {_FIRST_MATCH} AS category,
  coalesce({_FIRST_MATCH}, CASE WHEN starts_with(cot_type, 'a-') THEN 'Other entities' END, 'Other') AS track_category
FROM cot GROUP BY cot_type""",
)
def type_categories(t):
    kind = F.col("cot_type")
    return (
        t["cot"]
        .groupBy("cot_type")
        .agg(F.count("*").alias("n"))
        .select(
            "cot_type",
            "n",
            classify.cot_category(kind).alias("category"),
            classify.track_category(kind).alias("track_category"),
        )
    )


@registered(
    "filter_effects", "F1 F2 F3 F4 F9", "cot",
    f"""
SELECT count(*) AS total, count(*) FILTER (WHERE {IN_WINDOW}) AS in_window,
  count(*) FILTER (WHERE {REAL}) AS real_position, count(*) FILTER (WHERE {IN_BOX}) AS in_box,
  count(*) FILTER (WHERE cot_type <> 'b-t-f') AS not_bulk,
  count(*) FILTER (WHERE {IN_WINDOW} AND (cot_type LIKE 'u-d-%' OR cot_type LIKE 'b-m-%')) AS shape_rows
FROM cot""",
)
def filter_effects(t):
    from posevidence.functions import predicates as p

    return t["cot"].agg(
        F.count("*").alias("total"),
        F.count_if(p.in_window("servertime", P)).alias("in_window"),
        F.count_if(real_position()).alias("real_position"),
        F.count_if(p.in_box(P.box)).alias("in_box"),
        F.count_if(p.not_bulk_transfer()).alias("not_bulk"),
        F.count_if(p.in_window("servertime", P) & is_map_object()).alias("shape_rows"),
    )

"""Queries over tracks and single positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from posevidence.functions.text import detail_attribute
from posevidence.operators import tracks
from posevidence.operators.results import matching_positions
from posevidence.plans.registry import IN_BOX, IN_WINDOW, MATCHING, REAL, attr, registered
from posevidence.sources.adapter import CHECK_PARAMS

P = CHECK_PARAMS
# The check devices report about every thirteen minutes at the smallest scale.
GAP = 1800


def _segments(relation: str, gap: int, where: str = "TRUE") -> str:
    return f"""
steps AS (
  SELECT *, CASE WHEN servertime - lag(servertime) OVER (PARTITION BY uid ORDER BY servertime, id)
    > INTERVAL {gap} SECOND THEN 1 ELSE 0 END AS brk
  FROM {relation} WHERE {where}),
numbered AS (
  SELECT *, 1 + CAST(sum(brk) OVER (PARTITION BY uid ORDER BY servertime, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg_no
  FROM steps)"""


@registered(
    "track_segments", "W1", "dense_cot",
    f"WITH {_segments('dense_cot', GAP)} SELECT id, uid, servertime, seg_no FROM numbered",
)
def track_segments(t):
    return tracks.split_segments(t["dense_cot"].select("id", "uid", "servertime"), GAP)


@registered(
    "track_segments_default_gap", "W1", "cot",
    f"WITH {_segments('cot', 300)} SELECT id, uid, servertime, seg_no FROM numbered",
)
def track_segments_default_gap(t):
    return tracks.split_segments(t["cot"].select("id", "uid", "servertime"))


_LINE = "string_agg(printf('%.6f %.6f', longitude, latitude), ', ' ORDER BY servertime, id)"


@registered(
    "track_features", "G13 W4", "dense_cot",
    f"""
WITH {_segments('dense_cot', GAP, MATCHING)},
lines AS (SELECT uid, seg_no, count(*) AS points, min(servertime) AS begin, max(servertime) AS "end" FROM numbered GROUP BY ALL),
pieces AS (SELECT uid, seg_no, date_trunc('hour', servertime) AS hr, count(*) AS piece_points, {_LINE} AS path FROM numbered GROUP BY ALL)
SELECT uid, seg_no, (SELECT max(seg_no) FROM lines m WHERE m.uid = l.uid) AS segments,
  CASE WHEN (SELECT max(seg_no) FROM lines m WHERE m.uid = l.uid) = 1 THEN 'Track'
    ELSE 'Track segment ' || seg_no || ' of ' || (SELECT max(seg_no) FROM lines m WHERE m.uid = l.uid) END AS name,
  begin, "end", points, CAST(row_number() OVER (PARTITION BY uid, seg_no ORDER BY hr) AS INT) AS piece_no, piece_points, path
FROM lines l JOIN pieces USING (uid, seg_no) WHERE points >= 2""",
)
def track_features(t):
    points = matching_positions(t["dense_cot"], P).select(
        "id", "uid", "servertime", "latitude", "longitude"
    )
    return tracks.track_features(points, GAP)


@registered(
    "trails", "G12", "dense_cot",
    f"""
WITH {_segments('dense_cot', GAP, MATCHING)},
movers AS (SELECT uid FROM numbered GROUP BY uid HAVING count(DISTINCT (latitude, longitude)) >= 2),
lines AS (SELECT uid, seg_no, count(*) AS points FROM numbered WHERE uid IN (FROM movers) GROUP BY ALL HAVING count(*) >= 2),
pieces AS (SELECT uid, seg_no, date_trunc('hour', servertime) AS hr, {_LINE} AS path FROM numbered GROUP BY ALL)
SELECT sha256('check|' || uid || '|' || seg_no) AS line_id,
  CAST(row_number() OVER (PARTITION BY uid, seg_no ORDER BY hr) AS INT) AS piece_no, points, path
FROM lines JOIN pieces USING (uid, seg_no)""",
)
def trails(t):
    return tracks.trails(t["dense_cot"], P, GAP, secret="check")


@registered(
    "stationary_repeats", "W7", "cot",
    """
SELECT id, uid, servertime, coalesce(row_number() OVER w > 1
  AND latitude IS NOT DISTINCT FROM lag(latitude) OVER w
  AND longitude IS NOT DISTINCT FROM lag(longitude) OVER w, FALSE) AS stationary_repeat
FROM cot WINDOW w AS (PARTITION BY uid ORDER BY servertime, id)""",
)
def stationary_repeats(t):
    points = t["cot"].select("id", "uid", "servertime", "latitude", "longitude")
    return tracks.stationary_repeats(points).drop("latitude", "longitude")


def _named_points(t):
    return matching_positions(t["cot"], P).select(
        "id", "uid", "servertime", "latitude", "longitude", "cot_type",
        detail_attribute("callsign").alias("callsign"),
    )


_ENDS = f"""
WITH m AS (SELECT *, {attr('callsign')} AS callsign FROM cot WHERE {MATCHING}),
ends AS (SELECT uid, count(*) AS positions,
  arg_min(struct_pack(a := servertime, b := latitude, c := longitude, d := callsign, e := cot_type), (servertime, id)) AS f,
  arg_max(struct_pack(a := servertime, b := latitude, c := longitude), (servertime, id)) AS l
  FROM m GROUP BY uid),
flat AS (SELECT uid, coalesce(nullif(f.d, ''), uid) AS label, f.e AS cot_type, positions, f.a AS first_time,
  f.b AS first_lat, f.c AS first_lon, l.a AS last_time, l.b AS last_lat, l.c AS last_lon FROM ends),
kinds AS (SELECT *, CASE WHEN cot_type LIKE 'a-%-G-U-%' THEN 'Personnel' WHEN cot_type LIKE 'a-%-G-E-%' THEN 'Vehicles and equipment'
  WHEN cot_type LIKE 'a-%-G-I%' THEN 'Infrastructure' WHEN cot_type LIKE 'u-d-%' OR cot_type LIKE 'b-m-%' THEN 'Map objects'
  WHEN cot_type LIKE 'a-%' THEN 'Other entities' ELSE 'Other' END AS category FROM flat)
"""


@registered("first_and_last_positions", "W3", "cot", _ENDS + "SELECT * FROM flat")
def first_and_last_positions(t):
    return tracks.first_and_last(_named_points(t))


@registered("devices_by_category", "O7", "cot", _ENDS + "SELECT category, label, uid, positions FROM kinds")
def devices_by_category(t):
    return tracks.devices_by_category(_named_points(t))


@registered(
    "category_totals", "A8", "cot",
    _ENDS + "SELECT category, count(*) AS devices, CAST(sum(positions) AS BIGINT) AS positions FROM kinds GROUP BY category",
)
def category_totals(t):
    return tracks.category_totals(_named_points(t))


@registered(
    "point_features", "G14 P9 P10 P11 P12", "cot",
    f"""
WITH m AS (SELECT *, {attr('callsign')} AS cs, {attr('speed_ms')} AS sp, {attr('course_deg')} AS co FROM cot WHERE {MATCHING})
SELECT id, coalesce(nullif(cs, ''), uid, 'unknown') AS label, servertime, latitude, longitude,
  CASE WHEN cot_type LIKE 'a-%-G-U-%' THEN 'Personnel' WHEN cot_type LIKE 'a-%-G-E-%' THEN 'Vehicles and equipment'
  WHEN cot_type LIKE 'a-%-G-I%' THEN 'Infrastructure' WHEN cot_type LIKE 'u-d-%' OR cot_type LIKE 'b-m-%' THEN 'Map objects'
  WHEN cot_type LIKE 'a-%' THEN 'Other entities' ELSE 'Other' END AS category,
  CASE WHEN how LIKE 'h-%' THEN 'manualPlaced' WHEN point_ce IS NULL OR point_ce >= 9999999 THEN 'accuracyUnknown' ELSE 'normalFix' END AS fix_class,
  CASE WHEN coalesce(sp, '') = '' THEN 'not reported' WHEN try_cast(sp AS DOUBLE) IS NULL THEN 'not numeric'
    WHEN try_cast(sp AS DOUBLE) < 0 THEN 'unavailable' WHEN try_cast(sp AS DOUBLE) = 0 THEN 'stationary' ELSE 'moving' END AS speed_status,
  CASE WHEN try_cast(sp AS DOUBLE) >= 0 THEN try_cast(sp AS DOUBLE) END AS speed_mps,
  round(CASE WHEN try_cast(sp AS DOUBLE) >= 0 THEN try_cast(sp AS DOUBLE) END * 2.23694::DOUBLE, 1) AS speed_mph,
  CASE WHEN coalesce(co, '') = '' THEN 'not reported' WHEN try_cast(co AS DOUBLE) IS NULL THEN 'not numeric'
    WHEN try_cast(co AS DOUBLE) < 0 OR try_cast(co AS DOUBLE) >= 9999999 THEN 'unavailable' ELSE 'reported' END AS course_status,
  CASE WHEN try_cast(co AS DOUBLE) >= 0 AND try_cast(co AS DOUBLE) < 9999999 THEN try_cast(co AS DOUBLE) END AS course_deg,
  CASE WHEN point_ce < 9999999 THEN point_ce END AS accuracy_m
FROM m""",
)
def point_features(t):
    return tracks.point_features(t["cot"], P)

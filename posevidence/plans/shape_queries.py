"""Queries over drawn shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from posevidence.functions import classify, geometry
from posevidence.operators import results, shapes
from posevidence.operators.results import manifest as build_manifest
from posevidence.params import Box
from posevidence.materialize import settle
from posevidence.plans.registry import (
    IN_WINDOW,
    attr,
    decoded,
    registered,
    window_on,
)
from posevidence.sources.adapter import CHECK_PARAMS

P = CHECK_PARAMS

_IS_SHAPE = "(cot_type LIKE 'u-d-%' OR cot_type LIKE 'b-m-%')"

# The check reads the blobs of the check tables with patterns; segments are
# clipped against the box, a different method from the operator's.
_FACTS = f"""
facts AS (
  SELECT id, uid, servertime, time AS event_time, cot_type, latitude, longitude, groups,
    {attr('callsign')} AS callsign,
    coalesce(list_transform(regexp_extract_all(detail, '<link point="([^"]*)"', 1),
      lambda x: [CAST(split_part(x, ',', 1) AS DOUBLE), CAST(split_part(x, ',', 2) AS DOUBLE)]), []) AS v,
    CAST(nullif(regexp_extract(detail, '<ellipse major="([^"]*)"', 1), '') AS DOUBLE) AS major,
    CAST(nullif(regexp_extract(detail, ' minor="([^"]*)"', 1), '') AS DOUBLE) AS minor,
    CAST(nullif(regexp_extract(detail, ' angle="([^"]*)"', 1), '') AS DOUBLE) AS angle,
    CAST(nullif(regexp_extract(detail, '<strokeColor value="([^"]*)"', 1), '') AS BIGINT) AS stroke,
    CAST(nullif(regexp_extract(detail, '<fillColor value="([^"]*)"', 1), '') AS BIGINT) AS fill,
    CAST(nullif(regexp_extract(detail, '<strokeWeight value="([^"]*)"', 1), '') AS DOUBLE) AS weight,
    coalesce(regexp_extract(detail, '<creator uid="([^"]*)"', 1), '') AS creator_uid,
    coalesce(regexp_extract(detail, '<creator [^>]*callsign="([^"]*)"', 1), '') AS creator_callsign,
    coalesce(regexp_extract(detail, '<creator [^>]*time="([^"]*)"', 1), '') AS creator_time,
    CASE WHEN contains(detail, '<__nodered') THEN '__nodered' END AS mark
  FROM cot WHERE {IN_WINDOW} AND {_IS_SHAPE}),
kinds AS (
  SELECT *, CASE
    WHEN len(v) >= 4 AND v[1] = v[len(v)] THEN 'polygon'
    WHEN len(v) >= 2 THEN 'line'
    WHEN latitude IS NULL THEN NULL
    WHEN major IS NULL THEN 'point'
    WHEN starts_with(cot_type, 'u-d-c-c') OR minor IS NULL OR abs(major - minor) < 1e-6 THEN 'circle'
    ELSE 'ellipse' END AS kind
  FROM facts)"""


def _touching(box: Box) -> str:
    s, n, w, e = box.south, box.north, box.west, box.east
    return f"""
sides AS (
  SELECT id, v[i][1] AS y, v[i][2] AS x, v[i + 1][1] - v[i][1] AS dy, v[i + 1][2] - v[i][2] AS dx
  FROM kinds, unnest(range(1, len(v))) AS u(i)),
spans AS (
  SELECT id,
    CASE WHEN dy = 0 THEN if(y BETWEEN {s} AND {n}, 0.0::DOUBLE, 2) ELSE least(({s} - y) / dy, ({n} - y) / dy) END AS y0,
    CASE WHEN dy = 0 THEN 1.0::DOUBLE ELSE greatest(({s} - y) / dy, ({n} - y) / dy) END AS y1,
    CASE WHEN dx = 0 THEN if(x BETWEEN {w} AND {e}, 0.0::DOUBLE, 2) ELSE least(({w} - x) / dx, ({e} - x) / dx) END AS x0,
    CASE WHEN dx = 0 THEN 1.0::DOUBLE ELSE greatest(({w} - x) / dx, ({e} - x) / dx) END AS x1
  FROM sides),
clipped AS (SELECT id, bool_or(greatest(y0, x0, 0) <= least(y1, x1, 1)) AS hit FROM spans GROUP BY id),
discs AS (
  SELECT id, latitude AS a, least(greatest(latitude, {s}), {n}) AS b,
    least(greatest(longitude, {w}), {e}) - longitude AS dl, major FROM kinds WHERE kind IN ('circle', 'ellipse')),
near AS (
  SELECT id, 2 * 6371008.8 * asin(least(1, sqrt(sin(radians(b - a) / 2) ** 2
    + cos(radians(a)) * cos(radians(b)) * sin(radians(dl) / 2) ** 2))) <= major AS hit FROM discs),
hits AS (
  SELECT kinds.*, coalesce(CASE WHEN kind IN ('polygon', 'line') THEN clipped.hit
    WHEN kind IN ('circle', 'ellipse') THEN near.hit
    WHEN kind = 'point' THEN latitude BETWEEN {s} AND {n} AND longitude BETWEEN {w} AND {e} END, FALSE) AS touches
  FROM kinds LEFT JOIN clipped USING (id) LEFT JOIN near USING (id))"""


_FATES = f"""
{_FACTS},
{_touching(P.box)},
fates AS (
  SELECT uid, count(kind) AS versions,
    coalesce(string_agg(DISTINCT mark, '+' ORDER BY mark) FILTER (WHERE kind IS NOT NULL), '') AS feed_marks,
    CASE WHEN count(kind) = 0 THEN 'no geometry'
      WHEN count(mark) FILTER (WHERE kind IS NOT NULL) > 0 THEN 'feed'
      WHEN NOT bool_or(touches) THEN 'excluded' ELSE 'included' END AS fate
  FROM hits GROUP BY uid)"""

_DELETIONS = f"""
removed AS (
  SELECT uid, arg_min(ts, (ts, id)) AS deleted_at, arg_min(coalesce(creatoruid, ''), (ts, id)) AS deleted_by,
    arg_min(mission_id, (ts, id)) AS deleted_in
  FROM mission_change WHERE change_type = 3 AND {window_on('ts')} GROUP BY uid)"""


def _versions(t):
    return results.shape_versions(t["cot"], P, t.decoder)


def _parsed(t):
    return shapes.parse_shapes(_versions(t))


def _parsed_once(t):
    """For plans that read the parsed versions in more than one branch."""
    return settle(_parsed(t))


def _deletions(t):
    return results.shape_deletions(t["mission_change"], P)


def _included(t):
    parsed = _parsed_once(t)
    return shapes.included_versions(parsed, shapes.object_fates(parsed, P.box))


@registered(
    "shape_versions", "F9", "cot channels",
    f"""
WITH {decoded('cot')}
SELECT id, uid, servertime, time AS event_time, cot_type, how, {attr('callsign')} AS callsign, latitude, longitude,
  d.channels, d.channel_numbers, detail AS raw_detail
FROM cot LEFT JOIN decoded d ON d.mask = groups WHERE {IN_WINDOW} AND {_IS_SHAPE}""",
)
def shape_versions(t):
    return _versions(t)


@registered(
    "shape_deletions", "F10", "mission_change",
    f"SELECT id, ts, uid, creatoruid, mission_id FROM mission_change WHERE change_type = 3 AND {window_on('ts')}",
)
def shape_deletions(t):
    return _deletions(t)


@registered(
    "first_deletions", "J12", "mission_change",
    f"""
SELECT uid, ts AS deleted_at, creatoruid AS deleted_by, mission_id AS deleted_in FROM (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts, id) AS n
  FROM mission_change WHERE change_type = 3 AND {window_on('ts')}) WHERE n = 1""",
)
def first_deletions(t):
    return shapes.first_deletions(_deletions(t))


@registered(
    "latest_shape_versions", "W2", "cot",
    f"""
SELECT id, uid, servertime, cot_type FROM cot WHERE {IN_WINDOW} AND {_IS_SHAPE}
QUALIFY row_number() OVER (PARTITION BY uid ORDER BY servertime DESC, id DESC) = 1""",
)
def latest_shape_versions(t):
    return shapes.latest_versions(_versions(t).select("id", "uid", "servertime", "cot_type"))


@registered(
    "parsed_shapes", "G1 G2", "cot",
    f"""
WITH {_FACTS}
SELECT id, kind, if(len(v) >= 2, array_to_string(list_transform(v, lambda p: p[1] || ',' || p[2]), ' '), '') AS vertices,
  coalesce(kind = 'polygon', FALSE) AS closed, if(len(v) >= 2, NULL, latitude) AS center_lat, if(len(v) >= 2, NULL, longitude) AS center_lon,
  major AS radius_m, minor AS minor_m, angle AS angle_deg, stroke AS stroke_argb, fill AS fill_argb, weight AS stroke_weight,
  coalesce(callsign, '') AS callsign, creator_uid, creator_callsign, creator_time, mark AS feed_mark FROM kinds""",
)
def parsed_shapes(t):
    # The Python reading and the native kind rules over every version.
    flat = _parsed(t).select("id", "geom.*")
    return flat.drop("vertices").withColumnRenamed("vertices_text", "vertices")


@registered("shape_fates", "G3 G4 G5 G7", "cot", f"WITH {_FATES} SELECT uid, fate, versions, feed_marks FROM fates")
def shape_fates(t):
    return shapes.object_fates(_parsed(t), P.box).drop("last")


_ARGB = "coalesce(lpad(printf('%X', {0} & 4294967295), 8, '0'), '')"


@registered(
    "shapes_result", "G8 U3 P25", "cot channels mission_change",
    f"""
WITH {_FATES}, {decoded('cot')}, {_DELETIONS},
kept AS (SELECT h.*, d.channels, d.channel_numbers FROM hits h LEFT JOIN decoded d ON d.mask = h.groups
  WHERE kind IS NOT NULL AND uid IN (SELECT uid FROM fates WHERE fate = 'included')),
newest AS (SELECT uid, arg_max(kind, (servertime, id)) AS kind, arg_max(cot_type, (servertime, id)) AS cot_type FROM kept GROUP BY uid)
SELECT 'version' AS record, uid, kind AS shape_kind, cot_type, servertime, event_time, coalesce(callsign, '') AS callsign,
  creator_uid, creator_callsign, creator_time,
  if(len(v) >= 2, array_to_string(list_transform(v, lambda p: p[1] || ',' || p[2]), ' '), '') AS vertices,
  if(kind = 'polygon', 'yes', 'no') AS closed, if(len(v) >= 2, NULL, latitude) AS center_lat, if(len(v) >= 2, NULL, longitude) AS center_lon,
  major AS radius_m, minor AS minor_radius_m, angle AS angle_deg, {_ARGB.format('stroke')} AS stroke_argb, {_ARGB.format('fill')} AS fill_argb,
  weight AS stroke_weight, channels, channel_numbers, NULL::BIGINT AS mission_id, id::VARCHAR AS record_id
FROM kept
UNION ALL
SELECT 'deleted', uid, kind, cot_type, deleted_at, NULL, '', if(trim(deleted_by) = '', '(not recorded)', trim(deleted_by)), '', '', '', '',
  NULL, NULL, NULL, NULL, NULL, '', '', NULL, '', '', deleted_in, ''
FROM newest JOIN removed USING (uid)""",
)
def shapes_result(t):
    parsed = _parsed_once(t)
    return shapes.shapes_result(parsed, shapes.object_fates(parsed, P.box), _deletions(t))


@registered(
    "shapes_ordered", "O5", "cot",
    f"""
WITH {_FATES}
SELECT uid, servertime, id::VARCHAR AS record_id FROM hits
WHERE kind IS NOT NULL AND uid IN (SELECT uid FROM fates WHERE fate = 'included')
ORDER BY servertime::VARCHAR, uid, record_id LIMIT 30""",
)
def shapes_ordered(t):
    parsed = _parsed_once(t)
    none = _deletions(t).filter(F.lit(False))
    result = shapes.shapes_result(parsed, shapes.object_fates(parsed, P.box), none)
    return shapes.ordered_shapes(result).select("uid", "servertime", "record_id").limit(30)


@registered(
    "shape_summary", "A9", "cot mission_change",
    f"""
WITH {_FATES}, {_DELETIONS}
SELECT count(*) FILTER (WHERE fate = 'included') AS included, count(*) FILTER (WHERE fate = 'excluded') AS excluded,
  count(*) FILTER (WHERE fate = 'no geometry') AS no_geometry, count(*) FILTER (WHERE fate = 'feed') AS feed_objects,
  coalesce(CAST(sum(versions) FILTER (WHERE fate = 'feed') AS BIGINT), 0) AS feed_versions,
  count(*) FILTER (WHERE fate = 'included' AND uid IN (SELECT uid FROM removed)) AS deletions
FROM fates""",
)
def shape_summary(t):
    return shapes.shape_summary(shapes.object_fates(_parsed(t), P.box), _deletions(t))


@registered(
    "feed_mark_counts", "A9", "cot",
    f"""
WITH {_FACTS} SELECT mark, count(DISTINCT uid) AS objects FROM kinds WHERE kind IS NOT NULL AND mark IS NOT NULL GROUP BY mark""",
)
def feed_mark_counts(t):
    return shapes.feed_mark_counts(shapes.object_fates(_parsed(t), P.box))


@registered(
    "manifest_with_shapes", "J13", "cot",
    f"""
WITH {_FATES},
seen AS (SELECT uid, count(*) AS total_events,
  bool_or(coalesce({_IS_SHAPE}, FALSE)) AS is_shape FROM cot WHERE {IN_WINDOW} GROUP BY uid)
SELECT uid, total_events, CASE WHEN NOT is_shape THEN 'n/a - not a drawn map object'
  WHEN fate = 'included' THEN 'yes'
  WHEN fate = 'feed' THEN 'no - from an automated feed (the record carries a ' || feed_marks || ' element)'
  WHEN fate = 'excluded' THEN 'no - no part of the shape touched the bounding box'
  WHEN fate = 'no geometry' THEN 'no - no drawable geometry in any version'
  ELSE 'no - not on a selected channel' END AS in_shapes_export
FROM seen LEFT JOIN fates USING (uid)""",
)
def manifest_with_shapes(t):
    fates = shapes.object_fates(_parsed(t), P.box)
    return shapes.manifest_with_shapes(build_manifest(t["cot"], P), fates).select(
        "uid", "total_events", "in_shapes_export"
    )


@registered(
    "outlines", "G11", "cot",
    f"""
WITH {_FACTS}, {_touching(P.box)},
newest AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY uid ORDER BY servertime DESC, id DESC) = 1)
SELECT if(kind = 'ellipse', 'polygon', kind) AS kind, if(kind = 'ellipse', 65, if(kind = 'circle', NULL, len(v)))::INT AS points,
  if(kind = 'circle', latitude, NULL) AS center_lat, if(kind = 'circle', longitude, NULL) AS center_lon, if(kind = 'circle', major, NULL) AS radius_m
FROM newest WHERE kind IS NOT NULL AND kind <> 'point' AND mark IS NULL AND touches""",
)
def outlines(t):
    # Only the newest version of each object is parsed.
    latest = shapes.parse_shapes(shapes.latest_versions(_versions(t)))
    drawn = shapes.outlines(latest, P.box)
    return drawn.withColumn("points", F.when(F.col("latlngs").isNotNull(), F.size("latlngs"))).drop("latlngs")


_VALID = f"""
drawn AS (SELECT * FROM kinds WHERE kind IS NOT NULL AND kind <> 'point'),
valid AS (
  SELECT drawn.*, row_number() OVER w AS version_no, count(*) OVER (PARTITION BY uid) AS version_count,
    servertime AS valid_from, coalesce(lead(servertime) OVER w, deleted_at) AS valid_to
  FROM drawn LEFT JOIN removed USING (uid) WINDOW w AS (PARTITION BY uid ORDER BY servertime, id))"""


@registered(
    "shape_validity", "W5", "cot mission_change",
    f"""
WITH {_FACTS}, {_DELETIONS}, {_VALID}
SELECT uid, id, kind, version_no, version_count, valid_from, valid_to FROM valid""",
)
def shape_validity(t):
    valid = shapes.version_validity(_parsed_once(t), _deletions(t))
    return valid.select(
        "uid", "id", F.col("geom.kind").alias("kind"), "version_no", "version_count", "valid_from", "valid_to"
    )


@registered(
    "shapes_current_at", "J21", "cot mission_change",
    f"""
WITH {_FACTS}, {_DELETIONS}, {_VALID}
SELECT m.id AS moment_id, m.uid, m.ts AS at, v.id AS version_id, v.version_no
FROM (SELECT id, uid, ts FROM mission_change WHERE {window_on('ts')}) m
JOIN valid v ON v.uid = m.uid AND v.valid_from <= m.ts AND (v.valid_to IS NULL OR m.ts < v.valid_to)""",
)
def shapes_current_at(t):
    moments = results.mission_changes(t["mission_change"], P).select(
        F.col("id").alias("moment_id"), "uid", F.col("ts").alias("at")
    )
    valid = shapes.version_validity(_parsed_once(t), _deletions(t)).select(
        "uid", F.col("id").alias("version_id"), "version_no", "valid_from", "valid_to"
    )
    return shapes.current_at(valid, moments).drop("valid_from", "valid_to")


@registered(
    "shape_labels", "W6", "cot",
    f"""
WITH {_FATES},
kept AS (SELECT * FROM hits WHERE kind IS NOT NULL AND uid IN (SELECT uid FROM fates WHERE fate = 'included')),
named AS (SELECT uid, coalesce(nullif(coalesce(arg_max(coalesce(callsign, ''), (servertime, id)) FILTER (WHERE kind <> 'point'), ''), ''), uid) AS l
  FROM kept GROUP BY uid)
SELECT uid, if(count(*) OVER (PARTITION BY l) > 1, l || ' [' || substr(uid, 1, 8) || ']', l) AS label FROM named""",
)
def shape_labels(t):
    return shapes.object_labels(_included(t))


_FOOTPRINTS = f"""
rings AS (
  SELECT id, abs(sum(v[i][2] * v[i + 1][1] - v[i + 1][2] * v[i][1])) / 2 AS area
  FROM kinds, unnest(range(1, len(v))) AS u(i) WHERE kind = 'polygon' GROUP BY id),
discs16 AS (
  SELECT id, latitude AS lat0, longitude AS lon0, major, coalesce(minor, major) AS mi, radians(90 - coalesce(angle, 0)) AS rot,
    2 * pi() * 6371008.8 / 360 AS mlat FROM kinds WHERE kind IN ('circle', 'ellipse')),
corners AS (
  SELECT id, i, lat0 + (major * cos(2 * pi() * (i % 16) / 16) * sin(rot) + mi * sin(2 * pi() * (i % 16) / 16) * cos(rot)) / mlat AS y,
    lon0 + (major * cos(2 * pi() * (i % 16) / 16) * cos(rot) - mi * sin(2 * pi() * (i % 16) / 16) * sin(rot)) / (mlat * cos(radians(lat0))) AS x
  FROM discs16, unnest(range(0, 17)) AS u(i)),
ovals AS (
  SELECT a.id, abs(sum(a.x * b.y - b.x * a.y)) / 2 AS area FROM corners a JOIN corners b ON b.id = a.id AND b.i = a.i + 1 GROUP BY a.id),
areas AS (SELECT uid, max(coalesce(rings.area, ovals.area, 0)) AS area
  FROM kinds LEFT JOIN rings USING (id) LEFT JOIN ovals USING (id) WHERE kind IS NOT NULL GROUP BY uid)"""


@registered(
    "shape_footprints", "G9 G10 O6", "cot",
    f"""
WITH {_FACTS}, {_FOOTPRINTS}
SELECT uid, round(area * 1e4, 6) AS area FROM areas""",
)
def shape_footprints(t):
    drawable = _parsed(t).filter(F.col("geom.kind").isNotNull())
    # Summation order differs between engines in the last bits.
    return shapes.draw_order(drawable).select("uid", F.round(F.col("area") * 1e4, 6).alias("area"))


_ABGR = (
    "CASE WHEN {0} IS NULL THEN 'ff000000' ELSE lower(printf('%02X%02X%02X%02X', ({0} >> 24) & 255, "
    "{0} & 255, ({0} >> 8) & 255, ({0} >> 16) & 255)) END"
)


@registered(
    "shape_features", "G15 P26", "cot mission_change",
    f"""
WITH {_FATES}, {_DELETIONS},
kept AS (SELECT * FROM hits WHERE kind IS NOT NULL AND uid IN (SELECT uid FROM fates WHERE fate = 'included')),
named AS (SELECT uid, coalesce(nullif(coalesce(arg_max(coalesce(callsign, ''), (servertime, id)) FILTER (WHERE kind <> 'point'), ''), ''), uid) AS l
  FROM kept GROUP BY uid),
labels AS (SELECT uid, if(count(*) OVER (PARTITION BY l) > 1, l || ' [' || substr(uid, 1, 8) || ']', l) AS label FROM named)
SELECT uid, id, label, row_number() OVER w AS version_no, count(*) OVER (PARTITION BY uid) AS version_count,
  deleted_at IS NOT NULL AS deleted, servertime AS valid_from, coalesce(lead(servertime) OVER w, deleted_at) AS valid_to,
  kind, {_ABGR.format('stroke')} AS line_color, {_ABGR.format('fill')} AS fill_color, weight AS stroke_weight,
  if(kind IN ('circle', 'ellipse'), 65, len(v))::INT AS outline_points
FROM kept JOIN labels USING (uid) LEFT JOIN removed USING (uid) WHERE kind <> 'point'
WINDOW w AS (PARTITION BY uid ORDER BY servertime, id)""",
)
def shape_features(t):
    features = shapes.shape_features(settle(_included(t)), _deletions(t))
    return features.withColumn("outline_points", F.size("outline")).drop("outline", "draw_area")


_BOXES = {
    "north": Box(39.95, 39.90, -98.20, -98.50),
    "south": Box(39.85, 39.80, -98.20, -98.50),
    "east": Box(39.95, 39.80, -98.20, -98.25),
}


@registered(
    "touched_boxes", "J14 G6", "cot",
    f"WITH {_FACTS} "
    + " UNION ALL ".join(
        f"SELECT uid, id, '{name}' AS box FROM (WITH {_touching(box).strip()} SELECT uid, id FROM hits WHERE touches AND kind IS NOT NULL)"
        for name, box in _BOXES.items()
    ),
)
def touched_boxes(t):
    return shapes.touched_boxes(_parsed(t), _BOXES)


@registered(
    "distances_to_center", "G4", "cot",
    """
SELECT id, round(2 * 6371008.8 * asin(sqrt(sin(radians(39.875 - latitude) / 2) ** 2
  + cos(radians(latitude)) * cos(radians(39.875)) * sin(radians(-98.35 - longitude) / 2) ** 2)), 3) AS metres
FROM cot WHERE latitude IS NOT NULL""",
)
def distances_to_center(t):
    metres = geometry.haversine_m(F.col("latitude"), F.col("longitude"), F.lit(39.875), F.lit(-98.35))
    return t["cot"].filter(F.col("latitude").isNotNull()).select("id", F.round(metres, 3).alias("metres"))


@registered(
    "colour_codes", "P25 P26", "cot",
    f"""
WITH k AS (SELECT id, CAST(nullif(regexp_extract(detail, '<strokeColor value="([^"]*)"', 1), '') AS BIGINT) AS stroke FROM cot)
SELECT id, {_ARGB.format('stroke')} AS argb, {_ABGR.format('stroke')} AS abgr FROM k""",
)
def colour_codes(t):
    stroke = F.nullif(
        F.regexp_extract("detail", '<strokeColor value="([^"]*)"', 1), F.lit("")
    ).cast("bigint")
    return t["cot"].select("id", stroke.alias("stroke")).select(
        "id",
        classify.argb_hex(F.col("stroke")).alias("argb"),
        classify.argb_to_abgr(F.col("stroke")).alias("abgr"),
    )

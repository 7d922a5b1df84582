"""Streams drained over the check tables, checked against their batch form."""

from __future__ import annotations

from posevidence.functions.predicates import shape_version_filter
from posevidence.materialize import new_folder
from posevidence.operators import results
from posevidence.plans.registry import IN_BOX, IN_WINDOW, MATCHING, REAL, registered, window_on
from posevidence.plans.track_queries import GAP, _segments
from posevidence.sources.adapter import CHECK_PARAMS
from posevidence.streaming import streams

P = CHECK_PARAMS


@registered(
    "streamed_tracks", "T1", "dense_cot",
    f"""
WITH {_segments('dense_cot', GAP)},
sessions AS (SELECT uid, min(servertime) AS begin, max(servertime) AS "end", count(*) AS points FROM numbered GROUP BY uid, seg_no)
SELECT * FROM sessions""",
)
def streamed_tracks(t):
    events = t.stream("dense_cot").select("uid", "servertime")
    return streams.drained(events, lambda e: streams.session_tracks(e, GAP), "session-tracks")[0]


@registered(
    "streamed_counts", "T2", "cot",
    f"""
SELECT uid, date_trunc('minute', servertime) AS window_start, count(*) AS total_events,
  count(*) FILTER (WHERE {REAL}) AS events_with_position, count(*) FILTER (WHERE latitude = 0 AND longitude = 0) AS events_at_0_0,
  count(*) FILTER (WHERE latitude IS NULL) AS events_no_geometry, count(*) FILTER (WHERE {REAL} AND {IN_BOX}) AS events_inside_box,
  count(*) FILTER (WHERE {REAL} AND {IN_BOX}) AS events_exported, count(*) FILTER (WHERE {MATCHING}) AS records
FROM cot GROUP BY 1, 2""",
)
def streamed_counts(t):
    return streams.drained(t.stream("cot"), lambda e: streams.window_counts(e, P), "window-counts")[0]


@registered(
    "streamed_latest_shapes", "T3", "cot mission_change",
    f"""
WITH v AS (SELECT uid, max(id) AS id, any_value(servertime) AS servertime, any_value(cot_type) AS cot_type FROM (
    SELECT * FROM cot WHERE {IN_WINDOW} AND (cot_type LIKE 'u-d-%' OR cot_type LIKE 'b-m-%')
    QUALIFY row_number() OVER (PARTITION BY uid ORDER BY servertime DESC, id DESC) = 1) GROUP BY uid),
d AS (SELECT uid, ts AS deleted_at, mission_id AS deleted_in FROM mission_change WHERE change_type = 3 AND {window_on('ts')}
    QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ts, id) = 1)
SELECT * FROM v FULL JOIN d USING (uid)""",
)
def streamed_latest_shapes(t):
    versions = t.stream("cot").filter(shape_version_filter(P))
    deletions = results.shape_deletions(t.stream("mission_change"), P)
    updates = streams.shape_updates(versions, deletions)
    return streams.latest_shapes(streams.run_updating(updates, new_folder(t.spark, "latest-shapes")))

"""Queries on structure, decoding and liveness."""

from __future__ import annotations

from pyspark.sql import functions as F

from posevidence.operators import aggregates, audit, drift
from posevidence.plans.registry import attr, decoded, registered
from posevidence.sources.adapter import AS_OF, RELATIONS

SEEN_BEFORE = "2024-01-20 00:00:00"


@registered("schema_fingerprint", "V1 A13")
def schema_fingerprint(t):
    # Structure of every relation, with the mask widths found in the events.
    columns = drift.schema_columns({name: t[name] for name in sorted(RELATIONS)})
    return drift.schema_fingerprint(columns, aggregates.mask_widths(t["cot"]))


_SAMPLE = """
newest AS (SELECT * FROM cot WHERE groups IS NOT NULL ORDER BY servertime DESC, id DESC LIMIT 200)"""


@registered(
    "newest_sample", "O9", "cot",
    f"WITH {_SAMPLE} SELECT id, servertime FROM newest",
)
def newest_sample(t):
    return drift.newest_sample(t["cot"]).select("id", "servertime")


_HEALTH = f"""
{_SAMPLE}, {decoded('newest')},
health AS (
  SELECT count(*) AS seen, count(d.channels) AS decoded, count({attr('callsign')}) AS callsigns, (SELECT count(*) FROM channels) AS defined
  FROM newest LEFT JOIN decoded d ON d.mask = groups)"""


@registered(
    "decode_health", "V3 O9", "cot channels",
    f"""
WITH {_HEALTH}
SELECT *, CASE WHEN seen = 0 THEN 'skip' WHEN defined = 0 THEN 'warn' WHEN decoded > 0 THEN 'ok' ELSE 'fail' END AS channels_status,
  CASE WHEN seen = 0 OR defined = 0 THEN 'skip' WHEN callsigns > 0 THEN 'ok' ELSE 'warn' END AS callsigns_status FROM health""",
)
def decode_health(t):
    return drift.decode_health(t["cot"], t["channels"], t.decoder)


@registered(
    "liveness", "V4 A7", "cot",
    f"""
SELECT min(servertime) AS oldest, max(servertime) AS newest,
  CAST(epoch(TIMESTAMP '{AS_OF}') AS BIGINT) - CAST(floor(epoch(max(servertime))) AS BIGINT) AS age_seconds,
  CASE WHEN max(servertime) <> TIMESTAMP '{SEEN_BEFORE}' THEN 'ok' ELSE 'warn' END AS status FROM cot""",
)
def liveness(t):
    return drift.liveness(t["cot"], AS_OF, SEEN_BEFORE, "2024-01-20 00:10:00Z")


@registered(
    "check_summary", "A12", "cot channels export_log",
    f"""
WITH {_HEALTH},
recent AS (SELECT trim(regexp_extract(detail, '(?:^|; )source database: ([^;]+)', 1)) AS identity FROM export_log
  WHERE export_kind IN ('package', 'locations') AND contains(detail, 'source database: ') ORDER BY id DESC LIMIT 50),
items AS (
  SELECT CASE WHEN seen = 0 THEN 'skip' WHEN defined = 0 THEN 'warn' WHEN decoded > 0 THEN 'ok' ELSE 'fail' END AS status FROM health
  UNION ALL SELECT CASE WHEN seen = 0 OR defined = 0 THEN 'skip' WHEN callsigns > 0 THEN 'ok' ELSE 'warn' END FROM health
  UNION ALL SELECT if(bool_or(abs(latitude) > 90 OR abs(longitude) > 180), 'fail', 'ok') FROM cot
  UNION ALL SELECT 'ok' FROM (SELECT max(servertime) FROM cot)
  UNION ALL SELECT if(count(*) = 0 OR bool_or(identity = 'cluster 99'), 'ok', 'warn') FROM recent)
SELECT count(*) FILTER (WHERE status = 'skip') AS skip, count(*) FILTER (WHERE status = 'ok') AS ok,
  count(*) FILTER (WHERE status = 'warn') AS warn, count(*) FILTER (WHERE status = 'fail') AS fail,
  CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' WHEN bool_or(status = 'ok') THEN 'ok' ELSE 'skip' END AS verdict
FROM items""",
)
def check_summary(t):
    health = drift.decode_health(t["cot"], t["channels"], t.decoder)
    items = drift.combine_items(
        {
            "channels": health.select(F.col("channels_status").alias("status")),
            "callsigns": health.select(F.col("callsigns_status").alias("status")),
            "geometry": aggregates.geometry_sanity(t["cot"]),
            "liveness": drift.liveness(t["cot"], AS_OF, SEEN_BEFORE, None),
            "identity": audit.identity_check("cluster 99", audit.recent_source_identities(t["export_log"])),
        }
    )
    return drift.check_summary(items)

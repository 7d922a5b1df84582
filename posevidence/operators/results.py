"""The result sets of an extract, one function per set.

Every function takes and returns DataFrames and runs nothing. Results carry no
sort: a global order costs a range shuffle, so it is applied where a result is
written or previewed (``RESULT_ORDER``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posevidence.functions import classify
from posevidence.functions.predicates import (
    at_null_island,
    has_point,
    in_box,
    in_window,
    on_channels,
    position_filter,
    real_position,
    shape_version_filter,
)
from posevidence.functions.text import (
    detail_attribute,
    distinct_text,
    redact_all_credentials,
    redact_first_credentials,
)
from posevidence.operators.channels import ChannelDecoder
from posevidence.operators.sequences import PIECE, distinct_in_pieces
from posevidence.params import ExportParams

# The order each result is written in; ties are settled by an id so that the
# same rows always give the same bytes.
RESULT_ORDER = {
    "positions": ["uid", "servertime", "id"],
    "locations": ["uid", "servertime", "id"],
    "positions_plain": ["servertime", "id"],
    "raw_rows": ["servertime", "CAST(id AS BIGINT)"],
    "manifest": ["- events_exported", "- total_events", "uid"],
    "connections": ["created_ts", "uid"],
    "chat": ["servertime", "id"],
    "missions": ["create_time", "id"],
    "mission_changes": ["ts", "id"],
    "mission_subscriptions": ["create_time", "client_uid"],
    "mission_contents": ["record_kind", "mission_id", "item_ref"],
    "files": ["submissiontime", "id"],
    "attachments": ["servertime", "attachment_kind", "attachment_id"],
    "video": ["created", "id"],
    "data_feeds": ["id"],
    "federation": ["event_time", "fed_id"],
}


def ordered(name: str, df: DataFrame) -> DataFrame:
    return df.orderBy(*[F.expr(key) for key in RESULT_ORDER[name]])


def preview(name: str, df: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows of exactly the result that would be written."""
    return ordered(name, df).limit(rows)


def matching_positions(cot: DataFrame, params: ExportParams) -> DataFrame:
    """The shared upstream of every positional result."""
    return cot.filter(position_filter(params) & on_channels(params.channels))


def feed_names(links: DataFrame, feeds: DataFrame) -> DataFrame:
    """Distinct feed names per event, joined in name order."""
    return (
        links.join(feeds.select(F.col("id").alias("data_feed_id"), "name"), "data_feed_id")
        .groupBy(F.col("cot_router_id").alias("id"))
        .agg(distinct_text(F.col("name"), ", ").alias("data_feed_names"))
    )


def image_counts(images: DataFrame) -> DataFrame:
    return images.groupBy(F.col("cot_id").alias("id")).agg(F.count("*").alias("attached_images"))


def _report_columns(latter: list[Column]) -> list[Column]:
    attribute = lambda name: detail_attribute(name).alias(name)
    return [
        F.col("id"),
        F.col("time").alias("event_time"),
        F.col("servertime"),
        F.col("latitude"),
        F.col("longitude"),
        F.col("uid"),
        attribute("callsign"),
        F.col("point_ce").alias("ce_m"),
        F.col("how"),
        F.col("cot_type"),
        attribute("geopoint_src"),
        *latter,
        attribute("reported_team"),
        attribute("reported_role"),
        attribute("course_deg"),
        attribute("speed_ms"),
        F.col("point_hae").alias("hae_m"),
        F.col("point_le").alias("le_m"),
        F.col("start").alias("event_start"),
        F.col("stale"),
        attribute("battery_pct"),
        attribute("device_model"),
        attribute("tak_platform"),
        attribute("tak_version"),
        attribute("remarks"),
    ]


_HANDLING = ["access", "opex", "caveat", "releaseableto"]


def positions(
    cot: DataFrame,
    params: ExportParams,
    decoder: ChannelDecoder,
    feed_links: DataFrame,
    feeds: DataFrame,
    images: DataFrame,
) -> DataFrame:
    """The main result: every matching report with its readable columns."""
    found = decoder.add(matching_positions(cot, params))
    # Both sides are reduced to one row per event before they meet it.
    found = found.join(feed_names(feed_links, feeds), "id", "left").join(
        image_counts(images), "id", "left"
    )
    return found.select(
        *_report_columns([F.col("channels"), F.col("channel_numbers")]),
        F.col("data_feed_names"),
        F.coalesce("attached_images", F.lit(0)).alias("attached_images"),
        *_HANDLING,
        F.col("detail").alias("raw_detail"),
    )


def locations(cot: DataFrame, params: ExportParams, decoder: ChannelDecoder) -> DataFrame:
    """The single-file variant: no channel numbers, feeds or images."""
    found = decoder.add(matching_positions(cot, params), numbers=False)
    return found.select(
        *_report_columns([F.col("channels")]), *_HANDLING, F.col("detail").alias("raw_detail")
    )


def positions_plain(cot: DataFrame, params: ExportParams) -> DataFrame:
    """The readable superset: window and exact box only."""
    return cot.filter(in_window("servertime", params) & has_point() & in_box(params.box)).select(
        "id", "uid", detail_attribute("callsign").alias("callsign"), "servertime", "latitude", "longitude"
    )


def raw_rows(cot: DataFrame, params: ExportParams) -> DataFrame:
    """Every stored column as text, for exactly the rows ``positions`` holds."""
    point = ("latitude", "longitude")
    stored = [c for c in cot.columns if c not in point]
    return matching_positions(cot, params).select(
        *[F.col(f"`{c}`").cast("string").alias(c) for c in (*stored, *point)]
    )


def manifest(cot: DataFrame, params: ExportParams) -> DataFrame:
    """One row per device active in the window, in the extract or not, and why.

    The roster is narrowed by time only. Counting is done twice: first per
    device, type and callsign, where a device holding a large share of all rows
    is reduced map-side to its few combinations, then per device.
    """
    real = real_position()
    inside = real & in_box(params.box)
    exported = inside & on_channels(params.channels)
    partial = (
        cot.filter(in_window("servertime", params))
        .groupBy("uid", "cot_type", detail_attribute("callsign").alias("callsign"))
        .agg(
            F.count("*").alias("total_events"),
            F.count_if(real).alias("events_with_position"),
            F.count_if(at_null_island()).alias("events_at_0_0"),
            F.count_if(~has_point()).alias("events_no_geometry"),
            F.count_if(inside).alias("events_inside_box"),
            F.count_if(exported).alias("events_exported"),
            F.min("servertime").alias("first_event"),
            F.max("servertime").alias("last_event"),
        )
    )
    counts = [
        "total_events", "events_with_position", "events_at_0_0",
        "events_no_geometry", "events_inside_box", "events_exported",
    ]
    per_device = partial.groupBy("uid").agg(
        *[F.sum(c).alias(c) for c in counts],
        F.min("first_event").alias("first_event"),
        F.max("last_event").alias("last_event"),
        distinct_text(F.col("cot_type"), " ").alias("cot_types_seen"),
        distinct_text(F.col("callsign"), " ").alias("callsign_seen"),
    )
    return per_device.select(
        "uid",
        classify.uid_kind(F.col("cot_types_seen")).alias("uid_kind"),
        *counts,
        F.when(F.col("events_exported") > 0, "yes").otherwise("no").alias("in_positional_export"),
        classify.exclusion_reason(
            F.col("events_exported"),
            F.col("events_with_position"),
            F.col("events_at_0_0"),
            F.col("events_inside_box"),
        ).alias("exclusion_reason"),
        "first_event",
        "last_event",
        "cot_types_seen",
        "callsign_seen",
    )


def seen_in_pieces(cot: DataFrame, params: ExportParams, keys: tuple[str, ...] = ("uid",), size: int = PIECE) -> DataFrame:
    """The manifest's ``callsign_seen`` for keys of any number of callsigns."""
    rows = cot.filter(in_window("servertime", params)).select(*keys, detail_attribute("callsign").alias("callsign"))
    return distinct_in_pieces(rows, list(keys), "callsign", size)


def shape_versions(cot: DataFrame, params: ExportParams, decoder: ChannelDecoder) -> DataFrame:
    return decoder.add(cot.filter(shape_version_filter(params))).select(
        "id",
        "uid",
        "servertime",
        F.col("time").alias("event_time"),
        "cot_type",
        "how",
        detail_attribute("callsign").alias("callsign"),
        "latitude",
        "longitude",
        "channels",
        "channel_numbers",
        F.col("detail").alias("raw_detail"),
    )


def shape_deletions(changes: DataFrame, params: ExportParams) -> DataFrame:
    return changes.filter(
        (F.col("change_type") == classify.REMOVE_CONTENT) & in_window("ts", params)
    ).select("id", "ts", "uid", "creatoruid", "mission_id")


def connections(
    endpoint_events: DataFrame,
    endpoints: DataFrame,
    event_types: DataFrame,
    params: ExportParams,
    decoder: ChannelDecoder,
) -> DataFrame:
    inside = endpoint_events.filter(
        in_window("created_ts", params) & on_channels(params.channels)
    )
    return (
        decoder.add(inside)
        .join(endpoints.withColumnRenamed("id", "client_endpoint_id"), "client_endpoint_id")
        .join(event_types.withColumnRenamed("id", "connection_event_type_id"), "connection_event_type_id")
        .select(
            "created_ts", "event_name", "uid", "callsign", "username", "team", "role",
            "client_version", "channels", "channel_numbers",
        )
    )


def chat(messages: DataFrame, params: ExportParams, decoder: ChannelDecoder) -> DataFrame:
    """Messages of the window; no box, most messages carry no position."""
    found = messages.filter(in_window("servertime", params) & on_channels(params.channels))
    return decoder.add(found).select(
        "id",
        F.col("time").alias("event_time"),
        "servertime", "sender_callsign", "dest_callsign", "chat_room", "chat_content",
        F.col("uid").alias("sender_uid"),
        "dest_uid", "latitude", "longitude", "cot_type", "how", "channels", "channel_numbers",
        "access", "opex",
        F.col("detail").alias("raw_detail"),
    )


def missions(mission: DataFrame, params: ExportParams, decoder: ChannelDecoder) -> DataFrame:
    return decoder.add(mission.filter(on_channels(params.channels))).select(
        "id", "guid", "name", "description", "creatoruid", "create_time", "last_edited", "tool",
        "chatroom", "classification", "bbox", "bounding_polygon", "base_layer", "path",
        "parent_mission_id", "invite_only", "expiration", "channels", "channel_numbers",
        classify.has_secret(F.col("password_hash")).alias("password_protected"),
    )


def mission_changes(changes: DataFrame, params: ExportParams) -> DataFrame:
    return changes.filter(in_window("ts", params)).select(
        "id", "ts", "servertime", "mission_name", "mission_guid", "mission_id", "change_type",
        classify.change_type_name(F.col("change_type")).alias("change_type_name"),
        "uid", "creatoruid", "hash", "external_data_name", "external_data_uid",
        "external_data_tool", "external_data_notes", "mission_feed_uid", "map_layer_uid",
        "remote_federated_change", "xml_content_for_notification",
    )


def _mission_names(mission: DataFrame) -> DataFrame:
    return mission.select(F.col("id").alias("mission_id"), F.col("name").alias("mission_name"))


def mission_subscriptions(subscriptions: DataFrame, mission: DataFrame) -> DataFrame:
    return subscriptions.join(_mission_names(mission), "mission_id", "left").select(
        "mission_id", "mission_name", "client_uid", "uid", "username", "create_time", "role_id"
    )


def mission_contents(
    items: DataFrame, files: DataFrame, feeds: DataFrame, resources: DataFrame, mission: DataFrame
) -> DataFrame:
    """Map items, attached files and external feeds of missions in one list."""
    named = resources.select(F.col("id").alias("resource_id"), "filename", "mimetype")
    map_items = items.select(
        F.lit("map item (mission_uid)").alias("record_kind"), "mission_id", F.col("uid").alias("item_ref")
    )
    attached = files.join(named, "resource_id", "left").select(
        F.lit("attached file (mission_resource)").alias("record_kind"),
        "mission_id",
        F.col("resource_hash").alias("item_ref"),
        F.col("filename").alias("item_name"),
        F.col("mimetype").alias("notes"),
    )
    external = feeds.select(
        F.lit("external data feed").alias("record_kind"),
        "mission_id",
        F.col("id").alias("item_ref"),
        F.col("name").alias("item_name"),
        "notes",
        "url_display",
    )
    # The three kinds share one join to the mission names.
    everything = map_items.unionByName(attached, allowMissingColumns=True).unionByName(
        external, allowMissingColumns=True
    )
    return everything.join(_mission_names(mission), "mission_id", "left").select(
        "record_kind", "mission_id", "mission_name", "item_ref", "item_name", "notes", "url_display"
    )


def files(resources: DataFrame, params: ExportParams, decoder: ChannelDecoder) -> DataFrame:
    """File inventory: sizes, never contents."""
    return decoder.add(resources.filter(on_channels(params.channels))).select(
        "id", "uid", "name", "filename", "mimetype",
        F.octet_length("data").alias("size_bytes"),
        "hash", "submitter", "creatoruid", "submissiontime", "tool", "latitude", "longitude",
        "altitude", "remarks",
        F.array_join("keywords", " ").alias("keywords"),
        F.array_join("permissions", " ").alias("permissions"),
        "expiration", "channels", "channel_numbers",
    )


def attachments(images: DataFrame, links: DataFrame, cot: DataFrame) -> DataFrame:
    """Images and links with the event they belong to, through one join."""
    parts = images.select(
        F.lit("image").alias("attachment_kind"),
        F.col("id").alias("attachment_id"),
        "cot_id",
        F.octet_length("image").alias("size_bytes"),
    ).unionByName(
        links.select(
            F.lit("link").alias("attachment_kind"),
            F.col("id").alias("attachment_id"),
            F.col("containing_event").alias("cot_id"),
        ),
        allowMissingColumns=True,
    )
    events = cot.select(F.col("id").alias("cot_id"), "uid", "cot_type", "servertime")
    return parts.join(events, "cot_id").select(
        "attachment_kind", "attachment_id", "cot_id", "size_bytes", "uid", "cot_type", "servertime"
    )


def video(connections_: DataFrame, params: ExportParams, decoder: ChannelDecoder) -> DataFrame:
    return decoder.add(connections_.filter(on_channels(params.channels))).select(
        "id", "created", "deleted", "alias", "owner", "uuid", "type", "latitude", "longitude",
        "heading", "fov", "range",
        redact_first_credentials(F.col("url")).alias("url"),
        "channels", "channel_numbers",
        redact_all_credentials(F.col("xml")).alias("raw_xml"),
    )


def data_feeds(
    feeds: DataFrame, feed_types: DataFrame, params: ExportParams, decoder: ChannelDecoder
) -> DataFrame:
    types = feed_types.select(F.col("id").alias("type"), F.col("feed_type").alias("type_name"))
    return (
        decoder.add(feeds.filter(on_channels(params.channels)))
        .join(types, "type", "left")
        .select(
            "id", "uuid", "name", "type", "type_name", "protocol", "port", "iface", "archive",
            "archive_only", "sync", "anongroup", "auth_required", "auth_type", "federated",
            "feed_group", "data_source_endpoint", "predicate_lang", "predicate",
            "sync_cache_retention_seconds", "channels", "channel_numbers",
        )
    )


def federation(events: DataFrame, kinds: DataFrame) -> DataFrame:
    named = kinds.select(F.col("id").alias("event_kind_id"), "event_kind")
    return events.join(named, "event_kind_id", "left").select(
        "fed_id", "fed_name", "event_kind_id", "event_kind", "event_time", "remote", "details"
    )

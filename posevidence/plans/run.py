"""A whole extract: named lazy results, written one by one."""

from __future__ import annotations

import os
from collections.abc import Callable, Collection
from dataclasses import replace
from functools import cache, partial

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from posevidence.materialize import settle
from posevidence.operators import aggregates, results, shapes
from posevidence.operators.channels import ChannelDecoder, excluded_channels
from posevidence.operators.tracks import track_features
from posevidence.params import ExportParams
from posevidence.sources import sinks

OPTIONAL_RESULTS = (
    "positions", "shapes", "connections", "chat", "missions", "mission_changes",
    "mission_subscriptions", "mission_contents", "files", "attachments", "video",
    "data_feeds", "federation",
)


#: What a whole package holds beside the chosen results.
PACKAGE_RESULTS = ("raw_rows", "positions_plain", "tracks", "quality", "census", "log_extent", "redactions", "extent")
#: Written as delimited lines, as the server's own tool prints them.
DELIMITED = ("raw_rows", "positions_plain")


def _builders(
    tables: dict[str, DataFrame], params: ExportParams, wanted: Collection[str], as_of: str | None = None
) -> dict[str, Callable[[], DataFrame]]:
    """A function for each result; building one plans nothing of another.

    The parsed shape versions, which three results read, are made by the first
    that asks for them; where that fails, the manifest says nothing of shapes.
    """
    cot = tables["cot_router"]

    @cache
    def decoder():
        return ChannelDecoder(tables["groups"])

    @cache
    def parsed():
        return settle(shapes.parse_shapes(results.shape_versions(cot, params, decoder())))

    @cache
    def fates():
        return shapes.object_fates(parsed(), params.box, params.include_feed_shapes)

    def drawn():
        deletions = results.shape_deletions(tables["mission_change"], params)
        return shapes.ordered_shapes(shapes.shapes_result(parsed(), fates(), deletions))

    def manifest():
        known = None
        if "shapes" in wanted:
            try:
                known = fates()
            except Exception:  # noqa: BLE001 - the shapes result records it
                known = None
        return shapes.manifest_with_shapes(results.manifest(cot, params), known)

    def tracks():
        points = results.matching_positions(cot, params)
        return track_features(points.select("id", "uid", "servertime", "latitude", "longitude"))

    video = lambda: results.video(tables["video_connections"], params, decoder())
    builders = {
        "shapes": drawn,
        "positions": lambda: results.positions(
            cot, params, decoder(), tables["data_feed_cot"], tables["data_feed"], tables["cot_image"]
        ),
        "connections": lambda: results.connections(
            tables["client_endpoint_event"], tables["client_endpoint"], tables["connection_event_type"], params, decoder()
        ),
        "chat": lambda: results.chat(tables["cot_router_chat"], params, decoder()),
        "missions": lambda: results.missions(tables["mission"], params, decoder()),
        "mission_changes": lambda: results.mission_changes(tables["mission_change"], params),
        "mission_subscriptions": lambda: results.mission_subscriptions(tables["mission_subscription"], tables["mission"]),
        "mission_contents": lambda: results.mission_contents(
            tables["mission_uid"], tables["mission_resource"], tables["mission_external_data"],
            tables["resource"], tables["mission"],
        ),
        "files": lambda: results.files(tables["resource"], params, decoder()),
        "attachments": lambda: results.attachments(tables["cot_image"], tables["cot_link"], cot),
        "video": video,
        "data_feeds": lambda: results.data_feeds(tables["data_feed"], tables["data_feed_type_pl"], params, decoder()),
        "federation": lambda: results.federation(tables["fed_event"], tables["fed_event_kind_pl"]),
    }
    builders = {n: (b if n == "shapes" else partial(_ordered, n, b)) for n, b in builders.items() if n in wanted}
    builders["manifest"] = partial(_ordered, "manifest", manifest)
    builders |= {
        "raw_rows": lambda: results.raw_rows(cot, params).orderBy("servertime", "id"),
        "positions_plain": lambda: results.positions_plain(cot, params).orderBy("servertime", "id"),
        "tracks": tracks,
        "quality": lambda: aggregates.quality_summary(cot, params),
        "census": lambda: aggregates.census(tables),
        "log_extent": lambda: aggregates.log_extent(cot),
        "redactions": lambda: aggregates.redaction_count(video() if "video" in wanted else None, cot.sparkSession),
    }
    if as_of is not None:
        builders["extent"] = lambda: aggregates.extent(cot, as_of)
    return builders


def _ordered(name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return results.ordered(name, build())


def plan_extract(
    tables: dict[str, DataFrame], params: ExportParams, included: Collection[str] | None = None
) -> dict[str, DataFrame]:
    """The chosen results as DataFrames to be run; the manifest is always one.

    A result that is not asked for is not planned, let alone run. Only the
    parsing of shape versions, which three results read, is done up front.
    """
    wanted = set(OPTIONAL_RESULTS if included is None else included)
    builders = _builders(tables, params, wanted)
    return {name: build() for name, build in builders.items() if name not in PACKAGE_RESULTS}


def _write_all(builders: dict[str, Callable[[], DataFrame]], path: str) -> tuple[dict[str, int], dict[str, str]]:
    """Rows written and failures, by result; one that fails, while it is planned
    or while it runs, does not stop the rest."""
    counts: dict[str, int] = {}
    failures: dict[str, str] = {}
    for name, build in builders.items():
        target = os.path.join(path, name)
        try:
            # Counted while it is written, not by reading it again.
            written = Observation(f"{name} rows")
            rows = build().observe(written, F.count(F.lit(1)).alias("n"))
            (sinks.write_delimited if name in DELIMITED else sinks.write_guarded_csv)(rows, target)
            counts[name] = written.get["n"]
        except Exception as e:  # noqa: BLE001 - recorded per result
            failures[name] = f"{type(e).__name__}: {e}"
    return counts, failures


def write_package(
    tables: dict[str, DataFrame], params: ExportParams, path: str, included: Collection[str] | None = None,
    as_of: str | None = None,
) -> DataFrame:
    """Everything a package holds, under ``path``: the chosen results and the
    manifest, raw rows and plain positions as delimited lines, tracks, quality,
    census, the log's extent, redactions, with ``as_of`` the map's opening box,
    and in ``hashes`` a checksum list of all of it. One row on the run."""
    wanted = set(OPTIONAL_RESULTS if included is None else included)
    done = _write(tables, params, f"{path}/package", _builders(tables, params, wanted, as_of), included)
    sinks.write_hash_list(tables["cot_router"].sparkSession, f"{path}/package", f"{path}/hashes")
    return done


def write_extract(
    tables: dict[str, DataFrame], params: ExportParams, path: str, included: Collection[str] | None = None
) -> DataFrame:
    """Write each result under ``path``; a result that fails does not stop the rest."""
    wanted = set(OPTIONAL_RESULTS if included is None else included)
    builders = {n: b for n, b in _builders(tables, params, wanted).items() if n not in PACKAGE_RESULTS}
    return _write(tables, params, path, builders, included)


def _write(tables, params: ExportParams, path: str, builders, included: Collection[str] | None) -> DataFrame:
    spark = tables["cot_router"].sparkSession
    counts, failures = _write_all(builders, path)
    left_out = [] if included is None else [n for n in OPTIONAL_RESULTS if n not in included]
    if params.channels is None:
        state, names = "no filter", None
    else:
        try:
            decoder = ChannelDecoder(tables["groups"])
            present = decoder.present(
                results.matching_positions(tables["cot_router"], replace(params, channels=None))
            )
            row = excluded_channels(present, params.channels).first()
            state, names = row.state, row.names
        except Exception:  # noqa: BLE001 - unknown is an answer of its own
            state, names = "unknown", None
    return sinks.run_manifest(spark, counts, failures, left_out, state, names)

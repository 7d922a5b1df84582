"""Tracks: per-device sequences broken where reporting stopped.

A device may hold a large share of all rows, so none of its rows are put in order
to find its segments. Rows that share a cell of time no wider than the gap never
lie in different segments; cells, counted where the rows are, are numbered per
device, and one row for each slice of time brings the numbers back. Fact rows
are exchanged once, by (device, slice).
"""

from __future__ import annotations

import secrets
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posevidence.functions import classify
from posevidence.functions.text import detail_attribute
from posevidence.operators.results import matching_positions
from posevidence.operators.sequences import with_summaries
from posevidence.params import GAP_SECONDS, ExportParams

SLICE_SECONDS = 3600
# The most points one path row carries; a longer segment continues in the next.
PIECE_POINTS = 5000

# Rows without a time are dealt out by id, so many ids to a slice.
UNTIMED_ROWS = 100_000

_NO_TIME = -(2**62)


def time_slice(time: str, seconds: int = SLICE_SECONDS, tie: str | None = None) -> Column:
    """The slice a row falls in. Rows without a time come before all others, in
    one slice or, with ``tie``, in as many as their ids fill."""
    untimed = F.lit(_NO_TIME)
    if tie is not None:
        untimed += _whole(F.col(tie), UNTIMED_ROWS)
    return F.coalesce(_whole(F.unix_micros(F.col(time)), seconds * 1_000_000), untimed)


def _whole(value: Column, width: int) -> Column:
    """floor(value / width) of whole numbers, exactly."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def _sliced(points: DataFrame, gap_seconds: int, device: str, time: str, tie: str, slice_seconds: int) -> DataFrame:
    cell = _whole(F.unix_micros(F.col(time)), max(gap_seconds * 1_000_000, 1))
    return points.withColumns(
        {
            # A device without a name is one device; plain keys keep a partitioning.
            "__key": F.coalesce(F.col(device).cast("string"), F.lit("")),
            "__named": F.col(device).isNotNull(),
            "__slice": time_slice(time, slice_seconds, tie),
            "__cell": F.coalesce(cell, F.lit(0).cast("bigint")),
        }
    )


_SLICE = ["__key", "__named", "__slice"]


def _segments_of_slices(sliced: DataFrame, gap_seconds: int, time: str) -> DataFrame:
    """One row per (device, slice): for each of its cells the segment, which is
    numbered, sized and timed as a whole, and the pieces before the slice's own.

    A device has one cell for each gap of time in which it reported, whatever
    it reported in it.
    """
    gap = F.lit(gap_seconds * 1_000_000)
    cells = sliced.groupBy(*_SLICE, "__cell").agg(
        F.min(time).alias("__first"), F.max(time).alias("__last"), F.count("*").alias("__n")
    )
    device = Window.partitionBy("__key", "__named")
    in_order = device.orderBy("__slice", "__cell")
    silence = F.unix_micros("__first") - F.unix_micros(F.lag("__last").over(in_order))
    cells = cells.withColumn("__break", F.coalesce((silence > gap).cast("int"), F.lit(0)))
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("seg_no", (F.sum("__break").over(so_far) + 1).cast("bigint"))
    segment = Window.partitionBy("__key", "__named", "seg_no")
    here = Window.partitionBy("__key", "__named", "seg_no", "__slice")
    cells = cells.withColumns(
        {
            "points": F.sum("__n").over(segment),
            "begin": F.min("__first").over(segment),
            "end": F.max("__last").over(segment),
            "segments": F.max("seg_no").over(device),
            "__pieces": F.ceil(F.sum("__n").over(here) / F.lit(PIECE_POINTS)),
            "__opens": F.row_number().over(here.orderBy("__cell")) == 1,
        }
    )
    up_to = segment.orderBy("__slice", "__cell").rowsBetween(Window.unboundedPreceding, 0)
    all_pieces = F.sum(F.when(F.col("__opens"), F.col("__pieces")).otherwise(0)).over(up_to)
    cells = cells.withColumn("pieces_before", (all_pieces - F.col("__pieces")).cast("bigint"))
    found = F.struct("seg_no", "segments", "points", "begin", "end", "pieces_before")
    return cells.groupBy(*_SLICE).agg(F.map_from_entries(F.collect_list(F.struct("__cell", found))).alias("__segments"))


def _segmented(
    points: DataFrame, gap_seconds: int, device: str, time: str, tie: str, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    sliced = _sliced(points, gap_seconds, device, time, tie, slice_seconds)
    found = with_summaries(sliced, _segments_of_slices(sliced, gap_seconds, time), _SLICE)
    return found.withColumn("__segment", F.col("__segments")[F.col("__cell")])


def split_segments(
    points: DataFrame,
    gap_seconds: int = GAP_SECONDS,
    device: str = "uid",
    time: str = "servertime",
    tie: str = "id",
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Adds ``seg_no`` (from 1): a new segment begins after a step strictly
    longer than the gap. A missing time neither breaks nor is compared; rows
    without one come first."""
    found = _segmented(points, gap_seconds, device, time, tie, slice_seconds)
    return found.select(*[F.col(f"`{c}`") for c in points.columns], F.col("__segment.seg_no").alias("seg_no"))


def segment_summary(segmented: DataFrame, device: str = "uid", time: str = "servertime") -> DataFrame:
    """One row per segment: number, "i of n", times and size."""
    segments = segmented.groupBy(device, "seg_no").agg(
        F.count("*").alias("points"), F.min(time).alias("begin"), F.max(time).alias("end")
    )
    of = segments.groupBy(device).agg(F.max("seg_no").alias("segments"))
    return segments.join(of, device)


def _drawn_pieces(points: DataFrame, gap_seconds: int, device: str, time: str, tie: str) -> DataFrame:
    """Segments of two or more points, in ordered pieces of bounded size that are
    numbered within their segment. Rows stay where the segments were found."""
    drawn = _segmented(points, gap_seconds, device, time, tie).filter(
        F.col(device).isNotNull() & (F.col("__segment.points") >= 2)
    ).withColumn("__seg_no", F.col("__segment.seg_no"))
    place = F.row_number().over(Window.partitionBy(*_SLICE, "__seg_no").orderBy(time, tie))
    part = F.floor((place - 1) / F.lit(PIECE_POINTS))
    return (
        drawn.withColumn("__part", part)
        .groupBy(*_SLICE, "__seg_no", "__part")
        .agg(
            F.first(device).alias(device),
            F.first("__segment").alias("__segment"),
            F.sort_array(F.collect_list(F.struct(time, tie, "latitude", "longitude"))).alias("path"),
            F.count("*").alias("piece_points"),
        )
        .select(
            device,
            "__segment.*",
            (F.col("__segment.pieces_before") + F.col("__part") + 1).cast("int").alias("piece_no"),
            "piece_points",
            "path",
        )
    )


def path_text(path: Column) -> Column:
    """A line as "lon lat" pairs with six decimals, WKT order."""
    return F.array_join(
        F.transform(
            path,
            lambda p: F.concat(
                F.format_string("%.6f", p["longitude"]), F.lit(" "), F.format_string("%.6f", p["latitude"])
            ),
        ),
        ", ",
    )


def track_features(
    points: DataFrame,
    gap_seconds: int = GAP_SECONDS,
    device: str = "uid",
    time: str = "servertime",
    tie: str = "id",
) -> DataFrame:
    """Drawable track lines: each segment of two or more points, with its path.

    A path is cut into pieces of at most ``PIECE_POINTS`` points; joined in
    ``piece_no`` order they are the whole line.
    """
    several = F.concat(F.lit("Track segment "), F.col("seg_no"), F.lit(" of "), F.col("segments"))
    return _drawn_pieces(points, gap_seconds, device, time, tie).select(
        device,
        "seg_no",
        "segments",
        F.when(F.col("segments") == 1, "Track").otherwise(several).alias("name"),
        "begin",
        "end",
        "points",
        "piece_no",
        "piece_points",
        path_text(F.col("path")).alias("path"),
    )


def trails(
    cot: DataFrame, params: ExportParams, gap_seconds: int = GAP_SECONDS, secret: str | None = None
) -> DataFrame:
    """De-identified motion lines: no device, no channel filter.

    Only devices seen in at least two places anywhere in the window are drawn,
    and only their segments of two or more points. Pieces of a line share an id
    keyed by ``secret``, which the caller keeps to itself, so that it cannot be
    traced back to a device by hashing known device names; without one every
    call makes its own.
    """
    secret = secrets.token_hex(16) if secret is None else secret
    points = matching_positions(cot, replace(params, channels=None)).select(
        "id", "uid", "servertime", "latitude", "longitude"
    )
    # Two distinct places exist exactly when a coordinate's range is not a point.
    moved = (
        points.groupBy("uid")
        .agg(
            F.min("latitude").alias("s"), F.max("latitude").alias("n"),
            F.min("longitude").alias("w"), F.max("longitude").alias("e"),
        )
        .filter((F.col("s") < F.col("n")) | (F.col("w") < F.col("e")))
        .select("uid")
    )
    return _drawn_pieces(points, gap_seconds, "uid", "servertime", "id").join(moved, "uid", "left_semi").select(
        F.sha2(F.concat_ws("|", F.lit(secret), "uid", F.col("seg_no").cast("string")), 256).alias("line_id"),
        "piece_no",
        "points",
        path_text(F.col("path")).alias("path"),
    )


def first_and_last(points: DataFrame) -> DataFrame:
    """Each device's first and last position, and what it is called."""
    ends = points.groupBy("uid").agg(
        F.min(F.struct("servertime", "id", "latitude", "longitude", "callsign", "cot_type")).alias("a"),
        F.max(F.struct("servertime", "id", "latitude", "longitude")).alias("b"),
        F.count("*").alias("positions"),
    )
    return ends.select(
        "uid",
        F.when(F.coalesce("a.callsign", F.lit("")) != "", F.col("a.callsign")).otherwise(F.col("uid")).alias("label"),
        F.col("a.cot_type").alias("cot_type"),
        "positions",
        F.col("a.servertime").alias("first_time"),
        F.col("a.latitude").alias("first_lat"),
        F.col("a.longitude").alias("first_lon"),
        F.col("b.servertime").alias("last_time"),
        F.col("b.latitude").alias("last_lat"),
        F.col("b.longitude").alias("last_lon"),
    )


def devices_by_category(points: DataFrame) -> DataFrame:
    """Devices with their category (of the first report), in listing order."""
    category = classify.track_category(F.col("cot_type"))
    return (
        first_and_last(points)
        .withColumn("category", category)
        .orderBy(classify.category_rank(F.col("category")), "label", "uid")
        .select("category", "label", "uid", "positions")
    )


def category_totals(points: DataFrame) -> DataFrame:
    """Devices and positions per category."""
    return (
        first_and_last(points)
        .groupBy(classify.track_category(F.col("cot_type")).alias("category"))
        .agg(F.count("*").alias("devices"), F.sum("positions").alias("positions"))
    )


def point_features(cot: DataFrame, params: ExportParams) -> DataFrame:
    """One row per position with its readings told apart from their sentinels."""
    found = matching_positions(cot, params).select(
        "*",
        detail_attribute("callsign").alias("callsign"),
        detail_attribute("speed_ms").alias("speed"),
        detail_attribute("course_deg").alias("course"),
    )
    speed, course = F.col("speed"), F.col("course")
    return found.select(
        "id",
        F.when(F.coalesce("callsign", F.lit("")) != "", F.col("callsign"))
        .otherwise(F.coalesce("uid", F.lit("unknown")))
        .alias("label"),
        "servertime",
        "latitude",
        "longitude",
        classify.track_category(F.col("cot_type")).alias("category"),
        classify.fix_class(F.col("how"), F.col("point_ce")).alias("fix_class"),
        classify.speed_status(speed).alias("speed_status"),
        classify.speed_mps(speed).alias("speed_mps"),
        F.round(classify.speed_mph(speed), 1).alias("speed_mph"),
        classify.course_status(course).alias("course_status"),
        classify.course_degrees(course).alias("course_deg"),
        classify.accuracy_metres(F.col("point_ce")).alias("accuracy_m"),
    )


def neighbour_in_slices(
    rows: DataFrame,
    keys: list[str],
    slice_column: str,
    order: list[str],
    values: list[str],
    prefix: str = "prev_",
    ahead: bool = False,
) -> DataFrame:
    """``lag`` (or ``lead``) of ``values`` without a window across all of a key.

    ``slice_column`` must rise with ``order``. Inside a slice the window gives
    the neighbour; a slice's outermost row takes it from the next slice over,
    through a summary with one row per slice. ``prefix`` + "row" tells whether
    there is a neighbour at all.
    """
    packed = F.struct(*[F.col(v) for v in values])
    ordering = F.struct(*[F.col(c) for c in order])
    plain = {f"__key{i}": F.coalesce(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(keys)}
    plain |= {f"__has{i}": F.col(k).isNotNull() for i, k in enumerate(keys)}
    own = [*plain, slice_column]
    keyed = rows.withColumns(plain)
    shift, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    marked = keyed.withColumn("__near", shift(packed).over(Window.partitionBy(*own).orderBy(*order)))
    edges = keyed.groupBy(*own).agg(edge(packed, ordering).alias("__edge"))
    carried = edges.select(*own, shift("__edge").over(Window.partitionBy(*plain).orderBy(slice_column)).alias("__carried"))
    neighbour = F.coalesce("__near", "__carried")
    return with_summaries(marked, carried, own).select(
        *[F.col(f"`{c}`") for c in rows.columns],
        neighbour.isNotNull().alias(f"{prefix}row"),
        *[neighbour[v].alias(f"{prefix}{v}") for v in values],
    )


def stationary_repeats(
    points: DataFrame, device: str = "uid", time: str = "servertime", tie: str = "id"
) -> DataFrame:
    """Flags a report from the same spot as the device's report before it."""
    sliced = points.withColumn("__slice", time_slice(time, tie=tie))
    seen = neighbour_in_slices(sliced, [device], "__slice", [time, tie], ["latitude", "longitude"])
    repeat = (
        F.col("prev_row")
        & F.col("latitude").eqNullSafe(F.col("prev_latitude"))
        & F.col("longitude").eqNullSafe(F.col("prev_longitude"))
    )
    return seen.withColumn("stationary_repeat", repeat).drop(
        "__slice", "prev_row", "prev_latitude", "prev_longitude"
    )

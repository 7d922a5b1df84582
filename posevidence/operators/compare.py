"""Evidence comparison: hashes, row ids, and positions within tolerance.

Positions of two files are compared as *spots*: distinct (device, time, place)
with the number of reports there. Copies of one report are counted, never
paired with each other, so a device that repeats itself without end costs one
spot.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posevidence.functions.geometry import haversine_m
from posevidence.functions.text import clause_safe
from posevidence.materialize import settle
from posevidence.operators.tracks import neighbour_in_slices, time_slice

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The tolerances, and the words of the verdicts.
TIME_TOLERANCE_S = 1
PLACE_TOLERANCE_M = 1.0
RAW_FILE = "-recheck-cot_router-raw.csv"
SCRIPT_FILE = "-queries.sql"

COMPARED_FIELDS = ("servertime", "latitude", "longitude", "uid", "callsign")

# A little over the place tolerance in degrees of latitude. Cells, and stretches
# of time, are ten times wider than the reach, so few rows lie near an edge.
_REACH_DEGREES = 1e-5
_CELL_DEGREES = 1e-4
_STRETCH_US = 10_000_000 * TIME_TOLERANCE_S


# ---------------------------------------------------------------------------
# By row id
# ---------------------------------------------------------------------------

def compare_by_id(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per id of either side: state and the fields that differ."""
    packed = F.struct(*COMPARED_FIELDS)
    both = left.select("id", packed.alias("l")).join(
        right.select("id", packed.alias("r")), "id", "full_outer"
    )
    differing = F.array_compact(
        F.array(*[F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in COMPARED_FIELDS])
    )
    paired = F.col("l").isNotNull() & F.col("r").isNotNull()
    fields = F.when(paired, differing)
    state = (
        F.when(F.col("r").isNull(), "only left")
        .when(F.col("l").isNull(), "only right")
        .when(F.size(fields) == 0, "identical")
        .otherwise("differs")
    )
    return both.select("id", state.alias("state"), fields.alias("fields"), "l", "r")


def field_differences(compared: DataFrame) -> DataFrame:
    """(id, field, left, right) for every field that differs, values as text."""
    side = lambda s: F.create_map(
        *[x for f in COMPARED_FIELDS for x in (F.lit(f), F.col(f"{s}.{f}").cast("string"))]
    )
    return compared.filter(F.col("state") == "differs").select(
        "id", F.explode("fields").alias("field"), side("l").alias("lm"), side("r").alias("rm")
    ).select("id", "field", F.col("lm")[F.col("field")].alias("left"), F.col("rm")[F.col("field")].alias("right"))


def id_summary(compared: DataFrame) -> DataFrame:
    state = F.col("state")
    return compared.agg(
        F.count_if(state == "identical").alias("identical"),
        F.count_if(state == "differs").alias("differ"),
        F.count_if(state == "only left").alias("only_left"),
        F.count_if(state == "only right").alias("only_right"),
    ).withColumn(
        "verdict", F.when((F.col("differ") == 0) & (F.col("only_left") == 0), "match").otherwise("differs")
    )


# ---------------------------------------------------------------------------
# By position within tolerance
# ---------------------------------------------------------------------------

_SPOT = ["device", "servertime", "latitude", "longitude"]


def spots(positions: DataFrame, n: str = "n") -> DataFrame:
    return positions.groupBy(*_SPOT).agg(F.count("*").alias(n))


def labelled(positions: DataFrame) -> DataFrame:
    """``device``: the callsign, or the uid of a report without one."""
    return positions.withColumn("device", F.coalesce("callsign", "uid")).drop("callsign")


def _lon_cells(lat_cell: Column) -> Column:
    """Cells around the globe at a latitude cell; both sides of a join agree on
    it, and counting cells modulo it joins the two sides of the 180th meridian."""
    lat = F.least(F.abs((lat_cell + 0.5) * F.lit(_CELL_DEGREES)), F.lit(89.99))
    return F.greatest(F.floor(F.cos(F.radians(lat)) * F.lit(360 / _CELL_DEGREES)), F.lit(1)).cast("bigint")


def _lon_step(lon: Column, cells: Column) -> Column:
    return F.floor((lon + 180) / F.lit(360.0) * cells).cast("bigint")


def _lon_cell(lon: Column, lat_cell: Column) -> Column:
    cells = _lon_cells(lat_cell)
    return F.pmod(_lon_step(lon, cells), cells)


def _lat_cell(lat: Column) -> Column:
    return F.floor(lat / F.lit(_CELL_DEGREES)).cast("bigint")


def _near_cells() -> Column:
    """The cells within reach of a row's own place: one, or more near an edge."""
    lat, lon = F.col("latitude"), F.col("longitude")
    reach = F.lit(_REACH_DEGREES) / F.cos(F.radians(F.least(F.abs(lat) + _REACH_DEGREES, F.lit(89.99))))
    # Next to a pole a metre may be any number of degrees.
    reach = F.when(F.abs(lat) > 89.98, 180.0).otherwise(reach)

    def row(a: Column) -> Column:
        cells = _lon_cells(a)
        first, last = _lon_step(lon - reach, cells), _lon_step(lon + reach, cells)
        steps = F.sequence(first, F.least(last, first + cells - 1))
        return F.transform(steps, lambda b: F.struct(a.alias("a"), F.pmod(b, cells).alias("b")))

    return F.flatten(F.transform(F.sequence(_lat_cell(lat - _REACH_DEGREES), _lat_cell(lat + _REACH_DEGREES)), row))


def _stretch(micros: Column) -> Column:
    return F.floor(micros / F.lit(_STRETCH_US)).cast("bigint")


def _second(time: str) -> Column:
    return _stretch(F.unix_micros(F.col(time)))


def _near_seconds(time: str) -> Column:
    micros, reach = F.unix_micros(F.col(time)), F.lit(1_000_000 * TIME_TOLERANCE_S)
    return F.sequence(_stretch(micros - reach), _stretch(micros + reach))


# How long a slice of time is in which pairs are settled on their own.
MATCH_SLICE_S = 600

_EDGE = ["device", "l_t", "l_lat", "l_lon", "r_t", "r_lat", "r_lon", "gap", "distance", "digest", "distance_m"]
_EDGE_TYPES = (
    "device string, l_t long, l_lat double, l_lon double, r_t long, r_lat double, r_lon double,"
    " gap long, distance long, digest long, distance_m double"
)


# Pairs that a task works on at a time, and more only where one group has more.
_HELD_PAIRS = 50_000


def _settle_pairs(table: pa.Table) -> pa.Table:
    """Take pairs in order while all that matters is known: the pairs taken,
    with their ``n`` matches, and those that stay open, with -1 and with what is
    left of their ends. Open is a pair that reaches out of its slice, or one with
    an end of a better pair that is open. Slices and devices know nothing of each
    other, so many of them go in one call.
    """
    columns = {c: table[c].to_numpy() for c in table.column_names if c != "device"}
    columns["device"] = pc.index_in(table["device"], pc.unique(table["device"])).to_numpy()
    order = np.lexsort([columns[c] for c in reversed(["gap", "distance", "digest", *_EDGE[1:7]])])
    columns = {c: v[order] for c, v in columns.items()}

    def ends(side):
        names = ["device", "slice", f"{side}_t", f"{side}_lat", f"{side}_lon"]
        spots = np.lexsort([columns[c] for c in names])
        new = reduce(or_, (columns[c][spots][1:] != columns[c][spots][:-1] for c in names))
        number = np.empty(len(spots), np.int64)
        number[spots] = np.cumsum(np.r_[0, new])
        left = np.zeros(number.max(initial=-1) + 1, np.int64)
        left[number] = columns[f"{side}_left"]
        return number.tolist(), left.tolist()

    (l_of, l_left), (r_of, r_left) = ends("l"), ends("r")
    l_open, r_open = [False] * len(l_left), [False] * len(r_left)
    n = [0] * len(l_of)
    for e, (i, j, crosses) in enumerate(zip(l_of, r_of, columns["crossing"].tolist())):
        if not l_left[i] or not r_left[j]:
            continue
        if crosses or l_open[i] or r_open[j]:
            l_open[i] = r_open[j] = True
            n[e] = -1
            continue
        n[e] = taken = min(l_left[i], r_left[j])
        l_left[i] -= taken
        r_left[j] -= taken
    found = table.take(pa.array(order))
    for name, values in (("l_left", [l_left[i] for i in l_of]), ("r_left", [r_left[j] for j in r_of]), ("n", n)):
        values = pa.array(values, pa.int64())
        at = found.schema.get_field_index(name)
        found = found.append_column(name, values) if at < 0 else found.set_column(at, name, values)
    return found.filter(pc.not_equal(found["n"], 0))


def _slice_starts(table: pa.Table) -> list[int]:
    """Where a new slice begins, in rows that come by device and slice."""
    device = pc.index_in(table["device"], pc.unique(table["device"])).to_numpy()
    slices = table["slice"].to_numpy()
    return (np.flatnonzero((device[1:] != device[:-1]) | (slices[1:] != slices[:-1])) + 1).tolist()


def _gap_starts(table: pa.Table) -> list[int]:
    """Where nothing before shares a moment with what follows, by device and
    time; pairs that share no moment share no spot."""
    devices, found, end = table["device"].to_pylist(), [], None
    for k, (start, last) in enumerate(zip(table["start"].to_pylist(), table["end"].to_pylist())):
        if k and (devices[k] != devices[k - 1] or start > end):
            found.append(k)
            end = last
        end = last if end is None else max(end, last)
    return found


def _settled_runs(starts, columns: list[str]):
    """Settle rows in order, many groups at a time, none of them cut apart."""

    def settled(table):
        return _settle_pairs(table).select(columns).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < _HELD_PAIRS:
                continue
            table = pa.Table.from_batches(held)
            found = starts(table)
            if found:
                yield from settled(table.slice(0, found[-1]))
                table = table.slice(found[-1])
            held, rows = table.to_batches(), table.num_rows if found else 0
        if held:
            yield from settled(pa.Table.from_batches(held))

    return run


def _end(side: str) -> list[tuple[str, Column]]:
    return [
        ("t", F.unix_micros(f"{side}.servertime")), ("lat", F.col(f"{side}.latitude")), ("lon", F.col(f"{side}.longitude")),
    ]


def match_positions(left: DataFrame, right: DataFrame, slice_seconds: int = MATCH_SLICE_S) -> tuple[DataFrame, DataFrame]:
    """Matched pairs of spots, and both sides' spots with what is left of them.

    Every report is used once. Equal spots are matched first, by count. What
    remains is matched nearest first, in the order of time gap in steps of 10 ms,
    distance in steps of 1 cm, then a digest of both spots.

    Every (device, slice of time) takes its pairs in that order as far as it can
    know: a pair across the slice's border, and what hangs on it, stays open.
    What is open, a little at each border, is then swept through by device in
    time order, holding only pairs that touch each other. Two passes, whatever
    the data, give the pairs that taking all one by one would give.

    Returns (pairs, remaining): pairs hold ``n`` matches and their distance;
    remaining holds ``side``, the spot, its reports ``n`` and how many of them
    are ``unmatched``.
    """
    merged = settle(
        spots(left, "l_n").join(spots(right, "r_n"), _SPOT, "full_outer").select(
            *_SPOT, F.coalesce("l_n", F.lit(0)).alias("l_n"), F.coalesce("r_n", F.lit(0)).alias("r_n")
        )
    )
    equal = F.least("l_n", "r_n")
    exact = merged.filter(equal > 0).select(
        "device", equal.alias("n"), F.lit(0.0).alias("gap_s"), F.lit(0.0).alias("distance_m")
    )
    spot = F.struct(*_SPOT)
    left_open = merged.filter(F.col("l_n") > equal).select(
        *_SPOT, spot.alias("l"), (F.col("l_n") - equal).alias("l_left")
    )
    right_open = merged.filter(F.col("r_n") > equal).select(
        *_SPOT, spot.alias("r"), (F.col("r_n") - equal).alias("r_left")
    )

    reach = left_open.withColumn("s", F.explode(_near_seconds("servertime"))).withColumn(
        "c", F.explode(_near_cells())
    )
    reach = reach.select("device", "s", F.col("c.a").alias("a"), F.col("c.b").alias("b"), "l", "l_left")
    placed = right_open.select(
        "device", _second("servertime").alias("s"), _lat_cell(F.col("latitude")).alias("a"),
        _lon_cell(F.col("longitude"), _lat_cell(F.col("latitude"))).alias("b"), "r", "r_left",
    )
    gap_us = F.abs(F.unix_micros("l.servertime") - F.unix_micros("r.servertime"))
    distance = haversine_m(
        F.col("l.latitude"), F.col("l.longitude"), F.col("r.latitude"), F.col("r.longitude")
    )
    pairs = (
        reach.join(placed, ["device", "s", "a", "b"])
        .select("device", "l", "r", "l_left", "r_left", gap_us.alias("gap_us"), distance.alias("distance_m"))
        .filter((F.col("gap_us") <= TIME_TOLERANCE_S * 1_000_000) & (F.col("distance_m") <= PLACE_TOLERANCE_M))
        .select(
            "device",
            *[v.alias(f"{side}_{c}") for side in ("l", "r") for c, v in _end(side)],
            F.floor(F.col("gap_us") / 10_000).alias("gap"),
            F.floor(F.col("distance_m") * 100).alias("distance"),
            F.xxhash64("l", "r").alias("digest"),
            "distance_m",
            "l_left",
            "r_left",
        )
    )
    slices = [F.floor(F.col(f"{side}_t") / F.lit(slice_seconds * 1_000_000)) for side in ("l", "r")]
    first_pass = settle(
        pairs.withColumn("crossing", slices[0] != slices[1])
        .withColumn("slice", F.explode(F.array_distinct(F.array(*slices))))
        .repartition("device", "slice")
        .sortWithinPartitions("device", "slice")
        .mapInArrow(
            _settled_runs(_slice_starts, [*_EDGE, "l_left", "r_left", "n", "crossing"]),
            f"{_EDGE_TYPES}, l_left long, r_left long, n long, crossing boolean",
        )
    )
    # A pair across a border is open only if both slices say so.
    open_pairs = (
        first_pass.filter(F.col("n") < 0)
        .groupBy(*_EDGE)
        .agg(
            F.min("l_left").alias("l_left"), F.min("r_left").alias("r_left"),
            F.count("*").alias("seen"), F.first("crossing").alias("crossing"),
        )
        .filter((F.col("seen") == 2) | ~F.col("crossing"))
        .select(
            *_EDGE, "l_left", "r_left", F.lit(False).alias("crossing"), F.lit(0).alias("slice"),
            F.least("l_t", "r_t").alias("start"), F.greatest("l_t", "r_t").alias("end"),
        )
    )
    second_pass = settle(
        open_pairs.repartition("device")
        .sortWithinPartitions("device", "start")
        .mapInArrow(_settled_runs(_gap_starts, [*_EDGE, "n"]), f"{_EDGE_TYPES}, n long")
    )
    near = first_pass.filter(F.col("n") > 0).select(*_EDGE, "n").unionByName(second_pass)
    near = near.select(
        "device", "n", F.abs(F.col("l_t") - F.col("r_t")).alias("gap_us"), "distance_m",
        *[
            F.struct(
                "device", F.timestamp_micros(f"{side}_t").alias("servertime"),
                F.col(f"{side}_lat").alias("latitude"), F.col(f"{side}_lon").alias("longitude"),
            ).alias(side)
            for side in ("l", "r")
        ],
    )
    used = near.select(F.lit("left").alias("side"), F.col("l").alias("spot"), "n").unionByName(
        near.select(F.lit("right").alias("side"), F.col("r").alias("spot"), "n")
    ).groupBy("side", "spot").agg(F.sum("n").alias("used"))
    sides = merged.select(
        F.explode(
            F.array(
                F.struct(F.lit("left").alias("side"), F.col("l_n").alias("n")),
                F.struct(F.lit("right").alias("side"), F.col("r_n").alias("n")),
            )
        ).alias("x"),
        spot.alias("spot"),
        equal.alias("equal"),
    ).select("x.side", "spot", "x.n", "equal").filter(F.col("n") > 0)
    remaining = sides.join(used, ["side", "spot"], "left").select(
        "side", "spot.*", "n", (F.col("n") - F.col("equal") - F.coalesce("used", F.lit(0))).alias("unmatched")
    )
    all_pairs = exact.unionByName(
        near.select("device", "n", (F.col("gap_us") / F.lit(1e6)).alias("gap_s"), "distance_m")
    )
    return all_pairs, remaining


def compare_positions(pairs: DataFrame, remaining: DataFrame) -> DataFrame:
    """Per device: reports on each side, matched, only on one side, and the
    largest distance between matched reports."""
    left, right = F.col("side") == "left", F.col("side") == "right"
    counts = remaining.groupBy("device").agg(
        F.coalesce(F.sum(F.when(left, F.col("n"))), F.lit(0)).alias("left_count"),
        F.coalesce(F.sum(F.when(right, F.col("n"))), F.lit(0)).alias("right_count"),
        F.coalesce(F.sum(F.when(left, F.col("unmatched"))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.when(right, F.col("unmatched"))), F.lit(0)).alias("only_right"),
    )
    matched = pairs.groupBy("device").agg(
        F.sum("n").alias("matched"), F.max("distance_m").alias("max_distance_m")
    )
    return counts.join(matched, "device", "left").withColumn(
        "matched", F.coalesce("matched", F.lit(0))
    )


def coverage_note(table: DataFrame) -> DataFrame:
    """What the reports only on the right mean, per device.

    Alone they are coverage: the other file reaches further. Beside unmatched
    reports on the left they are the same report at another time or place.
    """
    left, right = F.col("only_left") > 0, F.col("only_right") > 0
    return table.select(
        "device",
        "only_left",
        "only_right",
        F.when(left & right, "same device, different time or place")
        .when(left, "missing from the other file")
        .when(right, "coverage")
        .otherwise("complete")
        .alias("note"),
    )


def explain_unmatched(
    left: DataFrame, right: DataFrame, remaining: DataFrame, channel: str | None = None
) -> DataFrame:
    """Unmatched left reports, each counted under the first reason that fits:
    (device, servertime, latitude, longitude, reason, n).

    The reasons in order: a repeat of the device's previous spot; outside the
    other file's time range; the same place at another time; the same time some
    metres away; on a channel no matched report uses; a device under another
    name; unexplained.
    """
    left_spots = remaining.filter(F.col("side") == "left")
    right_spots = remaining.filter(F.col("side") == "right")
    sliced = left_spots.withColumn("__slice", time_slice("servertime"))
    seen = neighbour_in_slices(
        sliced, ["device"], "__slice", ["servertime", "latitude", "longitude"], ["latitude", "longitude"]
    )
    again = (
        F.col("prev_row")
        & F.col("latitude").eqNullSafe(F.col("prev_latitude"))
        & F.col("longitude").eqNullSafe(F.col("prev_longitude"))
    )
    # Of several reports at one spot all but the first repeat it.
    repeats = F.when(again, F.col("unmatched")).otherwise(F.least("unmatched", F.col("n") - 1))
    open_spots = seen.filter(F.col("unmatched") > 0).select(
        *_SPOT, repeats.alias("repeats"), (F.col("unmatched") - repeats).alias("others")
    )

    # One row: the other file's range. A scalar, not a join partner per row.
    span = right_spots.agg(F.min("servertime").alias("lo"), F.max("servertime").alias("hi")).first()
    outside = (
        F.lit(True)
        if span is None or span.lo is None
        else (F.col("servertime") < F.lit(span.lo)) | (F.col("servertime") > F.lit(span.hi))
    )
    others = open_spots.filter(F.col("others") > 0).withColumn("outside", outside)

    placed = right_spots.select(
        F.col("device").alias("r_device"), F.col("latitude").alias("r_lat"), F.col("longitude").alias("r_lon"),
        _lat_cell(F.col("latitude")).alias("a"),
        _lon_cell(F.col("longitude"), _lat_cell(F.col("latitude"))).alias("b"),
    ).distinct()
    reach = others.withColumn("c", F.explode(_near_cells()))
    same_place = (
        reach.join(
            placed,
            (F.col("device") == F.col("r_device")) & (F.col("c.a") == F.col("a")) & (F.col("c.b") == F.col("b"))
            & (haversine_m(F.col("latitude"), F.col("longitude"), F.col("r_lat"), F.col("r_lon")) <= PLACE_TOLERANCE_M),
            "left_semi",
        )
        .select(*_SPOT)
        .distinct()
        .withColumn("same_place", F.lit(True))
    )
    timed = right_spots.select(
        F.col("device").alias("r_device"), F.col("servertime").alias("r_time"), _second("servertime").alias("s")
    ).distinct()
    in_reach = others.withColumn("q", F.explode(_near_seconds("servertime")))
    gap = F.abs(F.unix_micros("servertime") - F.unix_micros("r_time"))
    same_time = (
        in_reach.join(
            timed,
            (F.col("device") == F.col("r_device")) & (F.col("q") == F.col("s")) & (gap <= TIME_TOLERANCE_S * 1_000_000),
            "left_semi",
        )
        .select(*_SPOT)
        .distinct()
        .withColumn("same_time", F.lit(True))
    )
    judged = others.join(same_place, _SPOT, "left").join(same_time, _SPOT, "left")

    if channel is not None:
        judged = judged.join(_unused_channel(left, remaining, channel), _SPOT, "left")
    else:
        judged = judged.withColumn("unused_channel", F.lit(None).cast("boolean"))
    judged = judged.join(renamed_devices(left_spots, right_spots), "device", "left")

    reason = (
        F.when(F.col("outside"), "outside the time range of the other file")
        .when(F.col("same_place"), "same place at another time")
        .when(F.col("same_time"), "same time, some metres away")
        .when(F.col("unused_channel"), "on a channel no matched report uses")
        .when(F.col("other_name").isNotNull(), F.concat(F.lit("device is called "), "other_name", F.lit(" in the other file")))
        .otherwise("unexplained")
    )
    explained = judged.select(*_SPOT, reason.alias("reason"), F.col("others").alias("n"))
    repeated = open_spots.filter(F.col("repeats") > 0).select(
        *_SPOT, F.lit("repeats the device's previous report").alias("reason"), F.col("repeats").alias("n")
    )
    return explained.unionByName(repeated)


def _unused_channel(left: DataFrame, remaining: DataFrame, channel: str) -> DataFrame:
    """Left spots none of whose channels carries a matched report."""
    spot_channels = left.select(*_SPOT, F.col(channel).alias("ch")).distinct()
    matched = remaining.filter((F.col("side") == "left") & (F.col("unmatched") < F.col("n"))).select(*_SPOT)
    used = spot_channels.join(matched, _SPOT, "left_semi").select("ch").distinct().withColumn("used", F.lit(True))
    return (
        spot_channels.join(used, "ch", "left")
        .groupBy(*_SPOT)
        .agg(F.max(F.coalesce("used", F.lit(False))).alias("any_used"))
        .select(*_SPOT, (~F.col("any_used")).alias("unused_channel"))
    )


def renamed_devices(left_spots: DataFrame, right_spots: DataFrame) -> DataFrame:
    """(device, other_name): a device none of whose reports matched, while
    every one of its spots is, at the same instant and place, a spot of one
    device on the other side. Ties go to the first name."""
    whole = left_spots.groupBy("device").agg(
        F.count("*").alias("spots"), F.sum(F.col("n") - F.col("unmatched")).alias("matched")
    ).filter(F.col("matched") == 0)
    lost = left_spots.join(whole.select("device"), "device", "left_semi")
    there = right_spots.select(
        "servertime", "latitude", "longitude", F.col("device").alias("other_name")
    )
    found = (
        lost.join(there, ["servertime", "latitude", "longitude"])
        .groupBy("device", "other_name")
        .agg(F.count("*").alias("found"))
    )
    return (
        found.join(whole, "device")
        .filter((F.col("found") == F.col("spots")) & (F.col("other_name") != F.col("device")))
        .groupBy("device")
        .agg(F.min("other_name").alias("other_name"))
    )


# ---------------------------------------------------------------------------
# Hash lists
# ---------------------------------------------------------------------------

def recheck_verdict(scripts: DataFrame, sums: DataFrame) -> DataFrame:
    """What the server's hash list says about each package's script and raw file.

    ``sums`` holds (package_sha256, line_no, name, sha256); of equal names the
    later line counts. Only these two files are compared; the rest is recorded.
    """
    last_line = sums.groupBy("package_sha256", "name").agg(F.max_by("sha256", "line_no").alias("sha256"))
    # Two lines matter per package; a list of any length is reduced map-side.
    prefixed = last_line.join(
        scripts.select("package_sha256", "case_prefix"), "package_sha256"
    )
    line = lambda suffix: F.max(
        F.when(F.col("name") == F.concat("case_prefix", F.lit(suffix)), F.col("sha256"))
    )
    lists = prefixed.groupBy("package_sha256").agg(
        F.count("*").alias("files"), line(RAW_FILE).alias("raw_line"), line(SCRIPT_FILE).alias("script_line")
    )
    raw, script, recorded = F.col("raw_line"), F.col("script_line"), F.nullif(F.col("raw_sha256"), F.lit(""))
    raw_verdict = (
        F.when(raw.isNull(), "MISSING - no line for the raw file")
        .when(recorded.isNull(), "unknown - the package recorded no raw-file hash")
        .when(raw == recorded, "yes")
        .otherwise("NO - the hashes differ")
    )
    outcome = (
        F.when(raw.isNull(), "raw file missing")
        .when(recorded.isNull(), "raw unverified")
        .when(raw == recorded, "raw match")
        .otherwise("raw MISMATCH")
    )
    script_verdict = (
        F.when(script.isNull(), "MISSING")
        .when(script == F.sha2("queries_sql", 256), "yes")
        .otherwise("NO - a different script was run")
    )
    return scripts.join(lists, "package_sha256").select(
        "package_sha256",
        raw_verdict.alias("raw_verdict"),
        outcome.alias("outcome"),
        script_verdict.alias("script_verdict"),
        (raw.isNotNull().cast("int") + script.isNotNull().cast("int")).alias("compared"),
        "files",
    )


def package_integrity(members: DataFrame, listed: DataFrame) -> DataFrame:
    """Every member's own hash against its package's list: a row per file.

    ``members`` holds (package, name, sha256) computed from contents, ``listed``
    the same from the list.
    """
    both = members.select("package", "name", F.col("sha256").alias("actual")).join(
        listed.select("package", "name", F.col("sha256").alias("recorded")), ["package", "name"], "full_outer"
    )
    state = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("recorded").isNull(), "not listed")
        .when(F.col("actual") == F.col("recorded"), "match")
        .otherwise("differs")
    )
    return both.select("package", "name", state.alias("state"))


def integrity_summary(checked: DataFrame) -> DataFrame:
    state = F.col("state")
    return checked.groupBy("package").agg(
        F.count("*").alias("files"),
        F.count_if(state == "match").alias("matched"),
        F.count_if(state == "differs").alias("differ"),
        F.count_if(state == "missing").alias("missing"),
        F.count_if(state == "not listed").alias("not_listed"),
    )


def package_verdict(
    packages: DataFrame, log: DataFrame, integrity: DataFrame, windows: DataFrame, rechecks: DataFrame
) -> DataFrame:
    """One row per package: in the log? files intact? inside its window?
    re-checked? A package without a re-check is complete, not deficient.

    ``packages`` holds (package_sha256); ``integrity`` (package_sha256, files,
    matched); ``windows`` (package_sha256, contained); ``rechecks``
    (package_sha256, outcome).
    """
    logged = log.select("package_sha256").distinct().withColumn("__logged", F.lit(True))
    inside = windows.groupBy("package_sha256").agg(F.max("contained").alias("__inside"))
    files = integrity.select("package_sha256", "files", "matched")
    checks = rechecks.select("package_sha256", F.col("outcome").alias("__recheck"))
    joined = packages.select("package_sha256").distinct()
    for side in (logged, files, inside, checks):
        joined = joined.join(side, "package_sha256", "left")
    return joined.select(
        "package_sha256",
        F.coalesce("__logged", F.lit(False)).alias("in_log"),
        F.when(F.col("files").isNull(), "no list")
        .when(F.col("files") == F.col("matched"), "all match")
        .otherwise("differ")
        .alias("file_state"),
        F.when(F.col("__inside").isNull(), "cannot tell")
        .when(F.col("__inside"), "inside")
        .otherwise("outside")
        .alias("window_state"),
        F.coalesce("__recheck", F.lit("no re-check recorded")).alias("recheck_state"),
    )


# ---------------------------------------------------------------------------
# Companions
# ---------------------------------------------------------------------------

def companion_detail(filename: Column, package_sha256: Column, matched: Column, total: Column) -> Column:
    """The detail text of a companion row: how much of a package it matched."""
    package = F.coalesce(F.nullif(package_sha256, F.lit("")), F.lit("(package hash unavailable)"))
    return F.concat(
        F.lit("companion "), clause_safe(filename), F.lit(" for package "), package, F.lit("; "),
        matched.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" package positions matched it"),
    )


def companion_record(table: DataFrame, filename: str, package_sha256: str) -> DataFrame:
    """The companion row of one comparison, from its per-device table."""
    sums = table.agg(F.sum("matched").alias("matched"), F.sum("left_count").alias("total"))
    return sums.select(
        F.lit("companion").alias("export_kind"),
        F.lit("recorded").alias("outcome"),
        F.col("matched").alias("record_count"),
        companion_detail(F.lit(filename), F.lit(package_sha256), F.col("matched"), F.col("total")).alias("detail"),
    )


def read_companions(log: DataFrame) -> DataFrame:
    """Companion rows read back: file, package, and matched of total."""
    counts = r"; (\d+) of (\d+) package positions matched it"
    return log.filter(F.col("export_kind") == "companion").select(
        "id",
        F.regexp_extract("detail", r"^companion (.*) for package ", 1).alias("companion"),
        F.regexp_extract("detail", r" for package ([0-9a-f]{64});", 1).alias("for_package"),
        F.regexp_extract("detail", counts, 1).try_cast("bigint").alias("matched"),
        F.regexp_extract("detail", counts, 2).try_cast("bigint").alias("total"),
    )


# ---------------------------------------------------------------------------
# Content hash of a result
# ---------------------------------------------------------------------------

_LINES_PER_BLOCK = 10_000


def delimited_line(df: DataFrame) -> Column:
    """One row as a psql-style CSV line: quoted only where it must be."""
    def field(name: str) -> Column:
        text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        needs = text.rlike('[,"\n\r]') | (text == "\\.")
        return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *[field(c) for c in df.columns])


def block_hashes(rows: DataFrame, time: str, tie: str) -> DataFrame:
    """(minute, block, lines, sha256): ordered content hashes of a result in
    blocks of bounded size, equal for equal rows however they are stored.

    ``time`` may be text; ``tie`` must make the order total.
    """
    instant = F.col(time).cast("timestamp")
    minute = F.coalesce(F.floor(F.unix_seconds(instant) / F.lit(60)), F.lit(-1))
    lined = rows.select(
        minute.alias("minute"), instant.alias("t"), F.col(tie).cast("bigint").alias("i"),
        F.sha2(delimited_line(rows), 256).alias("line"),
    )
    place = F.row_number().over(Window.partitionBy("minute").orderBy("t", "i"))
    blocked = lined.withColumn("block", F.floor((place - 1) / F.lit(_LINES_PER_BLOCK)))
    ordered_lines = F.array_sort(F.collect_list(F.struct("t", "i", "line")))
    return blocked.groupBy("minute", "block").agg(
        F.count("*").alias("lines"),
        F.sha2(F.array_join(F.transform(ordered_lines, lambda x: x["line"]), ""), 256).alias("sha256"),
    )


def table_hash(rows: DataFrame, time: str, tie: str) -> DataFrame:
    """One hash for a whole result, through blocks, minutes, hours and days, so
    that no step joins more than a bounded number of hashes."""
    joined = lambda key: F.sha2(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "sha256"))), lambda x: x["sha256"]), ""), 256
    ).alias("sha256")
    lines = F.sum("lines").alias("lines")
    minutes = block_hashes(rows, time, tie).groupBy("minute").agg(lines, joined("block"))
    hours = minutes.groupBy(F.floor(F.col("minute") / 60).alias("hour")).agg(lines, joined("minute"))
    days = hours.groupBy(F.floor(F.col("hour") / 24).alias("day")).agg(lines, joined("hour"))
    return days.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), joined("day"))

"""Counts, quality, extents and censuses over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posevidence.functions.classify import percent_of
from posevidence.functions.predicates import (
    CATEGORY_PATTERNS,
    MAP_OBJECT_PATTERNS,
    like_any,
    real_position,
)
from posevidence.functions.text import count_marks, detail_attribute
from posevidence.operators.results import matching_positions
from posevidence.params import UNKNOWN_NUMERIC, ExportParams
from posevidence.sources.tables import CENSUS_TABLES

# Fixed values of the map extent.
EXTENT_MAX_SPAN_DEGREES = 2.0
EXTENT_FALLBACK_HALF_SPAN = 0.15


def record_count(cot: DataFrame, params: ExportParams) -> DataFrame:
    """Matching rows and distinct devices, in all and per kind.

    Devices are counted by first reducing to one row per device with a flag per
    kind; several distinct counts in one aggregate would copy every row once
    per count.
    """
    kinds = {
        "personnel": (CATEGORY_PATTERNS[0][1],),
        "equipment": (CATEGORY_PATTERNS[1][1],),
        "infrastructure": (CATEGORY_PATTERNS[2][1],),
        "map_objects": MAP_OBJECT_PATTERNS,
    }
    per_uid = (
        matching_positions(cot, params)
        .groupBy("uid")
        .agg(
            F.count("*").alias("n"),
            *[
                F.max(F.coalesce(like_any(F.col("cot_type"), p), F.lit(False))).alias(k)
                for k, p in kinds.items()
            ],
        )
    )
    named = F.col("uid").isNotNull()
    return per_uid.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.count_if(named).alias("uids"),
        *[F.count_if(named & F.col(k)).alias(k) for k in kinds],
    )


def quality_checks() -> dict[str, Column]:
    detail = F.col("detail")
    speed, course = detail_attribute("speed_ms"), detail_attribute("course_deg")
    without = lambda tag: ~detail.like(f"%<{tag}%")
    # The check labels and the sentinels they look for.
    return {
        "speed unavailable (-1.0)": speed.isin("-1.0", "-1"),
        "speed measured as stationary (0.0)": speed == "0.0",
        "course unavailable": course.isin("9999999.0", "-1.0", "-1"),
        "no track element sent": without("track"),
        "horizontal accuracy unknown": F.col("point_ce") >= UNKNOWN_NUMERIC,
        "vertical accuracy unknown": F.col("point_le") >= UNKNOWN_NUMERIC,
        "altitude unknown": F.col("point_hae") >= UNKNOWN_NUMERIC,
        "no callsign sent": without("contact"),
        "no battery status sent": without("status"),
        "no device/version info sent": without("takv"),
        "no precision-location element": without("precisionlocation"),
    }


def quality_summary(cot: DataFrame, params: ExportParams) -> DataFrame:
    """One pass over the matching rows: (check, n, total, percent) per check."""
    checks = quality_checks()
    counts = matching_positions(cot, params).agg(
        F.count("*").alias("total"),
        *[F.count_if(test).alias(f"c{i}") for i, test in enumerate(checks.values())],
    )
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("check"), F.col(f"c{i}").alias("n"))
            for i, label in enumerate(checks)
        ]
    )
    return counts.select("total", F.explode(rows).alias("r")).select(
        "r.check", "r.n", "total", percent_of(F.col("r.n"), F.col("total")).alias("percent")
    )


# ---------------------------------------------------------------------------
# Exact percentiles without gathering a column in one task
# ---------------------------------------------------------------------------

# A sketch's ranks are right to within one in so many rows; brackets reach over
# twice that. What a bracket holds is put in order in so many cells.
SKETCH_ACCURACY = 10_000
BRACKET_CELLS = 4096


def _sketch(value: Column, fractions: tuple[float, ...]) -> Column:
    """How many values, and for every fraction two of them that bracket it."""
    reach = 2 / SKETCH_ACCURACY
    asked = [min(max(p + d, 0.0), 1.0) for p in fractions for d in (-reach, reach)]
    return F.struct(
        F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.percentile_approx(value, asked, SKETCH_ACCURACY).alias("brackets"),
    )


def _targets(series: str, sketch, fractions: tuple[float, ...]) -> list[tuple]:
    """(series, p, position, lo, hi): where each fraction lies among n values,
    and values that hold it between them."""
    found = []
    for k, p in enumerate(fractions):
        position = (sketch["n"] - 1) * p
        # At the ends a sketch has no room to err into.
        near = (sketch["n"] + 1) * 2 / SKETCH_ACCURACY + 2
        lo = sketch["least"] if position <= near else sketch["brackets"][2 * k]
        hi = sketch["most"] if position >= sketch["n"] - 1 - near else sketch["brackets"][2 * k + 1]
        found.append((series, float(p), float(position), float(lo), float(hi)))
    return found


def _selected(values: DataFrame, targets: list[tuple]) -> DataFrame:
    """(series, p, value): one scan of (series, v) that counts what lies below a
    bracket and keeps, as counted values, what lies inside.

    Inside values are counted in cells of their bracket, so neither a tie nor a
    wide bracket gathers in one task. ``targets`` are a few rows of literals.
    """
    def of(target):
        series, p, position, lo, hi = target
        v, wide = F.col("v"), hi - lo
        cell = F.floor((v - lo) / F.lit(wide if wide > 0 else 1.0) * (BRACKET_CELLS - 1)).cast("int")
        return F.when(
            (F.col("series") == series) & (v <= hi),
            F.struct(
                F.lit(series).alias("series"), F.lit(p).alias("p"), F.lit(position).alias("position"),
                F.when(v < lo, F.lit(-1)).otherwise(cell).alias("cell"), F.when(v >= lo, v).alias("v"),
            ),
        )

    goal = ["series", "p", "position"]
    counted = (
        values.filter(F.col("v").isNotNull())
        .select(F.explode(F.array_compact(F.array(*[of(t) for t in targets]))).alias("x"))
        .groupBy(*[F.col(f"x.{c}").alias(c) for c in (*goal, "cell", "v")])
        .agg(F.count("*").alias("n"))
    )
    by_cell = Window.partitionBy(*goal).orderBy("cell")
    cells = counted.groupBy(*goal, "cell").agg(F.sum("n").alias("in_cell"))
    cells = cells.withColumn("before", F.sum("in_cell").over(by_cell) - F.col("in_cell"))
    wanted = (
        cells.withColumn("rank", F.explode(F.array(F.floor("position"), F.ceil("position"))))
        .filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("in_cell")))
        .select(*goal, "cell", "before", "rank")
        .distinct()
    )
    in_cell = Window.partitionBy(*goal, "cell", "rank").orderBy("v")
    found = (
        counted.join(wanted, [*goal, "cell"])
        .withColumn("upto", F.col("before") + F.sum("n").over(in_cell))
        .filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    )
    weight = F.col("position") - F.floor("position")
    ends = found.groupBy(*goal).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return ends.select("series", "p", (F.col("lo") + (F.col("hi") - F.col("lo")) * weight).alias("value"))


def exact_percentiles(values: DataFrame, fractions: tuple[float, ...]) -> DataFrame:
    """Interpolated percentiles of ``v`` per ``series``: (series, p, value).

    For a few series of any length. A quantile sketch, the one job that runs
    while the plan is made, brackets every wanted rank; the plan then scans once
    more and is exact.
    """
    sketches = values.groupBy("series").agg(_sketch(F.col("v"), fractions).alias("s")).collect()
    targets = [t for r in sketches if r["s"]["n"] for t in _targets(r["series"], r["s"], fractions)]
    if not targets:
        return values.select("series", F.lit(0.0).alias("p"), F.col("v").alias("value")).limit(0)
    return _selected(values, targets)


def extent(cot: DataFrame, as_of: str) -> DataFrame:
    """The map's opening box: 10th to 90th percentile of recent positions.

    The first of 7 days, 90 days and all data that holds any position decides;
    without any position there is no row. A box wider than two degrees falls
    back to a small one around the median.
    """
    now = F.lit(as_of).cast("timestamp")
    windows = (
        ("7 days", F.col("servertime") > now - F.expr("INTERVAL '7' DAY")),
        ("90 days", F.col("servertime") > now - F.expr("INTERVAL '90' DAY")),
        ("all data", F.lit(True)),
    )
    fractions = (0.1, 0.5, 0.9)
    axes = {"lat": "latitude", "lon": "longitude"}
    points = cot.filter(real_position())
    # One scan sketches all three windows; the first with a position decides.
    sketches = points.agg(
        *[
            _sketch(F.when(test, F.col(column)), fractions).alias(f"{series}{k}")
            for k, (_, test) in enumerate(windows)
            for series, column in axes.items()
        ]
    ).first()
    deciding = next((k for k in range(len(windows)) if sketches[f"lat{k}"]["n"]), None)
    if deciding is None:
        return cot.sparkSession.createDataFrame([], "south double, north double, west double, east double, basis string")
    basis, test = windows[deciding]
    series = F.array(*[F.struct(F.lit(s).alias("series"), F.col(c).alias("v")) for s, c in axes.items()])
    values = points.filter(test).select(F.explode(series).alias("x")).select("x.series", "x.v")
    targets = [t for s in axes for t in _targets(s, sketches[f"{s}{deciding}"], fractions)]
    quantiles = _selected(values, targets)
    pick = lambda s, p: F.max(
        F.when((F.col("series") == s) & (F.col("p") == p), F.col("value"))
    )
    box = quantiles.agg(
        pick("lat", 0.1).alias("south"),
        pick("lat", 0.9).alias("north"),
        pick("lon", 0.1).alias("west"),
        pick("lon", 0.9).alias("east"),
        pick("lat", 0.5).alias("median_lat"),
        pick("lon", 0.5).alias("median_lon"),
    ).filter(F.col("south").isNotNull())
    wide = (F.col("north") - F.col("south") > EXTENT_MAX_SPAN_DEGREES) | (
        F.col("east") - F.col("west") > EXTENT_MAX_SPAN_DEGREES
    )
    half = F.lit(EXTENT_FALLBACK_HALF_SPAN)
    either = lambda name, fallback: F.when(wide, fallback).otherwise(F.col(name)).alias(name)
    narrowed = basis + ", further narrowed - matching data was too spread out to fit"
    return box.select(
        either("south", F.col("median_lat") - half),
        either("north", F.col("median_lat") + half),
        either("west", F.col("median_lon") - half),
        either("east", F.col("median_lon") + half),
        F.when(wide, narrowed).otherwise(basis).alias("basis"),
    )


def census(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows in each table, so that an empty result can be told from an
    unexamined one. A table that is not there counts as NULL."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for table, label in CENSUS_TABLES.items():
        if table in tables:
            counts.append(
                tables[table].agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
            )
        else:
            counts.append(
                spark.range(1).select(F.lit(label).alias("label"), F.lit(None).cast("bigint").alias("n"))
            )
    return reduce(DataFrame.unionByName, counts).select(
        "label",
        "n",
        F.when(F.col("n").isNull(), "unavailable").otherwise("counted").alias("state"),
    )


def log_extent(cot: DataFrame) -> DataFrame:
    return cot.agg(
        F.count("*").alias("total"),
        F.min("servertime").alias("oldest"),
        F.max("servertime").alias("newest"),
    )


def mask_widths(cot: DataFrame) -> DataFrame:
    """The distinct widths of the channel mask, four at most."""
    return (
        cot.filter(F.col("groups").isNotNull())
        .select(F.length("groups").alias("mask_bits"))
        .distinct()
        .orderBy("mask_bits")
        .limit(4)
    )


def redaction_count(video_result: DataFrame | None, spark=None) -> DataFrame:
    """Redactions made in the video result; NULL, not 0, when it was not produced."""
    if video_result is None:
        return spark.range(1).select(F.lit(None).cast("bigint").alias("redactions"))
    return video_result.agg(
        F.coalesce(F.sum(count_marks(F.col("url")) + count_marks(F.col("raw_xml"))), F.lit(0)).alias(
            "redactions"
        )
    )


def geometry_sanity(table: DataFrame) -> DataFrame:
    """Positions outside degrees, over the whole table, with a verdict."""
    lat, lon = F.col("latitude"), F.col("longitude")
    present = lat.isNotNull() & lon.isNotNull()
    bad = present & ~(lat.between(-90, 90) & lon.between(-180, 180))
    counts = table.agg(
        F.count_if(present).alias("with_position"), F.count_if(bad).alias("out_of_range")
    )
    return counts.withColumn(
        "status",
        F.when(F.col("with_position") == 0, "skip").when(F.col("out_of_range") > 0, "fail").otherwise("ok"),
    )

"""Planar and spherical expressions over points, chains and rings.

Points are structs (lat, lon); chains and rings are arrays of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from posevidence.params import EARTH_RADIUS_M, Box

# Fixed value: an orientation closer to zero than this counts as collinear.
COLLINEAR = 1e-15


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` mentions
    it; written out at every mention, a plan grows by that factor at each level."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def point(lat: Column, lon: Column) -> Column:
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def box_struct(box: Box, name: str = "") -> Column:
    """A request's box as a value expressions can read."""
    return F.struct(
        F.lit(name).alias("name"),
        *[F.lit(float(getattr(box, side))).alias(side) for side in ("north", "south", "east", "west")],
    )


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = (F.radians(lat2) - F.radians(lat1)) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(half_dlon), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _orientation(p: Column, q: Column, r: Column) -> Column:
    """0 collinear, 1 clockwise, -1 counter-clockwise."""
    cross = (q["lon"] - p["lon"]) * (r["lat"] - q["lat"]) - (q["lat"] - p["lat"]) * (
        r["lon"] - q["lon"]
    )
    return F.when(F.abs(cross) < COLLINEAR, 0).when(cross > 0, 1).otherwise(-1)


def _within_span(p: Column, q: Column, r: Column) -> Column:
    """q lies in the rectangle spanned by p and r."""
    return q["lat"].between(F.least(p["lat"], r["lat"]), F.greatest(p["lat"], r["lat"])) & q[
        "lon"
    ].between(F.least(p["lon"], r["lon"]), F.greatest(p["lon"], r["lon"]))


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether a-b and c-d meet, touching included."""
    turns = [(a, b, c), (a, b, d), (c, d, a), (c, d, b)]
    o = [_orientation(*t) for t in turns]
    proper = (o[0] != o[1]) & (o[2] != o[3])
    touching = [
        (o[0] == 0) & _within_span(a, c, b),
        (o[1] == 0) & _within_span(a, d, b),
        (o[2] == 0) & _within_span(c, a, d),
        (o[3] == 0) & _within_span(c, b, d),
    ]
    return proper | reduce(or_, touching)


def edges(vertices: Column) -> Column:
    """Consecutive pairs of a chain; none for fewer than two vertices."""
    n = F.size(vertices)
    pairs = F.zip_with(
        F.slice(vertices, F.lit(1), n - 1),
        F.slice(vertices, F.lit(2), n - 1),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    return F.when(n >= 2, pairs)


def in_polygon(p: Column, vertices: Column) -> Column:
    """Parity of the ring edges crossed by a ray going east from p."""
    n = F.size(vertices)
    previous = F.concat(F.array(F.try_element_at(vertices, F.lit(-1))), F.slice(vertices, F.lit(1), n - 1))
    sides = F.zip_with(
        vertices, previous, lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )

    def crossed(side: Column) -> Column:
        a, b = side["a"], side["b"]
        straddles = (a["lat"] > p["lat"]) != (b["lat"] > p["lat"])
        rise = F.nullif(b["lat"] - a["lat"], F.lit(0.0))
        at = (b["lon"] - a["lon"]) * (p["lat"] - a["lat"]) / rise + a["lon"]
        return F.coalesce(straddles & (p["lon"] < at), F.lit(False))

    return F.when(n > 0, F.aggregate(sides, F.lit(False), lambda acc, s: acc != crossed(s))).otherwise(
        F.lit(False)
    )


def in_bounds(lat: Column, lon: Column, box: Column) -> Column:
    return lat.between(box["south"], box["north"]) & lon.between(box["west"], box["east"])


def bounds_meet_box(vertices: Column, box: Column) -> Column:
    """A cheap necessary condition: the chain's bounds overlap the box."""
    lats, lons = vertices["lat"], vertices["lon"]
    return (
        (F.array_max(lats) >= box["south"])
        & (F.array_min(lats) <= box["north"])
        & (F.array_max(lons) >= box["west"])
        & (F.array_min(lons) <= box["east"])
    )


def _corners(box: Column) -> Column:
    """The box as a closed ring of five points."""
    n, s, e, w = (box[side] for side in ("north", "south", "east", "west"))
    return F.array(point(n, w), point(n, e), point(s, e), point(s, w), point(n, w))


def chain_touches_box(vertices: Column, closed: Column, box: Column) -> Column:
    """A vertex inside, an edge crossing, or a ring around a corner of the box."""
    around = lambda sides: F.exists(
        edges(vertices),
        lambda e: F.exists(sides, lambda s: segments_cross(e["a"], e["b"], s["a"], s["b"])),
    )
    exact = (
        F.exists(vertices, lambda v: in_bounds(v["lat"], v["lon"], box))
        | around(edges(_corners(box)))
        | (closed & F.exists(_corners(box), lambda c: in_polygon(c, vertices)))
    )
    return F.when(bounds_meet_box(vertices, box), exact).otherwise(F.lit(False))


def disc_touches_box(lat: Column, lon: Column, radius_m: Column, box: Column) -> Column:
    """Distance from the centre to the box's nearest point against the radius."""
    near_lat = F.least(F.greatest(lat, box["south"]), box["north"])
    near_lon = F.least(F.greatest(lon, box["west"]), box["east"])
    return haversine_m(lat, lon, near_lat, near_lon) <= F.coalesce(radius_m, F.lit(0.0))


def touches_box(geometry: Column, box: Box | Column) -> Column:
    """Whether any part of a parsed geometry touches the box.

    An ellipse is tested as the circle of its major radius, which can only
    include more.
    """
    box = box_struct(box) if isinstance(box, Box) else box
    # Bound as values, so that the geometry is read once, not once per mention.
    return F.exists(F.array(F.struct(geometry.alias("g"), box.alias("b"))), lambda x: _touches(x["g"], x["b"]))


def _touches(g: Column, box: Column) -> Column:
    lat, lon = g["center_lat"], g["center_lon"]
    return (
        F.when(g["kind"] == "point", in_bounds(lat, lon, box))
        .when(g["kind"].isin("circle", "ellipse"), disc_touches_box(lat, lon, g["radius_m"], box))
        .when(g["kind"].isin("polygon", "line"), chain_touches_box(g["vertices"], g["closed"], box))
        .otherwise(F.lit(False))
    )


def ellipse_ring(
    lat: Column, lon: Column, major_m: Column, minor_m: Column, angle_deg: Column, n: int = 64
) -> Column:
    """A closed ring of n + 1 points; the angle is clockwise from north."""
    minor = F.coalesce(minor_m, major_m)
    per_lat = 2 * math.pi * EARTH_RADIUS_M / 360.0
    shrink = F.cos(F.radians(lat))
    per_lon = F.when(shrink == 0, F.lit(1e-9)).otherwise(F.lit(per_lat) * shrink)
    turn = F.radians(F.lit(90.0) - F.coalesce(angle_deg, F.lit(0.0)))

    def corner(i: Column) -> Column:
        t = F.lit(2 * math.pi) * i / F.lit(n)
        along, across = major_m * F.cos(t), minor * F.sin(t)
        east = along * F.cos(turn) - across * F.sin(turn)
        north = along * F.sin(turn) + across * F.cos(turn)
        return point(lat + north / F.lit(per_lat), lon + east / per_lon)

    # The ring closes on its first point exactly, so the last index repeats 0.
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: corner(i % n))


def ring_area(vertices: Column) -> Column:
    """Shoelace area in square degrees, 0 for fewer than three vertices."""

    def area(v: Column) -> Column:
        twice = F.aggregate(
            edges(v),
            F.lit(0.0),
            lambda acc, e: acc + (e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]),
        )
        return F.when(F.size(v) >= 3, F.abs(twice) / 2).otherwise(F.lit(0.0))

    return bound(vertices, area)


def footprint_area(geometry: Column) -> Column:
    """What orders shapes for drawing: ring or ellipse area, 0 for the rest."""

    def area(g: Column) -> Column:
        ring = ellipse_ring(g["center_lat"], g["center_lon"], g["radius_m"], g["minor_m"], g["angle_deg"], n=16)
        return (
            F.when(g["kind"] == "polygon", ring_area(g["vertices"]))
            .when(g["kind"].isin("circle", "ellipse"), ring_area(ring))
            .otherwise(F.lit(0.0))
        )

    return bound(geometry, area)

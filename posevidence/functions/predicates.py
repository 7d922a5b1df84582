"""Row predicates: window, real position, box, type and channel tests."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from posevidence.params import Box, ExportParams

# Type patterns (SQL LIKE) and the type of a bulk file transfer.
CATEGORY_PATTERNS = (
    ("Personnel", "a-%-G-U-%"),
    ("Vehicles and equipment", "a-%-G-E-%"),
    ("Infrastructure", "a-%-G-I%"),
)
MAP_OBJECT_PATTERNS = ("u-d-%", "b-m-%")
BULK_TRANSFER_TYPE = "b-t-f"

# Which of the request's filters narrows each result.
FILTER_MATRIX = {
    "positions": {"time", "area", "channel"},
    "shape_versions": {"time", "channel"},
    "connections": {"time", "channel"},
    "chat": {"time", "channel"},
    "missions": {"channel"},
    "mission_changes": {"time"},
    "mission_subscriptions": set(),
    "mission_contents": set(),
    "files": {"channel"},
    "attachments": set(),
    "video": {"channel"},
    "data_feeds": {"channel"},
    "federation": set(),
}


def in_window(column: str, params: ExportParams) -> Column:
    """Start inclusive, end exclusive; both read in the session time zone."""
    start = F.lit(params.start).cast("timestamp")
    end = F.lit(params.end).cast("timestamp")
    return (F.col(column) >= start) & (F.col(column) < end)


def has_point() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def at_null_island() -> Column:
    """Present, and exactly the (0, 0) a receiver without a fix reports."""
    return has_point() & (F.col("latitude") == 0) & (F.col("longitude") == 0)


def real_position() -> Column:
    return has_point() & ~((F.col("latitude") == 0) & (F.col("longitude") == 0))


def in_box(box: Box, lat: str = "latitude", lon: str = "longitude") -> Column:
    return F.col(lat).between(box.south, box.north) & F.col(lon).between(box.west, box.east)


def not_bulk_transfer() -> Column:
    """A NULL type compares to NULL, so such a row is dropped by a filter."""
    return F.col("cot_type") != BULK_TRANSFER_TYPE


def position_filter(params: ExportParams) -> Column:
    return (
        in_window("servertime", params)
        & real_position()
        & in_box(params.box)
        & not_bulk_transfer()
    )


def mask_bit(mask: Column, bitpos: Column | int) -> Column:
    """Whether the bit at ``bitpos``, counted from the right end, is set.

    The mask is text of 0 and 1, up to tens of thousands of characters wide.
    It is tested as bytes: slicing bytes is a copy of one byte, slicing text
    walks every character before the slice. Positions outside the mask are
    unset (a slice position below 1 would otherwise wrap around).
    """
    bits = mask.cast("binary")
    pos = F.lit(bitpos) if isinstance(bitpos, int) else bitpos
    width = F.octet_length(bits)
    byte = F.substr(bits, width - pos, F.lit(1))
    return F.coalesce((pos >= 0) & (pos < width) & (byte == F.lit(bytearray(b"1"))), F.lit(False))


def on_channels(channels: tuple[int, ...] | None, mask: str = "groups") -> Column:
    if channels is None:
        return F.lit(True)
    if not channels:
        return F.lit(False)
    return reduce(or_, (mask_bit(F.col(mask), int(c)) for c in channels))


def like_any(column: Column, patterns) -> Column:
    return reduce(or_, (column.like(p) for p in patterns))


def is_map_object(column: str = "cot_type") -> Column:
    return like_any(F.col(column), MAP_OBJECT_PATTERNS)


def shape_version_filter(params: ExportParams) -> Column:
    """Drawn objects by window, type and channel only.

    No box and no real-position test: the row's own point is only an anchor,
    the geometry is tested afterwards against every vertex.
    """
    return (
        in_window("servertime", params)
        & is_map_object()
        & on_channels(params.channels)
    )

"""Scalar parameters of one extract: the window, the box, the channels."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values the results depend on.
GAP_SECONDS = 300
UNKNOWN_NUMERIC = 9999999
NOT_RECORDED = "(not recorded)"
EARTH_RADIUS_M = 6371008.8


@dataclass(frozen=True)
class ExportParams:
    """A half-open time window, an inclusive box and an optional channel choice.

    ``channels`` has three meanings: ``None`` applies no channel filter, an
    empty tuple is a deliberate "nothing selected" and matches no row, and a
    non-empty tuple keeps rows that carry at least one of the bit positions.
    """

    start: str
    end: str
    north: float
    south: float
    east: float
    west: float
    case_id: str = ""
    channels: tuple[int, ...] | None = None
    include_feed_shapes: bool = False

    @property
    def box(self) -> "Box":
        return Box(self.north, self.south, self.east, self.west)


@dataclass(frozen=True)
class Box:
    north: float
    south: float
    east: float
    west: float

"""Classification and reading expressions for single position rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from posevidence.functions.predicates import (
    CATEGORY_PATTERNS,
    MAP_OBJECT_PATTERNS,
    like_any,
)
from posevidence.params import UNKNOWN_NUMERIC

# Labels and codes that appear in results.
MAP_OBJECTS = "Map objects"
CATEGORY_ORDER = (
    "Personnel",
    "Vehicles and equipment",
    "Infrastructure",
    "Other entities",
    "Map objects",
    "Other",
)
CHANGE_TYPES = {
    0: "CREATE_MISSION",
    1: "DELETE_MISSION",
    2: "ADD_CONTENT",
    3: "REMOVE_CONTENT",
    4: "CREATE_DATA_FEED",
    5: "DELETE_DATA_FEED",
}
UNKNOWN_CHANGE = "unknown code"
REMOVE_CONTENT = 3
MPH_PER_MPS = 2.23694


def cot_category(cot_type: Column) -> Column:
    """First matching category, NULL for a type in none of them."""
    ladder = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, pattern in CATEGORY_PATTERNS:
        ladder = ladder.when(cot_type.like(pattern), F.lit(label))
    return ladder.when(like_any(cot_type, MAP_OBJECT_PATTERNS), F.lit(MAP_OBJECTS))


def track_category(cot_type: Column) -> Column:
    return F.coalesce(
        cot_category(cot_type),
        F.when(cot_type.startswith("a-"), F.lit("Other entities")),
        F.lit("Other"),
    )


def category_rank(category: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), category)


def accuracy_unknown(ce: Column) -> Column:
    return ce.isNull() | (ce >= UNKNOWN_NUMERIC)


def fix_class(how: Column, ce: Column) -> Column:
    return (
        F.when(how.startswith("h-"), F.lit("manualPlaced"))
        .when(accuracy_unknown(ce), F.lit("accuracyUnknown"))
        .otherwise(F.lit("normalFix"))
    )


def speed_status(speed: Column) -> Column:
    """-1 is "no speed solution" and 0 is "measured as stationary"."""
    v = speed.try_cast("double")
    return (
        F.when(speed.isNull() | (speed == ""), F.lit("not reported"))
        .when(v.isNull(), F.lit("not numeric"))
        .when(v < 0, F.lit("unavailable"))
        .when(v == 0, F.lit("stationary"))
        .otherwise(F.lit("moving"))
    )


def speed_mps(speed: Column) -> Column:
    v = speed.try_cast("double")
    return F.when(v >= 0, v)


def speed_mph(speed: Column) -> Column:
    return speed_mps(speed) * F.lit(MPH_PER_MPS)


def course_status(course: Column) -> Column:
    v = course.try_cast("double")
    return (
        F.when(course.isNull() | (course == ""), F.lit("not reported"))
        .when(v.isNull(), F.lit("not numeric"))
        .when((v < 0) | (v >= UNKNOWN_NUMERIC), F.lit("unavailable"))
        .otherwise(F.lit("reported"))
    )


def course_degrees(course: Column) -> Column:
    v = course.try_cast("double")
    return F.when((v >= 0) & (v < UNKNOWN_NUMERIC), v)


def accuracy_metres(ce: Column) -> Column:
    return F.when(~accuracy_unknown(ce), ce)


def change_type_name(code: Column) -> Column:
    ladder = F.when(F.lit(False), F.lit(None).cast("string"))
    for value, name in CHANGE_TYPES.items():
        ladder = ladder.when(code == value, F.lit(name))
    return ladder.otherwise(F.lit(UNKNOWN_CHANGE))


def uid_kind(sorted_types: Column) -> Column:
    return F.when(sorted_types.startswith("a-"), F.lit("device/entity")).otherwise(
        F.lit("message or object")
    )


def exclusion_reason(exported, with_position, at_zero, inside) -> Column:
    """Why a device is or is not in the extract; the first reason that fits."""
    return (
        F.when(exported > 0, F.lit("included"))
        .when((with_position == 0) & (at_zero > 0), F.lit("no valid GPS fix (0,0)"))
        .when(with_position == 0, F.lit("no position data in these events"))
        .when(inside == 0, F.lit("had positions, none inside the bounding box"))
        .otherwise(F.lit("inside the bounding box, but not on a selected channel"))
    )


def has_secret(secret: Column) -> Column:
    """States that a secret is set without ever selecting it."""
    return F.when(secret.isNull(), F.lit("no")).otherwise(F.lit("yes"))


def percent_of(n: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(n * F.lit(100.0).cast("double") / total, 1))


def source_identity(cluster_id: Column, catalog_id: Column) -> Column:
    """How the source named itself: cluster id, else catalogue ids, else ''."""
    return (
        F.when(F.coalesce(cluster_id, F.lit("")) != "", F.concat(F.lit("cluster "), cluster_id))
        .when(F.coalesce(catalog_id, F.lit("")) != "", F.concat(F.lit("catalog "), catalog_id))
        .otherwise(F.lit(""))
    )


def argb_hex(argb: Column) -> Column:
    """A signed 32-bit ARGB integer as AARRGGBB, '' when absent."""
    unsigned = argb.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.coalesce(F.lpad(F.hex(unsigned), 8, "0"), F.lit(""))


def argb_to_abgr(argb: Column, default: str = "ff000000") -> Column:
    """The same colour in alpha-blue-green-red order, lower case."""
    text = F.lower(argb_hex(argb))
    swapped = F.concat(
        F.substring(text, 1, 2), F.substring(text, 7, 2), F.substring(text, 5, 2), F.substring(text, 3, 2)
    )
    return F.when(argb.isNull(), F.lit(default)).otherwise(swapped)

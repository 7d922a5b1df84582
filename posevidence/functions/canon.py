"""Canonical text of values and the content hash of a log row."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The hashed fields in order, and the one suffix that may be added
# to a row after it was written.
CHAIN_FIELDS = (
    "ts_utc", "ts_local", "actor", "client_ip", "case_id", "export_kind",
    "window_start", "window_end", "north", "south", "west", "east",
    "record_count", "package_sha256", "outcome", "detail", "files_excluded",
    "channels_excluded", "window_timezone", "requested_for", "tool_version",
)
DELIVERED = " / delivered"


def float_text(value: Column) -> Column:
    """A double's shortest text, with exponents only outside 1e-4 to 1e16."""
    text = value.cast("string")
    size = F.abs(value)
    digits = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    sign = F.when(power < 0, F.lit("-")).otherwise(F.lit("+"))
    exponent = F.abs(power).cast("string")
    scientific = F.concat(
        digits, F.lit("e"), sign, F.when(F.length(exponent) < 2, F.lpad(exponent, 2, "0")).otherwise(exponent)
    )
    plain = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    return (
        F.when(F.isnan(value), "nan")
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when(~text.contains("E"), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def _field_text(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("")
    text = F.col(name).cast("string")
    if name == "outcome":
        text = F.replace(text, F.lit(DELIVERED), F.lit(""))
    return F.coalesce(text, F.lit(""))


def chained_content(df: DataFrame) -> Column:
    """All hashed fields but the previous hash, each after a NUL."""
    floating = {n for n, kind in df.dtypes if kind in ("double", "float")}
    runs = [list(run) for _, run in groupby(CHAIN_FIELDS, key=lambda n: n in floating)]
    texts = [
        # One copy of the number spelling per run of numbers, not per column.
        F.transform(
            F.array(*[F.col(n).cast("double") for n in run]), lambda v: F.coalesce(float_text(v), F.lit(""))
        )
        if run[0] in floating
        else F.array(*[_field_text(df, n) for n in run])
        for run in runs
    ]
    nul = F.char(F.lit(0))
    return F.concat(nul, F.array_join(F.concat(*texts), "\0"))


def row_hash(df: DataFrame, prev_hash: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(prev_hash, F.lit("")), chained_content(df)), 256)

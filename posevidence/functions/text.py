"""Text expressions: attribute extraction, redaction, guards and clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where each extracted attribute sits inside the detail blob.
DETAIL_PATTERNS = {
    "callsign": r'<contact[^>]*callsign="([^"]*)"',
    "geopoint_src": r'<precisionlocation[^>]*geopointsrc="([^"]*)"',
    "reported_team": r'<__group[^>]*name="([^"]*)"',
    "reported_role": r'<__group[^>]*role="([^"]*)"',
    "course_deg": r'<track[^>]*course="([^"]*)"',
    "speed_ms": r'<track[^>]*speed="([^"]*)"',
    "battery_pct": r'<status[^>]*battery="([^"]*)"',
    "device_model": r'<takv[^>]*device="([^"]*)"',
    "tak_platform": r'<takv[^>]*platform="([^"]*)"',
    "tak_version": r'<takv[^>]*version="([^"]*)"',
    "remarks": r"<remarks[^>]*>([^<]*)</remarks>",
}

# The replacement written over stream credentials.
REDACTED = "://[CREDENTIALS-REDACTED]@"
REDACTION_MARK = "CREDENTIALS-REDACTED"

CLAUSE_SAFE_LENGTH = 200
CLEAN_TEXT_LENGTH = 300

# Whitespace as Python's str.strip/str.split see it, controls 0x1c-0x1f included.
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def first_group(text: Column, pattern: str) -> Column:
    """The first match's group 1; NULL without a match, '' for an empty value.

    Extraction gives '' in both cases, so only an empty result is looked at
    twice.
    """
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found).when(text.rlike(pattern), F.lit(""))


def detail_attribute(name: str, detail: str = "detail") -> Column:
    return first_group(F.col(detail), DETAIL_PATTERNS[name])


def redact_first_credentials(url: Column) -> Column:
    """Only the first URL's credentials, as a stream URL holds one address."""
    return F.regexp_replace(url, r"(?s)^(.*?)://[^/@]*@", "$1" + REDACTED)


def redact_all_credentials(xml: Column) -> Column:
    return F.regexp_replace(xml, r'://[^/@<"]*@', REDACTED)


def count_marks(text: Column, mark: str = REDACTION_MARK) -> Column:
    """Occurrences of ``mark`` in one value, 0 for NULL."""
    shortened = F.replace(text, F.lit(mark), F.lit(""))
    return F.coalesce(
        ((F.length(text) - F.length(shortened)) / F.lit(len(mark))).cast("bigint"), F.lit(0)
    )


def guard_cell(cell: Column) -> Column:
    """A leading apostrophe on text a spreadsheet would run as a formula.

    Leading whitespace is ignored when looking for the first character, and a
    plain signed number stays as it is.
    """
    stripped = F.regexp_replace(cell, r"^" + _SPACE + "+", "")
    formula = stripped.rlike(r"^[=+\-@]") & ~stripped.rlike(r"^[+-]?\p{Nd}+(\.\p{Nd}+)?\n?\z")
    return F.when(formula, F.concat(F.lit("'"), cell)).otherwise(cell)


def guard_row(df):
    """Guard every text column of a result; other types cannot be formulas."""
    return df.select(
        *[
            guard_cell(F.col(f"`{name}`")).alias(name) if kind == "string" else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


def clause_safe(text: Column, limit: int = CLAUSE_SAFE_LENGTH) -> Column:
    """Text that cannot open a clause: no ';', no control but tab, bounded."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[;\x00-\x08\x0a-\x1f]", "")
    return F.substring(kept, 1, limit)


def clean_text(text: Column, limit: int = CLEAN_TEXT_LENGTH) -> Column:
    """Database-supplied text on one line: spaces collapsed, controls dropped."""
    one_line = F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE + "+", " ")
    trimmed = F.regexp_replace(one_line, r"^ | $", "")
    return F.substring(F.regexp_replace(trimmed, r"[;\x00-\x1f\x7f]", ""), 1, limit)


def case_name(text: Column) -> Column:
    """A case reference as recorded: outer space, quotes, ';' and controls off."""
    stripped = F.regexp_replace(
        F.coalesce(text, F.lit("")), "^" + _SPACE + "+|" + _SPACE + r"+\z", ""
    )
    return F.regexp_replace(stripped, r"[\";\x00-\x08\x0a-\x1f]", "")


def file_safe_case(text: Column) -> Column:
    """A case reference usable in a file name, never empty."""
    kept = F.regexp_replace(case_name(text), r"[^\p{L}\p{N}._-]", "")
    return F.when(kept == "", F.lit("export")).otherwise(kept)


def distinct_text(column: Column, separator: str) -> Column:
    """Distinct values in binary order, NULL when there is none."""
    values = F.collect_set(column)
    return F.when(F.size(values) > 0, F.array_join(F.sort_array(values), separator))

"""Registered queries, each beside the SQL that checks it.

A query is a function of ``CheckTables``; its check, where SQL can state it,
names the relations it reads and is run on the same tables by another engine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from posevidence.functions.text import DETAIL_PATTERNS
from posevidence.sources.adapter import CHECK_CHANNELS, CHECK_PARAMS, CheckTables, relation_sql


@dataclass(frozen=True)
class Registered:
    name: str
    covers: tuple[str, ...]
    build: Callable[[CheckTables], DataFrame]
    check_sql: str | None


REGISTRY: dict[str, Registered] = {}


def registered(name: str, covers: str, relations: str = "", check: str | None = None):
    """Register a query; ``check`` may start with its own WITH list."""

    def keep(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        sql = with_relations(relations.split(), check) if check is not None else None
        REGISTRY[name] = Registered(name, tuple(covers.split()), build, sql)
        return build

    return keep


def with_relations(relations: list[str], body: str) -> str:
    heads = [f"{r} AS ({relation_sql(r)})" for r in relations]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        recursive = body[5:15].upper().startswith("RECURSIVE ")
        rest = body[15:] if recursive else body[5:]
        joiner = ",\n" if heads else ""
        return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(heads) + joiner + rest
    return (("WITH " + ",\n".join(heads) + "\n") if heads else "") + body


# Pieces of check SQL.
_P = CHECK_PARAMS
IN_WINDOW = (
    f"servertime >= TIMESTAMP '{_P.start}' AND servertime < TIMESTAMP '{_P.end}'"
)
IN_BOX = (
    f"latitude >= {_P.south} AND latitude <= {_P.north} "
    f"AND longitude >= {_P.west} AND longitude <= {_P.east}"
)
REAL = "latitude IS NOT NULL AND longitude IS NOT NULL AND (latitude <> 0 OR longitude <> 0)"
MATCHING = f"{IN_WINDOW} AND {REAL} AND {IN_BOX} AND cot_type <> 'b-t-f'"


def window_on(column: str) -> str:
    return f"{column} >= TIMESTAMP '{_P.start}' AND {column} < TIMESTAMP '{_P.end}'"


def attr(name: str, column: str = "detail") -> str:
    pattern = DETAIL_PATTERNS[name]
    return f"CASE WHEN regexp_matches({column}, '{pattern}') THEN regexp_extract({column}, '{pattern}', 1) END"


def decoded(relation: str, name: str = "decoded") -> str:
    """A WITH entry: channel names and numbers of every mask in a relation."""
    return f"""{name} AS (
  SELECT m.groups AS mask,
         string_agg(c.name, ', ' ORDER BY c.bitpos) AS channels,
         string_agg(CAST(c.bitpos AS VARCHAR), ',' ORDER BY c.bitpos) AS channel_numbers
  FROM (SELECT DISTINCT groups FROM {relation}) m
  JOIN channels c ON substr(reverse(m.groups), c.bitpos + 1, 1) = '1'
  GROUP BY m.groups)"""


def on_any_channel(channels=CHECK_CHANNELS, column: str = "groups") -> str:
    return "(" + " OR ".join(f"substr(reverse({column}), {c} + 1, 1) = '1'" for c in channels) + ")"

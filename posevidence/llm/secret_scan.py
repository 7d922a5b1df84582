"""Secrets in texts, told apart by who else holds them.

Patterns find candidates in every whole text; a hash of each candidate value is
counted over the corpus by distinct owners and distinct repositories. A value that
many hold is copied (an example key, a placeholder); a value of one owner alone
that looks like a live credential is reported as live, also where no pattern names
it: any run of the token alphabet is a candidate, and joins the spans only if the
corpus says that one owner alone holds it.

The values are counted as (hash, owner, repository) before they meet, so a value
that a third of all documents hold is one row for each of its repositories; the
counts go back to the candidates by a join that adaptive execution splits where a
value is that frequent. No text leaves the first pass.

Rows: one for each row of the input, equal ids included. NULL and empty texts
have no span. NULL owners and repositories are one each. Matches never cross
documents. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posevidence.llm.common import stored, strings

# The patterns, the least length of what counts, and their order.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "live")

#: A run of the token alphabet that may be a credential of its own, and what
#: makes a value look like a live one: all three classes and many characters.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_LIVE = 20
LEAST_DIFFERENT = 12
#: Held by so many owners, or repositories, a value is a copied example.
COPIED_OWNERS = 3
COPIED_REPOSITORIES = 5

SPANS = "array<struct<start:int,kind:int,end:int,value:string,looks_live:boolean>>"


def _looks_live(value: str) -> bool:
    return (
        len(value) >= LEAST_LIVE
        and len(set(value)) >= LEAST_DIFFERENT
        and any("0" <= c <= "9" for c in value)
        and any("a" <= c <= "z" for c in value)
        and any("A" <= c <= "Z" for c in value)
    )


def candidates(text: str) -> list[tuple[int, int, int, str, bool]]:
    """(start, kind, end, hash of the value, looks live), by start and kind."""
    found = []

    def add(kind, match, value):
        digest = hashlib.sha256(value.encode("utf-8")).hexdigest()
        found.append((match.start(), kind, match.end(), digest, _looks_live(value)))

    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST_ASSIGNED:
            add(0, m, m[2])
    for m in ACCESS.finditer(text):
        if len(m[0]) >= LEAST_ACCESS:
            add(1, m, m[0])
    for m in HEX.finditer(text) if _LONG_HEX.search(text) else ():
        if len(m[0]) >= LEAST_HEX:
            add(2, m, m[0])
    known = sorted((start, end) for start, _, end, _, _ in found)
    for m in RUN.finditer(text):
        if _looks_live(m[0]) and not any(a < m.end() and m.start() < b for a, b in known):
            add(3, m, m[0])
    return sorted(found)


# Nearly no text has a run that counts, and looking for one is cheap.
_LONG_HEX = re.compile(r"[0-9a-f]{24}")


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(
        pa.struct(
            [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("looks_live", pa.bool_())]
        )
    )
    names = [f.name for f in kind.value_type]
    for batch in batches:
        spans = [[dict(zip(names, c)) for c in candidates(t)] for t in strings(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("row", "doc_id", "owner", "repository")), pa.array(spans, kind)],
            ["row", "doc_id", "owner", "repository", "spans"],
        )


def scanned(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """(row, doc_id, owner, repository, spans): candidates of every document."""
    named = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        "text",
    )
    return named.mapInArrow(_find, f"row long, doc_id long, owner string, repository string, spans {SPANS}")


def ownership(found: DataFrame) -> DataFrame:
    """(value, owners, repositories): how many hold each value, over the corpus."""
    held = found.select("owner", "repository", F.explode(F.array_distinct("spans.value")).alias("value"))
    return (
        held.distinct()
        .groupBy("value")
        .agg(F.count_distinct("owner").alias("owners"), F.count("*").alias("repositories"))
    )


def judged(found: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """(row, spans): the spans that stay, each with its verdict: ``live``,
    ``copied`` or ``found`` (a base pattern's match that is neither)."""
    owners = ownership(found)
    each = found.select("row", F.explode("spans").alias("span"))
    copied = (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories)
    verdict = (
        F.when(copied, "copied").when(F.col("span.looks_live") & (F.col("owners") == 1), "live").otherwise("found")
    )
    return (
        each.withColumn("value", F.col("span.value"))
        .join(owners, "value")
        .withColumn("verdict", verdict)
        .filter((F.col("span.kind") < 3) | (F.col("verdict") == "live"))
        .groupBy("row")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("span.start", "span.kind", "span.end", "value", "verdict", "owners", "repositories"))
            ).alias("spans")
        )
    )


def secrets(
    docs: DataFrame, owner: str = "source", repository: Sequence[str] = ("source", "lang"),
    copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES,
) -> DataFrame:
    """(doc_id, spans): every row of ``docs`` with its spans (start, kind, end,
    value hash, verdict, owners, repositories), in code points, end exclusive.

    A repository is what the named columns together say.
    """
    whole = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"c{k}") for k, c in enumerate(repository)]))
    found = stored(scanned(docs, F.col(owner), whole), "secret-candidates")
    kept = judged(found, copied_owners, copied_repositories)
    empty = F.from_json(F.lit("[]"), kept.schema["spans"].dataType)
    return (
        found.select("row", "doc_id")
        .join(kept, "row", "left")
        .select("doc_id", F.coalesce("spans", empty).alias("spans"))
    )


def named_spans(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )

"""How far the sources of a language differ in their words, exactly.

Every (lang, source) group is a column of counts over the vocabulary of its
language. The vocabulary is reordered so that equal counts lie together
(columns of few different counts first, then in the order of whole count rows),
cut into blocks of ``BLOCK`` terms, and every column of a block is run-length
encoded. Two columns are compared by intersecting the boundaries of their runs:
within an intersection both shares are constant, so the difference is taken once
and multiplied by the length.

A language's terms are spread over all tasks by range, a block's columns over
pairs of tiles of ``TILE`` columns, so no task holds a whole language, a whole
group or all columns of a block. A row of the vocabulary holds one count for each
group that has the term, of which the report has all pairs.

Rows: NULL text, lang and source count as ''. Repeated rows are documents of
their own. A group without terms has shares like any other. Ties in a rank go by
item. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posevidence.llm.common import stored, text_bytes

LEAST_DOCUMENTS = 30
MOST_TERMS = 50
BLOCK = 8192
TILE = 32
#: Copies of the table of groups, so that rows of one group meet in many tasks.
SALTS = 16
#: Terms that one task counts before it hands them on.
HELD_TERMS = 1 << 18

_TERM_BYTES = np.full(256, 0x20, np.uint8)
_TERM_BYTES[0x80:] = np.arange(0x80, 0x100)
_TERM_BYTES[0x61:0x7B] = np.arange(0x61, 0x7B)
_TERM_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every term, by group, added up task by task."""
    counts, within = defaultdict(Counter), defaultdict(Counter)

    def flushed():
        for (lang, source), found in counts.items():
            terms = list(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array([found[t] for t in terms], pa.int64()),
                    pa.array([within[lang, source][t] for t in terms], pa.int64()),
                ],
                ["lang", "source", "term", "n", "documents"],
            )
        counts.clear()
        within.clear()

    held = 0
    for batch in batches:
        data, at = text_bytes(batch.column("text"))
        letters = _TERM_BYTES[data].tobytes()
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        for k, group in enumerate(groups):
            terms = letters[at[k] : at[k + 1]].split(b" ")
            own = Counter(terms)
            del own[b""]
            seen = counts[group]
            before = len(seen)
            seen.update(own)
            within[group].update(own.keys())
            held += len(seen) - before
            if held >= HELD_TERMS:
                yield from flushed()
                held = 0
    yield from flushed()


def _share(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / whole) by long division in base 1,000, so
    that nothing leaves 64 bits; count + 5 is never over the whole."""
    rest, share = count + 5, F.lit(0).cast("long")
    for _ in range(3):
        share = share * 1000 + F.call_function("div", rest * 1000, whole)
        rest = (rest * 1000) % whole
    return share + 1


def _shares(counts: np.ndarray, whole: int) -> np.ndarray:
    rest, share = counts + 5, np.zeros(len(counts), np.int64)
    for _ in range(3):
        share = share * 1000 + rest * 1000 // whole
        rest = rest * 1000 % whole
    return share + 1


def counted_terms(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, total, counts): kept terms and their counts by source."""
    texts = _texts(docs)
    partial = texts.mapInArrow(_partial_counts, "lang string, source string, term string, n long, documents long")
    return (
        partial.repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
        .groupBy("lang", "term")
        .agg(
            F.sum("documents").alias("documents"),
            F.sum("n").alias("total"),
            F.collect_list(F.struct("source", "n")).alias("counts"),
        )
        .filter(F.col("documents") >= least_documents)
        .drop("documents")
    )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def columns_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """One row for each occurring group: its place among the columns of its
    language, its denominator, the language's, and the number of columns."""
    cells = terms.select("lang", F.explode("counts").alias("cell")).select("lang", "cell.source", "cell.n")
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_distinct("n").alias("kinds"))
    whole = terms.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("total").alias("n_lang"))
    by_lang = Window.partitionBy("lang")
    return (
        _texts(docs)
        .select("lang", "source")
        .distinct()
        .join(own, ["lang", "source"], "left")
        .join(whole, "lang", "left")
        .na.fill(0, ["n", "kinds", "n_terms", "n_lang"])
        .select(
            "lang",
            "source",
            (F.row_number().over(by_lang.orderBy("kinds", "source")) - 1).alias("place"),
            F.count("*").over(by_lang).cast("int").alias("n_columns"),
            (F.col("n") + 5 * F.col("n_terms")).alias("whole"),
            (F.col("n_lang") + 5 * F.col("n_terms")).alias("lang_whole"),
        )
    )


def _salted(columns: DataFrame) -> DataFrame:
    return columns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def vocabulary_rows(terms: DataFrame, columns: DataFrame) -> DataFrame:
    """(lang, term, total, lang_whole, cells): counts in the order of columns."""
    cells = terms.select(
        "lang", "term", "total", F.explode("counts").alias("cell"), F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int").alias("salt")
    ).select("lang", "term", "total", "salt", "cell.source", "cell.n")
    return (
        cells.join(_salted(columns), ["lang", "source", "salt"])
        .groupBy("lang", "term")
        .agg(
            F.first("total").alias("total"),
            F.first("lang_whole").alias("lang_whole"),
            F.sort_array(F.collect_list(F.struct("place", "n", "whole", "source"))).alias("cells"),
        )
    )


def _run_columns(block: int):
    """Arrow batches of sorted vocabulary rows to one row for every column with
    a count in a block of at most ``block`` terms."""

    def encode(lang, number, rows):
        length = len(rows)
        places = np.concatenate([p for p, _ in rows])
        counts = np.concatenate([n for _, n in rows])
        at = np.repeat(np.arange(length), [len(p) for p, _ in rows])
        order = np.lexsort((at, places))
        places, counts, at = places[order], counts[order], at[order]
        firsts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
        found = []
        for a, b in zip(firsts, [*firsts[1:], len(places)]):
            column = np.zeros(length, np.int64)
            column[at[a:b]] = counts[a:b]
            ends = np.r_[np.flatnonzero(column[1:] != column[:-1]) + 1, length]
            found.append((int(places[a]), ends.astype(np.int32), column[ends - 1]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(found), pa.string()),
                pa.array([number] * len(found), pa.int64()),
                pa.array([length] * len(found), pa.int32()),
                pa.array([f[0] for f in found], pa.int32()),
                pa.array([f[1] for f in found], pa.list_(pa.int32())),
                pa.array([f[2] for f in found], pa.list_(pa.int64())),
            ],
            ["lang", "block", "length", "place", "ends", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, of = [], None
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            lists = batch.column("places")
            at = lists.offsets.to_numpy()
            places = lists.values.to_numpy()
            counts = batch.column("counts").values.to_numpy()
            for k, lang in enumerate(langs):
                if held and (lang != of or len(held) == block):
                    yield encode(of, number, held)
                    number += 1
                    held = []
                of = lang
                held.append((places[at[k] : at[k + 1]], counts[at[k] : at[k + 1]]))
        if held:
            yield encode(of, number, held)

    return run


def run_columns(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, block, length, place, ends, counts): run-length encoded columns."""
    # Place and count in one number: what the driver samples to cut the ranges is
    # short, and larger counts only share a place in the order.
    packed = F.transform("cells", lambda c: F.shiftleft(c["place"].cast("long"), 40) + F.least(c["n"], F.lit((1 << 40) - 1)))
    return (
        rows.select("lang", "term", "cells", packed.alias("packed"))
        .repartitionByRange("lang", "packed", "term")
        .sortWithinPartitions("lang", "packed", "term")
        .select("lang", F.col("cells.place").alias("places"), F.col("cells.n").alias("counts"))
        .mapInArrow(
            _run_columns(block),
            "lang string, block long, length int, place int, ends array<int>, counts array<long>",
        )
    )


def intersected(ends_a: np.ndarray, a: np.ndarray, ends_b: np.ndarray, b: np.ndarray) -> int:
    """Sum of |a - b| over two run-length encoded columns of one length."""
    ends = np.union1d(ends_a, ends_b)
    differences = np.abs(a[np.searchsorted(ends_a, ends)] - b[np.searchsorted(ends_b, ends)])
    return int((differences * np.diff(ends, prepend=0)).sum())


def _tile_sums(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Partial sums of the pairs of columns that one pair of tiles holds."""
    lang, _, low, high = (k.as_py() for k in key)
    columns = []
    for row in sorted(table.to_pylist(), key=lambda r: r["place"]):
        ends = np.array(row["ends"] if row["ends"] is not None else [row["length"]], np.int64)
        counts = np.array(row["counts"] if row["counts"] is not None else [0], np.int64)
        shares = _shares(counts, row["whole"]) if row["length"] else counts
        columns.append((row["place"], row["source"], ends, shares))
    left = [c for c in columns if c[0] // TILE == low]
    right = [c for c in columns if c[0] // TILE == high]
    found = [
        (lang, a[1], b[1], intersected(a[2], a[3], b[2], b[3])) for a in left for b in right if a[0] < b[0]
    ]
    return pa.table(
        {
            "lang": pa.array([f[0] for f in found], pa.string()),
            "a": pa.array([f[1] for f in found], pa.string()),
            "b": pa.array([f[2] for f in found], pa.string()),
            "value": pa.array([f[3] for f in found], pa.int64()),
        }
    )


def pair_divergence(columns: DataFrame, runs: DataFrame) -> DataFrame:
    """(lang, a, b, value) for every two sources of a language, once."""
    blocks = runs.select("lang", "block", "length").distinct()
    # A language without kept terms has one block of no terms.
    blocks = blocks.unionByName(
        columns.select("lang", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("length")).distinct()
    ).withColumn("salt", F.pmod("block", F.lit(SALTS)).cast("int"))
    whole = (
        blocks.join(_salted(columns), ["lang", "salt"])
        .select("lang", "block", "length", "source", "place", "n_columns", "whole")
        .join(runs.drop("length"), ["lang", "block", "place"], "left")
    )
    tile = F.floor(F.col("place") / TILE).cast("int")
    last = F.floor((F.col("n_columns") - 1) / TILE).cast("int")
    return (
        whole.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        .withColumns({"low": F.least(tile, "other"), "high": F.greatest(tile, "other")})
        .drop("n_columns", "other")
        .groupBy("lang", "block", "low", "high")
        .applyInArrow(_tile_sums, "lang string, a string, b string, value long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"))
    )


def term_divergence(rows: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): terms that a source has more of."""
    cells = rows.select("lang", "term", "total", "lang_whole", F.explode("cells").alias("cell"))
    value = _share(F.col("cell.n"), F.col("cell.whole")) - _share(F.col("total"), F.col("lang_whole"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return (
        cells.select("lang", "cell.source", F.col("term").alias("item"), value.alias("value"))
        .filter("value > 0")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= most)
    )


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the
    language by distance, and the terms that mark each source."""
    terms = stored(counted_terms(docs, least_documents), "divergence-terms")
    columns = stored(columns_of(docs, terms), "divergence-columns")
    rows = stored(vocabulary_rows(terms, columns), "divergence-rows")
    runs = stored(run_columns(rows, block), "divergence-runs")
    pairs = stored(pair_divergence(columns, runs), "divergence-pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    parts = both.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")).unionByName(
        term_divergence(rows, most_terms).withColumn("part", F.lit("term"))
    )
    return parts.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))

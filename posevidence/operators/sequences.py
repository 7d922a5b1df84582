"""Sequence operators that never order a whole key in one task.

A key may hold a large share of all rows, so rows are ordered in (key, slice)
windows, where the slice rises with the order; one narrow row for each slice
carries what crosses its border. Rows are exchanged once: the summaries come back
by a join on the windows' own partitioning, which plain equality keeps. Keys
must not be NULL.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posevidence.materialize import settle

# Values in one cell at most, where they are handed out in pieces.
PIECE = 1000


def with_summaries(marked: DataFrame, summaries: DataFrame, on: list[str]) -> DataFrame:
    """Rows beside their slice's summary, on the partitioning they have."""
    renamed = summaries.withColumnsRenamed({c: f"__on{i}" for i, c in enumerate(on)})
    return marked.join(renamed, reduce(and_, (F.col(c) == F.col(f"__on{i}") for i, c in enumerate(on))))


def carried(
    rows: DataFrame, keys: list[str], slice_column: str, order: list[str], value: str, name: str, ahead: bool = False
) -> DataFrame:
    """``name``: the last ``value`` that is not NULL up to each row, its own
    included; with ``ahead`` the first from it on. An as-of merge: put what is
    looked up and what looks it up in one frame, and let it be carried along."""
    by = [F.desc(c) if ahead else F.asc(c) for c in order]
    inner = Window.partitionBy(*keys, slice_column).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("__near", F.last(value, ignorenulls=True).over(inner))
    edge = F.min_by if ahead else F.max_by
    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    of_slice = rows.groupBy(*keys, slice_column).agg(edge(F.col(value), place).alias("__edge"))
    by_slice = Window.partitionBy(*keys).orderBy(F.desc(slice_column) if ahead else F.asc(slice_column))
    earlier = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    summaries = of_slice.select(*keys, slice_column, F.last("__edge", ignorenulls=True).over(earlier).alias("__far"))
    return with_summaries(marked, summaries, [*keys, slice_column]).select(
        *[F.col(f"`{c}`") for c in rows.columns], F.coalesce("__near", "__far").alias(name)
    )


def placed(rows: DataFrame, keys: list[str], slice_column: str, order: list[str], following: list[str]) -> DataFrame:
    """``place`` of each row of its key from 1, ``total`` rows of the key, whether
    one follows (``next_row``), and the following row's values (``next_...``)."""
    packed: Column = F.struct(*following)
    inner = Window.partitionBy(*keys, slice_column).orderBy(*order)
    marked = rows.withColumns({"__place": F.row_number().over(inner), "__near": F.lead(packed).over(inner)})
    of_slice = rows.groupBy(*keys, slice_column).agg(
        F.count("*").alias("__size"), F.min_by(packed, F.struct(*order)).alias("__edge")
    )
    whole = Window.partitionBy(*keys)
    by_slice = whole.orderBy(slice_column)
    summaries = of_slice.select(
        *keys,
        slice_column,
        F.coalesce(F.sum("__size").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__size").over(whole).alias("__total"),
        F.lead("__edge").over(by_slice).alias("__far"),
    )
    after = F.coalesce("__near", "__far")
    return with_summaries(marked, summaries, [*keys, slice_column]).select(
        *[F.col(f"`{c}`") for c in rows.columns],
        (F.col("__before") + F.col("__place")).alias("place"),
        F.col("__total").alias("total"),
        after.isNotNull().alias("next_row"),
        *[after[v].alias(f"next_{v}") for v in following],
    )


def distinct_in_pieces(rows: DataFrame, keys: list[str], value: str, size: int = PIECE, separator: str = " ") -> DataFrame:
    """Each key's distinct values in binary order, cut into pieces from 1: the
    keys, ``piece``, ``n_values``, ``first_value``, ``last_value`` and ``seen``.

    No cell holds more than ``size`` values, however many a key has. Values are
    made distinct where the rows are; slices are ranges of (key, value), written
    once, since they must be the same wherever they are read. A key may be NULL;
    a key without a value has no piece.
    """
    known = [F.col(f"`{k}`").isNotNull().alias(f"__known{i}") for i, k in enumerate(keys)]
    shown = [F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys)]
    filled = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")).alias(f"__text{i}") for i, k in enumerate(keys)]
    by = [f"__{part}{i}" for i in range(len(keys)) for part in ("known", "text")]
    found = rows.filter(F.col(f"`{value}`").isNotNull()).select(*known, *shown, *filled, F.col(f"`{value}`").alias("__value"))
    ranges = found.distinct().repartitionByRange(*by, "__value").withColumn("__slice", F.spark_partition_id())
    numbered = placed(settle(ranges), by, "__slice", ["__value"], ["__value"])
    piece = F.floor((F.col("place") - 1) / size) + 1
    pieces = numbered.groupBy(*by, piece.cast("long").alias("piece")).agg(
        *[F.first(f"__key{i}").alias(f"__key{i}") for i in range(len(keys))],
        F.count("*").alias("n_values"),
        F.min("__value").alias("first_value"),
        F.max("__value").alias("last_value"),
        F.array_join(F.array_sort(F.collect_list("__value")), separator).alias("seen"),
    )
    named = [F.col(f"__key{i}").alias(k) for i, k in enumerate(keys)]
    return pieces.select(*named, "piece", "n_values", "first_value", "last_value", "seen")

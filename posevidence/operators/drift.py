"""Schema drift, decoding health and liveness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posevidence.functions.text import clean_text, detail_attribute
from posevidence.operators.channels import ChannelDecoder

# How bad each status is, and how long a silence means nothing.
STATUS_RANK = {"skip": 0, "ok": 1, "warn": 2, "fail": 3}
LIVENESS_MIN_GAP_SECONDS = 30 * 60
NEWEST_SAMPLE = 200

COLUMNS_SCHEMA = "table_name string, ordinal int, column_name string, type string"


def schema_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, ordinal, column, type) of every table, from metadata alone."""
    spark = next(iter(tables.values())).sparkSession
    found = [
        (name, i, field.name, field.dataType.simpleString())
        for name, df in tables.items()
        for i, field in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(found, COLUMNS_SCHEMA)


def schema_fingerprint(columns: DataFrame, mask_widths: DataFrame | None = None) -> DataFrame:
    """A hash of the structure: equal whenever tables, columns, order and types
    (and the widths of the channel mask, when given) are equal."""
    line = F.concat_ws("\x1f", "table_name", F.lpad(F.col("ordinal").cast("string"), 6, "0"), "column_name", "type")
    lines = columns.select(line.alias("line"))
    if mask_widths is not None:
        lines = lines.unionByName(
            mask_widths.select(F.concat(F.lit("mask\x1f"), F.col("mask_bits").cast("string")).alias("line"))
        )
    ordered = F.array_join(F.sort_array(F.collect_list("line")), "\n")
    return lines.agg(
        F.count("*").alias("lines"), F.sha2(ordered, 256).alias("fingerprint_sha256")
    )


def schema_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(status, table_name, column_name, detail) for each change.

    A removal, a type change or a new order of the kept columns fails: it
    changes what a written file holds. An addition warns.
    """
    b, c = _with_table_flags(baseline, "b"), _with_table_flags(current, "c")
    both = b.join(c, ["table_name", "column_name"], "full_outer")
    b_tables = baseline.select("table_name").distinct().withColumn("in_b", F.lit(True))
    c_tables = current.groupBy("table_name").agg(F.count("*").alias("c_size"))
    both = both.join(b_tables, "table_name", "left").join(c_tables, "table_name", "left")
    kept_table = F.col("in_b") & F.col("c_size").isNotNull()
    name = F.concat_ws(".", "table_name", "column_name")
    column_changes = both.filter(kept_table).select(
        F.when(F.col("c_type").isNull(), "fail").when(F.col("b_type").isNull(), "warn").otherwise("fail").alias("status"),
        "table_name",
        "column_name",
        F.when(F.col("c_type").isNull(), F.concat(name, F.lit(" was removed")))
        .when(
            F.col("b_type").isNull(),
            F.concat(name, F.lit(" was added at column "), F.col("c_ordinal"), F.lit(" of "), F.col("c_size")),
        )
        .when(
            F.col("b_type") != F.col("c_type"),
            F.concat(name, F.lit(": type was "), F.col("b_type"), F.lit(", now "), F.col("c_type")),
        )
        .alias("detail"),
    )
    in_both = both.filter(F.col("b_type").isNotNull() & F.col("c_type").isNotNull())
    per_table = Window.partitionBy("table_name")
    moved = (
        in_both.withColumn("b_place", F.row_number().over(per_table.orderBy("b_ordinal")))
        .withColumn("c_place", F.row_number().over(per_table.orderBy("c_ordinal")))
        .filter(F.col("b_place") != F.col("c_place"))
        .select("table_name")
        .distinct()
        .select(
            F.lit("fail").alias("status"),
            "table_name",
            F.lit(None).cast("string").alias("column_name"),
            F.concat("table_name", F.lit(": the column order changed")).alias("detail"),
        )
    )
    gone = F.col("c_size").isNull()
    whole = (
        b_tables.join(c_tables, "table_name", "full_outer")
        .filter(gone | F.col("in_b").isNull())
        .select(
            F.when(gone, "fail").otherwise("warn").alias("status"),
            "table_name",
            F.lit(None).cast("string").alias("column_name"),
            F.concat(F.lit("table "), "table_name", F.when(gone, F.lit(" is gone")).otherwise(F.lit(" is new"))).alias("detail"),
        )
    )
    changes = column_changes.filter(F.col("detail").isNotNull()).unionByName(moved).unionByName(whole)
    return changes.withColumn("detail", clean_text(F.col("detail")))


def _with_table_flags(columns: DataFrame, side: str) -> DataFrame:
    return columns.select(
        "table_name", "column_name", F.col("ordinal").alias(f"{side}_ordinal"), F.col("type").alias(f"{side}_type")
    )


def newest_sample(cot: DataFrame, rows: int = NEWEST_SAMPLE) -> DataFrame:
    """The newest rows that carry a channel mask; a top-k, never a full sort."""
    return cot.filter(F.col("groups").isNotNull()).orderBy(F.desc("servertime"), F.desc("id")).limit(rows)


def decode_health(cot: DataFrame, channels: DataFrame, decoder: ChannelDecoder) -> DataFrame:
    """Whether masks still decode to channels and details still yield callsigns."""
    sample = decoder.add(newest_sample(cot), numbers=False).select(
        "channels", detail_attribute("callsign").alias("callsign")
    )
    seen = sample.agg(
        F.count("*").alias("seen"), F.count("channels").alias("decoded"), F.count("callsign").alias("callsigns")
    )
    defined = channels.agg(F.count("*").alias("defined"))
    counts = ("seen", "decoded", "callsigns", "defined")
    joined = seen.unionByName(defined, allowMissingColumns=True).agg(
        *[F.sum(c).alias(c) for c in counts]
    )
    return joined.select(
        "seen", "decoded", "callsigns", "defined",
        F.when(F.col("seen") == 0, "skip")
        .when(F.col("defined") == 0, "warn")
        .when(F.col("decoded") > 0, "ok")
        .otherwise("fail")
        .alias("channels_status"),
        F.when((F.col("seen") == 0) | (F.col("defined") == 0), "skip")
        .when(F.col("callsigns") > 0, "ok")
        .otherwise("warn")
        .alias("callsigns_status"),
    )


def liveness(
    cot: DataFrame, as_of: str, previous_max: str | None = None, previous_checked_utc: str | None = None
) -> DataFrame:
    """Whether the source is still writing, against what the last check saw.

    Nothing new within half an hour of the last check says nothing; a previous
    time that cannot be read counts as long ago.
    """
    bounds = cot.agg(F.min("servertime").alias("oldest"), F.max("servertime").alias("newest"))
    now = F.lit(as_of).cast("timestamp")
    previous = F.lit(previous_max).cast("timestamp")
    checked = F.try_to_timestamp(F.lit(previous_checked_utc), F.lit("yyyy-MM-dd HH:mm:ss'Z'"))
    gap = F.unix_seconds(now) - F.unix_seconds(checked)
    status = (
        F.when(F.col("newest").isNull(), "warn")
        .when(previous.isNull(), "ok")
        .when(F.col("newest") != previous, "ok")
        .when(F.coalesce(gap < LIVENESS_MIN_GAP_SECONDS, F.lit(False)), "ok")
        .otherwise("warn")
    )
    return bounds.select(
        "oldest", "newest", (F.unix_seconds(now) - F.unix_seconds("newest")).alias("age_seconds"), status.alias("status")
    )


def worst_status(status: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for pair in STATUS_RANK.items() for x in pair])
    return F.coalesce(F.max_by(status, rank[status]), F.lit("ok"))


def check_summary(items: DataFrame) -> DataFrame:
    """How many checks ended in each status, and the worst of them."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUS_RANK]
    return items.agg(*counts, worst_status(F.col("status")).alias("verdict"))


def combine_items(items: dict[str, DataFrame]) -> DataFrame:
    """Single-row checks with a ``status`` column as one list of (item, status)."""
    return reduce(
        DataFrame.unionByName,
        [df.select(F.lit(name).alias("item"), F.col("status")) for name, df in items.items()],
    )

"""Scans of the server's tables, from columnar files or over JDBC."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from posevidence.params import ExportParams

# The tables a reader is granted, and those the census counts.
GRANTED_TABLES = (
    "cot_router", "cot_router_chat", "cot_image", "cot_link", "cot_thumbnail",
    "groups", "client_endpoint", "client_endpoint_event", "connection_event_type",
    "mission", "mission_change", "mission_subscription", "mission_uid",
    "mission_resource", "mission_external_data", "mission_log", "mission_invitation",
    "resource", "video_connections", "video_connections_v2",
    "data_feed", "data_feed_cot", "data_feed_type_pl",
    "fed_event", "fed_event_kind_pl", "properties_uid",
)
CENSUS_TABLES = {
    "cot_image": "attached images",
    "cot_link": "event links",
    "cot_thumbnail": "thumbnails",
    "mission_uid": "mission map items",
    "mission_log": "mission logs",
    "mission_resource": "mission files",
    "mission_external_data": "mission external data",
    "mission_invitation": "mission invitations",
    "fed_event": "federation records",
    "properties_uid": "properties",
    "video_connections": "video connections",
    "video_connections_v2": "video connections (v2)",
    "data_feed": "configured data feeds",
    "data_feed_cot": "feed linkage",
    "groups": "channels defined",
}

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("uid", T.StringType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("servertime", T.TimestampType()),
        T.StructField("start", T.TimestampType()),
        T.StructField("stale", T.TimestampType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("point_ce", T.DoubleType()),
        T.StructField("point_hae", T.DoubleType()),
        T.StructField("point_le", T.DoubleType()),
        T.StructField("how", T.StringType()),
        T.StructField("cot_type", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("groups", T.StringType()),
        T.StructField("access", T.StringType()),
        T.StructField("opex", T.StringType()),
        T.StructField("caveat", T.StringType()),
        T.StructField("releaseableto", T.StringType()),
    ]
)


def with_instants(schema: T.StructType) -> T.StructType:
    """The same schema with zone-free timestamps read as instants.

    Naming the type at the scan, not casting after it, keeps comparisons on
    the column itself so that they reach the file reader.
    """
    return T.StructType(
        [
            T.StructField(
                f.name,
                T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType,
                f.nullable,
            )
            for f in schema.fields
        ]
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.parquet(path)
    wanted = with_instants(found.schema)
    return found if wanted == found.schema else spark.read.schema(wanted).parquet(path)


def read_tables(spark: SparkSession, directory: str, names=GRANTED_TABLES) -> dict[str, DataFrame]:
    """One lazy scan per table; a table is a file or a directory of files."""
    return {name: read_table(spark, os.path.join(directory, f"{name}.parquet")) for name in names}


def read_jdbc_window(
    spark: SparkSession,
    url: str,
    table: str,
    params: ExportParams,
    bounds: tuple[int, int],
    partitions: int,
    time_column: str = "servertime",
    id_column: str = "id",
    options: dict[str, str] | None = None,
) -> DataFrame:
    """A live table read in parallel slices of its id, window pushed to the source."""
    low, high = bounds
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", id_column)
        .option("lowerBound", str(low))
        .option("upperBound", str(high))
        .option("numPartitions", str(partitions))
        .option("fetchsize", "10000")
        .options(**(options or {}))
    )
    from posevidence.functions.predicates import in_window

    return reader.load().filter(in_window(time_column, params))


def write_events(events: DataFrame, path: str) -> None:
    """Lay events out for windowed extracts: by day, then by device and time."""
    from pyspark.sql import functions as F

    (
        events.withColumn("servertime_date", F.to_date("servertime"))
        .repartitionByRange("servertime_date", "uid", "servertime")
        .sortWithinPartitions("servertime_date", "uid", "servertime")
        .write.partitionBy("servertime_date")
        .parquet(path)
    )

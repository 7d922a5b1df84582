"""Intermediates kept in storage that outlives executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where the
    session has none and one machine does all the work, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="posevidence-")
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there.

    Used where several branches of a plan read the same expensive input, and
    between rounds of an iteration, where it also cuts the lineage and gives the
    next round the size of what was written instead of a guess. What was
    shuffled for it is gone from the disks once it is written.
    """
    path = new_folder(df.sparkSession, "settled")
    write_once(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Lets Spark remove the shuffle files of a plan where it ends, not when the
#: driver's memory is next collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_once(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name for a written table or a stream's progress."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"

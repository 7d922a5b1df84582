"""Writers: guarded CSV, delimited lines, hash lists and the run manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posevidence.functions.text import guard_row
from posevidence.operators.compare import delimited_line
from posevidence.sources.files import read_package_members


def _flat(df: DataFrame) -> DataFrame:
    """Arrays of text joined by spaces, as a CSV cell holds them."""
    return df.select(
        *[
            F.array_join(F.col(f"`{n}`"), " ").alias(n) if kind == "array<string>" else F.col(f"`{n}`")
            for n, kind in df.dtypes
        ]
    )


def write_guarded_csv(df: DataFrame, path: str, guard: bool = True) -> None:
    """One result as a directory of CSV files with a header row each."""
    rows = guard_row(_flat(df)) if guard else _flat(df)
    (
        rows.write.option("header", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")
        .csv(path)
    )


def write_delimited(df: DataFrame, path: str) -> None:
    """One result as psql-style lines: minimal quoting, NULL and '' both empty.

    Rows keep the order they come in; the header is a file of its own, so that
    the parts of a large result can be joined behind it.
    """
    header = df.sparkSession.createDataFrame([(",".join(df.columns),)], "line string")
    header.coalesce(1).write.text(f"{path}/header")
    df.select(delimited_line(df).alias("line")).write.text(f"{path}/rows")


def write_hash_list(spark: SparkSession, package_path: str, list_path: str) -> DataFrame:
    """A checksum list of every data file under a package, sorted by name."""
    members = read_package_members(spark, package_path)
    kept = members.filter(~F.col("name").startswith("_") & ~F.col("name").startswith("."))
    named = kept.select(
        F.concat_ws("/", "package", "name").alias("name"), "sha256"
    ).orderBy("name")
    named.select(F.concat("sha256", F.lit("  "), "name").alias("line")).coalesce(1).write.text(list_path)
    return named


def run_manifest(
    spark: SparkSession,
    counts: dict[str, int],
    failures: dict[str, str],
    files_excluded: list[str],
    channels_state: str,
    channels_excluded: list[str] | None,
) -> DataFrame:
    """One row on a run: what was written, what failed, what was left out."""
    schema = (
        "counts map<string,bigint>, failures map<string,string>, files_excluded array<string>, "
        "channels_state string, channels_excluded array<string>"
    )
    return spark.createDataFrame(
        [(counts, failures, sorted(files_excluded), channels_state, channels_excluded)], schema
    )

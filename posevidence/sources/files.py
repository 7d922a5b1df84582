"""File sources: hash lists, unpacked packages, and track files."""

from __future__ import annotations

import io
import sys
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The readers travel inside the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: a checksum line.
SUM_LINE = r"^([0-9a-f]{64}) [ *](\S+)$"


def read_hash_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Checksum lists: (file, line_no, name, sha256), and (file, state) per file.

    Blank lines are skipped, names lose their folders and of equal names the
    later line counts. One line that is not a checksum line rejects its file,
    as does a list without lines. Lists are read line by line, whatever their
    length; ``line_no`` orders the lines of a file. Spark passes over files of
    no bytes, so they have no state.
    """
    file = F.col("_metadata.file_path").alias("file")
    # Names of the files only; no content is read here.
    whole = spark.read.format("binaryFile").load(path).select(file)
    lines = (
        spark.read.text(path)
        .select(
            file,
            F.struct(
                F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
            ).alias("line_no"),
            F.trim("value").alias("line"),
        )
        .filter(F.col("line") != "")
        .withColumn("good", F.col("line").rlike(SUM_LINE))
    )
    per_file = lines.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(~F.col("good")).alias("bad"))
    states = whole.join(per_file, "file", "left").select(
        "file",
        F.when(F.col("lines").isNull(), "empty")
        .when(F.col("bad") > 0, "not a checksum list")
        .otherwise("read")
        .alias("state"),
    )
    accepted = states.filter(F.col("state") == "read").select("file")
    named = lines.filter("good").select(
        "file",
        "line_no",
        F.substring_index(F.regexp_extract("line", SUM_LINE, 2), "/", -1).alias("name"),
        F.regexp_extract("line", SUM_LINE, 1).alias("sha256"),
    )
    last = named.groupBy("file", "name").agg(
        F.max("line_no").alias("line_no"), F.max_by("sha256", "line_no").alias("sha256")
    )
    return last.join(accepted, "file", "left_semi"), states


def read_package_members(spark: SparkSession, path: str) -> DataFrame:
    """(package, name, sha256, size) of the files under package folders.

    The folder a file lies in is its package. Contents are hashed where they
    are read and never leave the task.
    """
    parts = F.split(F.col("path"), "/")
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(
            F.element_at(parts, -2).alias("package"),
            F.element_at(parts, -1).alias("name"),
            F.sha2("content", 256).alias("sha256"),
            F.col("length").alias("size"),
        )
    )


TRACK_SCHEMA = (
    "file string, device string, label string, servertime timestamp, "
    "latitude double, longitude double, untimed bigint, error string"
)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _instant(text: str | None) -> datetime | None:
    try:
        read = datetime.fromisoformat((text or "").strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return read if read.tzinfo else read.replace(tzinfo=timezone.utc)


def _place(text: str | None, separator: str | None) -> tuple[float, float] | None:
    """(lat, lon) of "lon lat ..." text; commas or spaces between."""
    parts = (text or "").strip().split(separator)
    try:
        return float(parts[1]), float(parts[0])
    except (IndexError, ValueError):
        return None


def _timed_points(placemark: ET.Element) -> Iterator[tuple[datetime, tuple[float, float]]]:
    """A placemark's points that carry a time: tracks, then a stamped point."""
    for track in (e for e in placemark.iter() if _local(e.tag) == "Track"):
        whens = [_instant(e.text) for e in track if _local(e.tag) == "when"]
        coords = [_place(e.text, None) for e in track if _local(e.tag) == "coord"]
        yield from ((w, c) for w, c in zip(whens, coords) if w and c)
    inner = {_local(e.tag): e for e in placemark}
    if "TimeStamp" in inner and "Point" in inner:
        stamp = next((_instant(e.text) for e in inner["TimeStamp"] if _local(e.tag) == "when"), None)
        spot = next((_place(e.text, ",") for e in inner["Point"] if _local(e.tag) == "coordinates"), None)
        if stamp and spot:
            yield stamp, spot


def _documents(content: bytes) -> Iterator[bytes]:
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            yield from (archive.read(n) for n in sorted(archive.namelist()) if n.lower().endswith(".kml"))
    else:
        yield content


def read_track_bytes(content: bytes) -> tuple[list[tuple], int]:
    """((device, label, time, lat, lon) rows, placemarks without a timed point)."""
    rows: list[tuple] = []
    untimed = 0
    for document in _documents(content):
        for _, element in ET.iterparse(io.BytesIO(document)):
            if _local(element.tag) != "Placemark":
                continue
            name = next((e.text for e in element if _local(e.tag) == "name"), None)
            points = list(_timed_points(element))
            untimed += not points
            device = element.get("id") or name
            rows += [(device, name or device, when, lat, lon) for when, (lat, lon) in points]
            element.clear()
    return rows, untimed


def _read_tracks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file", "device", "label", "servertime", "latitude", "longitude", "untimed", "error"]
    for batch in batches:
        out = []
        for path, content in zip(batch["path"], batch["content"]):
            try:
                rows, untimed = read_track_bytes(content)
            except (ET.ParseError, zipfile.BadZipFile) as e:
                out.append((path, None, None, None, None, None, None, type(e).__name__))
                continue
            out += [(path, *row, None, None) for row in rows]
            out.append((path, None, None, None, None, None, untimed, None))
        frame = pd.DataFrame(out, columns=columns)
        frame["servertime"] = pd.to_datetime(frame["servertime"], utc=True)
        frame["untimed"] = frame["untimed"].astype("Int64")
        yield frame


def read_track_kml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Timed positions of KML and KMZ files, and a row of notes per file.

    Many files are read in parallel, each by one task. A placemark without a
    timed point is counted, not dropped silently; a file that cannot be read is
    named with its error.
    """
    read = (
        spark.read.format("binaryFile")
        .load(path)
        .select("path", "content")
        .mapInPandas(_read_tracks, TRACK_SCHEMA)
    )
    points = read.filter(F.col("servertime").isNotNull()).drop("untimed", "error")
    notes = read.filter(F.col("servertime").isNull()).select("file", "untimed", "error")
    return points, notes

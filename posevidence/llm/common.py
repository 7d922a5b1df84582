"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posevidence.materialize import new_folder, write_once

# Fixed value: what separates words.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SEPARATORS = "[ \\t\\n\\x0B\\f\\r]+"


def importable(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package from where
    the driver has it; where it is installed on the workers this adds nothing."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the session's shared folder and read from there.
    What was shuffled for it is gone from the disks once it is written."""
    path = new_folder(df.sparkSession, purpose)
    write_once(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(column: Column, folds: int) -> Column:
    """crc32 of the decimal id modulo ``folds``; NULL ids count as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % folds


def strings(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, places, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


_kept: dict[str, dict] = {}


def kept_by(operator: str) -> dict:
    """What ``operator`` keeps in this worker process from task to task. What
    others kept goes: a process lives through the stages of many operators."""
    if _kept.keys() - {operator}:
        for other in _kept.keys() - {operator}:
            del _kept[other]
        gc.collect()  # what refers to itself too
    return _kept.setdefault(operator, {})


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one portion hold about ``most`` bytes;
    a longer single text is a portion of its own. Operators that cut portions
    keep nothing here."""
    kept_by("")
    for batch in batches:
        lengths = np.nan_to_num(
            pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ).astype(np.int64)
        group = (np.cumsum(lengths) - lengths) // most
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240131).integers(1, 1 << 63, 512, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit name of each ordered pair of 64-bit names."""
    return mix(left * _MIX + mix(right))


def byte_names(data: np.ndarray) -> np.ndarray:
    """A 64-bit name of each byte value, or of a code up to 511."""
    return _BYTES[data]


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every word, and the number of words before each text."""
    inside = ~_SEPARATOR[data]
    first = inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        edges = at[(at < len(data))]
        first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside.copy()
    if len(data):
        last[:-1] &= ~inside[1:]
        edges = at[(at > 0)] - 1
        last[edges] = inside[edges]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit name of every word from its bytes and their places."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    codes = _LOWER[data] if lower else data
    place = np.arange(len(data)) - np.repeat(
        np.r_[0, starts], np.diff(np.r_[0, starts, len(data)])
    )
    deep = place >= 64
    weights = _POWERS[place & 63]
    if deep.any():
        weights = np.where(deep, mix(weights + place.astype(np.uint64) // np.uint64(64)) | np.uint64(1), weights)
    value = _BYTES[codes] * weights
    value[_SEPARATOR[data]] = 0
    return mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))

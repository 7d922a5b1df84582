"""Removal of byte strings that stand earlier in the corpus.

Every byte covered by a string of ``length`` bytes that also starts earlier, in
a document with a smaller id or in the same one, is removed; strings are judged
on the texts as given. Equal strings are found by bucket-pointer refinement of
their suffixes: suffixes in a bucket of equal 32 bytes are sorted on the bucket
pointers of later offsets, and refined pointers are looked up in the next
round. Only suffixes at chosen places start buckets across the cluster: of all
32-byte strings within a window, the one with the least name is chosen, so equal
windows meet in one bucket.

NULL and empty texts have no bytes; a text shorter than ``length`` keeps all.
Rows with equal ids count as one document: the same place is not earlier than
itself, so repeated rows keep their bytes. A row without an id is kept whole.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posevidence.llm.common import _BYTES, portions, stored, text_bytes
from posevidence.llm.repeats import (
    ANCHOR_SCHEMA, BLOCK, CONTEXT_SCHEMA, Windows, chosen, compared, context_rows, doubled, settled_and_open, span_names,
    spans_by_document, spread, union_mask,
)

GRAM = 32
_PAD = 256


def _levels(codes: np.ndarray, most: int) -> dict[int, np.ndarray]:
    levels, size, step = {1: _BYTES[codes]}, 1, 0
    while size < most:
        levels[2 * size] = doubled(levels[size], size, step)
        size, step = 2 * size, step + 1
    return levels


def _anchors(length: int):
    reach = length - GRAM
    context = length + reach

    def find(batches):
        for batch in portions(batches, "text", 1 << 19):
            data, at = text_bytes(batch.column(1))
            sizes = np.diff(at)
            long = np.flatnonzero(sizes >= length)
            if not len(long):
                continue
            # Texts stand apart by a context's width of a code that no byte has.
            offsets = context + np.concatenate([[0], np.cumsum(sizes[long] + context)])
            codes = np.full(offsets[-1], _PAD, np.uint16)
            window = np.zeros(offsets[-1], bool)
            for k, place in zip(long, offsets):
                codes[place : place + sizes[k]] = data[at[k] : at[k + 1]]
                window[place : place + sizes[k] - length + 1] = True
            levels = _levels(codes, 64)
            names = spread(levels[GRAM])
            places = chosen(names, reach + 1, window)
            owner = np.searchsorted(offsets, places, "right") - 1
            whole = span_names(levels, places - reach, context)
            ids = batch.column(0).to_numpy()[long][owner]
            yield pa.record_batch(
                [pa.array(names[places].view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids),
                 pa.array((places - reach - offsets[owner]).astype(np.int32))],
                ["near", "whole", "doc_id", "at"],
            )

    return find


def _byte_units(units: np.ndarray) -> np.ndarray:
    return _BYTES[units]


def _contexts(windows: Windows):
    def fetch(batches):
        for batch in batches:
            for doc, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(3))):
                yield context_rows(doc, np.frombuffer((text or "").encode("utf-8"), np.uint8), wanted, windows)

    return fetch


def without_repeats(
    docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK,
    whole_characters: bool = False, carried: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, *carried): the bytes that
    stay, one row for each row of ``docs``. With ``whole_characters`` a
    character stays if one of its bytes does, so what is kept is text."""
    windows = Windows(length, length - GRAM + 1, GRAM, "place", _byte_units, "u1")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
        F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carried)]).alias("rest"),
    )
    known = rows.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    anchors = known.mapInArrow(_anchors(length), ANCHOR_SCHEMA)
    found = stored(settled_and_open(anchors, windows), "anchors")
    wanted = (
        found.filter(~F.col("settled"))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("at", "near")).alias("wanted"))
    )
    contexts = known.join(wanted, "doc_id").mapInArrow(_contexts(windows), CONTEXT_SCHEMA)
    contexts = stored(contexts, "contexts")
    spans = spans_by_document(found.filter("settled"), compared(contexts, windows, block), windows)

    def cut(batches):
        for batch in batches:
            out = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
                gone = union_mask(own, len(raw))
                if whole_characters and gone.any():
                    head = np.flatnonzero((raw & 0xC0) != 0x80)
                    gone = np.repeat(np.logical_and.reduceat(gone, head), np.diff(np.r_[head, len(raw)]))
                starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(raw) else 0
                out.append((raw[~gone].tobytes(), len(raw), int(gone.sum()), starts))
            kept, size, removed, runs = zip(*out) if out else ((), (), (), ())
            yield pa.record_batch(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array(size, pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), batch.column(2)],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "rest"],
            )

    rest = rows.schema["rest"].dataType.simpleString()
    found = rows.join(spans, "doc_id", "left").select("doc_id", "text", "rest", "spans").mapInArrow(
        cut, f"doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, rest {rest}"
    )
    return found.select(
        "doc_id", "kept", "n_bytes", "n_removed", "n_spans", *[F.col(f"rest.c{k}").alias(c) for k, c in enumerate(carried)]
    )

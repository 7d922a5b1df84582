"""Removal of long word passages that stand in an earlier document.

Every word covered by a window of ``length`` words that also starts in a
document with a smaller id is removed; windows are judged on the texts as given.

The words of a text are recompressed: a round first names runs of one symbol,
then pairs of neighbours whose names fall to the left and right half of that
round's coin. A name is a digest of what it stands for, so a symbol has the same
name in every document and task without a shared dictionary. Symbols grow to
two, then to four words at most; whether two neighbours are joined depends on
few words around them, so equal passages are parsed alike but for ``EDGE`` words
at either end. The boundaries of the highest symbols inside a window are its
candidates; the one with the least name of its surroundings stands for the
window (see ``repeats``), and equal windows are verified from there.

NULL and empty texts have no words. Rows with equal ids are one document, which
never makes itself shorter. A row without an id is kept whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posevidence.llm.common import WORD, pair_hash, portions, stored, text_bytes, word_names, word_spans
from posevidence.llm.repeats import (
    ANCHOR_SCHEMA, BLOCK, CONTEXT_SCHEMA, Windows, chosen, compared, context_rows, doubled, settled_and_open,
    span_names, spans_by_document, spread, union_mask,
)

#: Most words of a symbol after each round.
LIMITS = (2, 4)
#: Words at either end of a window whose parse may depend on what is outside:
#: a round looks past a run of its limit and at one symbol beyond it.
EDGE = sum(2 * limit + 1 for limit in LIMITS)
_FIRST_DEPTH = 16


def highest_symbols(names: np.ndarray, text: np.ndarray) -> np.ndarray:
    """First words of the symbols left after all rounds.

    ``names`` are word names and ``text`` the number of each word's text;
    symbols never reach into another text.
    """
    first = np.arange(len(names))
    symbol = names.copy()
    weight = np.ones(len(names), np.int64)
    for level, limit in enumerate(LIMITS):
        if len(symbol) < 2:
            break
        # Runs of one symbol, named by symbol and number, where they fit.
        new_run = np.r_[True, (symbol[1:] != symbol[:-1]) | (text[1:] != text[:-1])]
        starts = np.flatnonzero(new_run)
        count = np.diff(np.r_[starts, len(symbol)])
        fits = (count > 1) & (count * weight[starts] <= limit)
        run = np.cumsum(new_run) - 1
        keep = new_run | ~fits[run]
        joined = starts[fits]
        symbol[joined] = pair_hash(symbol[joined], count[fits].astype(np.uint64))
        weight[joined] *= count[fits]
        symbol, weight, first, text = symbol[keep], weight[keep], first[keep], text[keep]
        # Pairs of a left and a right symbol.
        coin = (symbol >> np.uint64(17 + level)) & np.uint64(1) == 0
        pair = np.r_[
            coin[:-1] & ~coin[1:] & (text[1:] == text[:-1]) & (weight[1:] + weight[:-1] <= limit), False
        ]
        left = np.flatnonzero(pair)
        symbol[left] = pair_hash(symbol[left], symbol[left + 1])
        weight[left] += weight[left + 1]
        keep = np.ones(len(symbol), bool)
        keep[left + 1] = False
        symbol, weight, first, text = symbol[keep], weight[keep], first[keep], text[keep]
    return first


def _levels(names: np.ndarray) -> dict[int, np.ndarray]:
    levels, size, step = {1: names}, 1, 0
    while size < 32:
        levels[2 * size] = doubled(levels[size], size, step)
        size, step = 2 * size, step + 1
    return levels


def _anchors(windows: Windows):
    length, count, context = windows.length, windows.count, windows.context

    def find(batches):
        for batch in portions(batches, "text", 1 << 20):
            data, at = text_bytes(batch.column(1))
            starts, ends, before = word_spans(data, at)
            names = word_names(data, starts, ends)
            sizes = np.diff(before)
            long = np.flatnonzero(sizes >= length)
            if not len(long):
                continue
            number = np.repeat(np.arange(len(sizes)), sizes)
            boundary = np.zeros(len(names), bool)
            boundary[highest_symbols(names, number)] = True
            offsets = context + np.concatenate([[0], np.cumsum(sizes[long] + context)])
            padded = np.full(offsets[-1], 1, np.uint64)
            candidate = np.zeros(offsets[-1], bool)
            window = np.zeros(offsets[-1], bool)
            for k, place in zip(long, offsets):
                own = slice(place, place + sizes[k])
                padded[own] = names[before[k] : before[k + 1]]
                candidate[own] = boundary[before[k] : before[k + 1]]
                # Candidates of the window at i start EDGE words into it.
                window[place + EDGE : place + EDGE + sizes[k] - length + 1] = True
            levels = _levels(padded)
            around = np.full(offsets[-1], np.iinfo(np.uint64).max)
            inner = np.flatnonzero(candidate)
            around[inner] = span_names(levels, inner - EDGE, 2 * EDGE) >> np.uint64(1)
            places = chosen(around, count, window)
            owner = np.searchsorted(offsets, places, "right") - 1
            left = places - EDGE - count + 1
            whole = span_names(levels, left, context)
            ids = batch.column(0).to_numpy()[long][owner]
            yield pa.record_batch(
                [pa.array(around[places].view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids),
                 pa.array((left - offsets[owner]).astype(np.int32))],
                ["near", "whole", "doc_id", "at"],
            )

    return find


def _word_units(units: np.ndarray) -> np.ndarray:
    return units


def _contexts(windows: Windows):
    def fetch(batches):
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            starts, ends, before = word_spans(data, at)
            names = word_names(data, starts, ends)
            for k, (doc, wanted) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                yield context_rows(doc, names[before[k] : before[k + 1]], wanted, windows)

    return fetch


def without_passages(
    docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """(doc_id, kept, n_words, n_removed): the words that stay, joined by one
    space, one row for each row of ``docs``."""
    count = length - 2 * EDGE
    if count < max(LIMITS):
        raise ValueError(f"windows take {2 * EDGE + max(LIMITS)} words at least")
    windows = Windows(length, count, _FIRST_DEPTH, "document", _word_units, "<u8")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = rows.filter(F.col("doc_id").isNotNull())
    found = stored(settled_and_open(known.mapInArrow(_anchors(windows), ANCHOR_SCHEMA), windows), "anchors")
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
            kept, size, removed = [], [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = WORD.findall(text or "")
                gone = union_mask(own, len(words))
                n = int(gone.sum())
                kept.append(" ".join(w for w, g in zip(words, gone.tolist()) if not g) if n else " ".join(words))
                size.append(len(words))
                removed.append(n)
            yield pa.record_batch(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(size, pa.int64()), pa.array(removed, pa.int64())],
                ["doc_id", "kept", "n_words", "n_removed"],
            )

    return rows.join(spans, "doc_id", "left").mapInArrow(
        cut, "doc_id long, kept string, n_words long, n_removed long"
    )

"""Long strings that occur more than once, found by shared anchors.

A text is a row of units, bytes or words. Both callers choose places in it,
anchors, by what surrounds them: every window of the looked-for length holds
one, and equal windows hold it at the same place. An anchor stands with its
context, all units of all windows that may have chosen it.

1. Anchors are dealt out by a name of their nearest units and sorted by a name
   of their whole context. Where the same context stands earlier, all its
   windows do; this settles copies, however many, in one pass over sorted rows
   that remembers one context.
2. What is left are contexts that differ though their nearest units agree. Only
   these are fetched, once each, and their windows compared.

Contexts with one nearest name are compared in one task as long as there are
few. Where there are more, a round deals each context out twice, for either half
of its windows, by the longer strings that all windows of a half share. There
the first step is done again: of halves that are equal as a whole the first goes
on, and only if its name has others. Rounds go on while a name has many, at the
most until a half is one window, which is then its own name. So a context makes
two rows in a round, and no name's contexts need to meet in one task.

Names are 64-bit digests; two agree by chance only where both the nearest name,
by which rows are dealt out, and the second name do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posevidence.llm.common import stored

#: Contexts compared at once in one task.
BLOCK = 4096

_STEPS = np.random.default_rng(7).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def doubled(names: np.ndarray, length: int, step: int) -> np.ndarray:
    """Names of the 2 * length units from each place, from those of length units."""
    out = names[..., : names.shape[-1] - length] * _STEPS[step]
    out += names[..., length:]
    out ^= out >> np.uint64(29)
    out *= _STEPS[step + 8]
    return out


def depth_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Names of ``depth`` units, a power of two, from those of single units."""
    length, step = 1, 0
    while length < depth:
        names, length, step = doubled(names, length, step), 2 * length, step + 1
    return spread(names)


def spread(names: np.ndarray) -> np.ndarray:
    names = names ^ (names >> np.uint64(31))
    names = names * np.uint64(0x9FB21C651E98DF25)
    return names ^ (names >> np.uint64(28))


def span_names(levels: dict[int, np.ndarray], starts: np.ndarray, length: int) -> np.ndarray:
    """Names of ``length`` units from each start, put together from powers of two."""
    out, at = np.zeros(len(starts), np.uint64), starts
    for size in sorted(levels, reverse=True):
        while length >= size:
            out = spread(out * _STEPS[3] + levels[size][at])
            at = at + size
            length -= size
    return out


def sliding(values: np.ndarray, width: int, better) -> np.ndarray:
    """The best value among ``width`` from each place on."""
    out, size = values, 1
    while size * 2 <= width:
        out = better(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return better(out[:-rest], out[rest:]) if rest else out


def chosen(scores: np.ndarray, width: int, window: np.ndarray) -> np.ndarray:
    """Places whose score is the least of a window's ``width`` candidates.

    ``window[i]`` tells whether the candidates from i on are those of a window.
    """
    least = sliding(scores, width, np.minimum)
    least = np.where(window[: len(least)], least, np.uint64(0))
    # A place is chosen if some window over it has no lower score.
    wide = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    highest = sliding(wide, width, np.maximum)[: len(scores)]
    return np.flatnonzero((highest == scores[: len(highest)]) & (scores[: len(highest)] != np.iinfo(np.uint64).max))


@dataclass(frozen=True)
class Windows:
    """``length`` units a window, ``count`` windows in a context. ``earlier``
    takes "place" (an earlier place of any document) or "document" (only a
    place in a document with a smaller id). ``unit_names`` gives 64-bit names
    of units that are kept as ``unit_type``."""

    length: int
    count: int
    first_depth: int
    earlier: str
    unit_names: Callable[[np.ndarray], np.ndarray]
    unit_type: str

    @property
    def context(self) -> int:
        return self.length + self.count - 1


ANCHOR_SCHEMA = "near long, whole long, doc_id long, at int"


def settled_and_open(anchors: DataFrame, windows: Windows) -> DataFrame:
    """The rows of contexts that stand earlier as a whole, which are ``settled``,
    and of the first of each context whose nearest units have another context too.

    ``anchors``: (near, whole, doc_id, at), and columns that are taken along.
    """
    by_place = windows.earlier == "place"

    def walk(batches):
        carried, known_before = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            held = 0
            if carried is not None:
                held = carried.num_rows
                batch = pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
            near, whole, doc, at = (batch.column(k).to_numpy() for k in range(4))
            new_near = np.r_[True, near[1:] != near[:-1]]
            new_class = new_near | np.r_[True, whole[1:] != whole[:-1]]
            starts = np.flatnonzero(new_class)
            row_class = np.cumsum(new_class) - 1
            first = starts[row_class]
            is_first = doc == doc[first]
            if by_place:
                is_first &= at == at[first]
            near_of = near[starts]
            after = np.r_[near_of[1:] == near_of[:-1], False]
            before = np.r_[known_before, near_of[1:] == near_of[:-1]]
            several = before | after
            last = row_class == len(starts) - 1
            opened = is_first & several[row_class] & ~last
            covered = ~is_first
            covered[:held] = False
            keep = np.flatnonzero(opened | covered)
            if len(keep):
                yield _marked(batch.take(pa.array(keep)), covered[keep])
            carried = batch.take(pa.array(np.flatnonzero(is_first & last)))
            known_before = bool(before[-1])
        if carried is not None and known_before:
            yield _marked(carried, np.zeros(carried.num_rows, bool))

    columns = [f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema]
    return (
        anchors.repartition("near")
        .sortWithinPartitions("near", "whole", "doc_id", "at")
        .mapInArrow(walk, ", ".join([*columns, "settled boolean"]))
        .drop("whole")
    )


def _marked(rows: pa.RecordBatch, settled: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(settled)], [*rows.schema.names, "settled"])


CONTEXT_SCHEMA = "near long, doc_id long, at int, n_units int, units binary"


def compared(contexts: DataFrame, windows: Windows, block: int = BLOCK) -> DataFrame:
    """(doc_id, first, last): spans of windows that stand earlier, from open contexts.

    ``units`` holds the units of a context, zero outside its document.
    """
    def refine(batches):
        held, size, last = [], 0, None
        for batch in batches:
            near = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, near[1:] != near[:-1]]) if len(near) else []
            start = 0
            for c in cuts:
                # A block ends where a nearest name does.
                if size + c - start >= block and (c > 0 or near[0] != last):
                    if c > start:
                        held.append(batch.slice(start, int(c) - start))
                    if held:
                        yield from _spans(held, windows)
                    held, size, start = [], 0, int(c)
            if batch.num_rows > start:
                held.append(batch.slice(start))
                size += batch.num_rows - start
                last = near[-1]
        if held:
            yield from _spans(held, windows)

    # Windows lo to hi of a context; at first all.
    open_ = contexts.withColumns({"lo": F.lit(0), "hi": F.lit(windows.count - 1)})
    few, whole = [], []
    for _ in range((windows.count - 1).bit_length()):
        counts = open_.groupBy("near").agg(F.count("*").alias("n"))
        many = stored(counts.filter(F.col("n") > block).select("near"), "crowded")
        if many.isEmpty():
            break
        few.append(open_.join(many, "near", "left_anti").select(open_.columns))
        crowded = open_.join(many, "near", "left_semi").select(open_.columns)
        halves = crowded.mapInArrow(_halves(windows), f"near long, whole long, {_HALF_SCHEMA}")
        found = stored(settled_and_open(halves, windows), "halves")
        whole.append(
            found.filter("settled").select(
                "doc_id",
                F.greatest(F.col("at") + F.col("lo"), F.lit(0)).alias("first"),
                F.least(F.col("at") + F.col("hi") + windows.length, F.col("n_units")).alias("last"),
            )
        )
        open_ = found.filter(~F.col("settled")).select(open_.columns)
    few.append(open_)
    spans = (
        reduce(DataFrame.unionByName, few)
        .repartition("near")
        .sortWithinPartitions("near")
        .mapInArrow(refine, "doc_id long, first int, last int")
    )
    return reduce(DataFrame.unionByName, whole, spans)


_HALF_SCHEMA = "doc_id long, at int, n_units int, units binary, lo int, hi int"


def _halves(windows: Windows):
    """A context's rows for either half of its windows, dealt by a name of the
    units that all windows of a half share."""

    def halve(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                rows = batch.slice(start, 1024)
                _, doc, at, n, names = _units(rows, windows)
                levels, size, step = {1: names}, 1, 0
                while 2 * size <= min(32, windows.length):
                    levels[2 * size] = doubled(levels[size], size, step)
                    size, step = 2 * size, step + 1
                levels = {k: v.T for k, v in levels.items()}
                lows, highs = (rows.column(k).to_numpy() for k in (5, 6))
                for lo, hi in sorted(set(zip(lows.tolist(), highs.tolist()))):
                    middle = (lo + hi) // 2
                    for a, b in {(lo, middle), (min(middle + 1, hi), hi)}:
                        held = (np.maximum(a, -at) <= np.minimum(b, n - windows.length - at)) & (lows == lo) & (highs == hi)
                        own = np.flatnonzero(held)
                        shared = span_names(levels, np.array([b]), windows.length - (b - a))[0]
                        near = spread(shared[own] * _STEPS[4] + np.uint64(a))
                        whole = span_names(levels, np.array([a]), windows.length + (b - a))[0][own]
                        taken = rows.take(pa.array(own))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(near.view(np.int64)), pa.array(whole.view(np.int64)),
                             *(taken.column(k) for k in range(1, 5)),
                             pa.array(np.full(len(own), a, np.int32)), pa.array(np.full(len(own), b, np.int32))],
                            ["near", "whole", "doc_id", "at", "n_units", "units", "lo", "hi"],
                        )

    return halve


def _units(batch, windows):
    """The columns of a context batch; of its units, their names."""
    near, doc, at, n = (batch.column(k).to_numpy() for k in range(4))
    units = np.frombuffer(b"".join(batch.column(4).to_pylist()), windows.unit_type)
    names = windows.unit_names(units.reshape(len(near), windows.context))
    place = at[:, None] + np.arange(windows.context)
    names = np.where((place >= 0) & (place < n[:, None]), names, np.uint64(1))
    return near, doc, at.astype(np.int64), n.astype(np.int64), names


def context_rows(doc_id: int, units: np.ndarray, wanted: list, windows: Windows) -> pa.RecordBatch:
    """The open contexts of one document, cut from its units."""
    padded = np.zeros(len(units) + 2 * windows.context, windows.unit_type)
    padded[windows.context : windows.context + len(units)] = units
    at = np.array([w["at"] for w in wanted], np.int32)
    rows = [padded[a : a + windows.context].tobytes() for a in at + windows.context]
    count = len(at)
    return pa.record_batch(
        [pa.array([w["near"] for w in wanted], pa.int64()), pa.array([doc_id] * count, pa.int64()), pa.array(at),
         pa.array([len(units)] * count, pa.int32()), pa.array(rows, pa.binary())],
        ["near", "doc_id", "at", "n_units", "units"],
    )


def _bucket_pointers(names, windows):
    """A bucket for every window of every context; equal windows share one.

    Starts from buckets of the first depth. A bucket is refined by sorting its
    members on the bucket of the place one depth later; what a round assigns
    is what the next one looks up. Buckets of one member need no refining.
    """
    count = windows.count
    _, bucket = np.unique(names, return_inverse=True)
    bucket = bucket.reshape(names.shape)
    depth = windows.first_depth
    while depth < windows.length:
        step = min(depth, windows.length - depth)
        places = bucket.shape[1] - step
        here, later = bucket[:, :places], bucket[:, step:]
        # Whole buckets of one member keep their pointer.
        sizes = np.bincount(here.ravel(), minlength=int(bucket.max()) + 1)
        shared = sizes[here] > 1
        refined = np.full(here.shape, -1, np.int64)
        key = here[shared].astype(np.int64) * (int(bucket.max()) + 1) + later[shared]
        values, pointer = np.unique(key, return_inverse=True)
        refined[shared] = pointer
        alone = ~shared
        refined[alone] = len(values) + np.arange(int(alone.sum()))
        bucket, depth = refined, depth + step
    return bucket[:, :count]


def _spans(held, windows):
    batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    _, doc, at, n, names = _units(batch, windows)
    bucket = _bucket_pointers(depth_names(names, windows.first_depth), windows)
    j = np.arange(windows.count)
    ok = (at[:, None] + j >= 0) & (at[:, None] + j + windows.length <= n[:, None])
    lo, hi = (batch.column(k).to_numpy()[:, None] for k in (5, 6))
    ok &= (j >= lo) & (j <= hi)
    row, col = np.nonzero(ok)
    group, first = bucket[row, col], at[row] + col
    order = np.lexsort((first, doc[row], group))
    g, d, f = group[order], doc[row][order], first[order]
    lead = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    head = np.repeat(lead, np.diff(np.r_[lead, len(g)]))
    later = d > d[head]
    if windows.earlier == "place":
        later |= (d == d[head]) & (f > f[head])
    hit = np.zeros(ok.shape, bool)
    hit[row[order][later], col[order][later]] = True
    # Neighbouring windows make one span.
    edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    r, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    if len(r):
        yield pa.record_batch(
            [pa.array(doc[r]), pa.array((at[r] + a).astype(np.int32)),
             pa.array((at[r] + b - 1 + windows.length).astype(np.int32))],
            ["doc_id", "first", "last"],
        )


def spans_by_document(settled: DataFrame, compared_spans: DataFrame, windows: Windows) -> DataFrame:
    """(doc_id, spans): all spans of a document, packed as pairs of 32-bit places."""
    whole = settled.select("doc_id", F.col("at").alias("first"), (F.col("at") + windows.context).alias("last"))
    return (
        whole.unionByName(compared_spans)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    )


def union_mask(spans: list, n: int) -> np.ndarray:
    """Which of n units the spans cover."""
    mask = np.zeros(n + 1, np.int32)
    if spans:
        places = np.array([(s["first"], s["last"]) for s in spans], np.int64).clip(0, n)
        np.add.at(mask, places[:, 0], 1)
        np.add.at(mask, places[:, 1], -1)
    return np.cumsum(mask)[:-1] > 0

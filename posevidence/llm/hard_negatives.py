"""Hard negatives of anchors by threshold joins over integer vectors.

Anchors meet all rows in blocks: a grid of row blocks and anchor blocks of bounded
size. Within a cell the join is L2AP's: dimensions go by falling energy; a row is
indexed only in the leading dimensions that the norms of the rest cannot cover
(what the rest can add stays below the least threshold); partial scores are added
up over the index, and a pair is dropped once its partial score and the product
of the remaining norms stay below the anchor's threshold; what is left is
completed exactly. An anchor whose windows did not fill is asked again in the next
round with a lower threshold, the last of which is the window's own bound, so no
row is missed. Thresholds only save work.

Rows with a NULL id, label or vector, or with a NULL or non-finite component, take
no part. Of rows with one id the least by label and components takes part. Short
vectors are read as if zeros followed. Components and scores beyond 64 bits stay
at the limit. Ties go by id. An empty table gives no row. Other columns are
not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posevidence.llm.common import stored

ANCHOR_EVERY = 100
POSITIVES = NEGATIVES = 5
ROW_BLOCK = ANCHOR_BLOCK = 8192
#: Thresholds of the rounds: of positives as shares of the anchor's own squared
#: norm, of negatives as shares of the positive's score. None is the window's bound.
POSITIVE_SHARES = (0.25, 0.125, None)
NEGATIVE_PERCENTS = (95, 90, None)
LEAST_PERCENT, MOST_PERCENT = 80, 100

_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1
_EXACT = 1 << 53
_STEP = 8
_CHUNK = 256


def participants(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, units): rows that take part, components in 256ths."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return (
        embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
        .filter(usable)
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.struct(
                shifted.cast("long").alias("label"),
                F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")).alias("units"),
            ).alias("row"),
        )
        .groupBy("vec_id")
        .agg(F.min("row").alias("row"))
        .select("vec_id", "row.label", "row.units")
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    found = np.zeros((len(lengths), lengths.max(initial=0)), np.int64)
    found[np.arange(found.shape[1]) < lengths[:, None]] = column.flatten().to_numpy()
    return found


def _reaching(queries: np.ndarray, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of every pair whose inner product reaches the query's
    threshold; both matrices hold whole numbers whose products are exact."""
    energy = np.argsort(-(rows**2).sum(0), kind="stable")
    queries, rows = queries[:, energy], rows[:, energy]
    width = rows.shape[1]

    def remaining(m):
        squares = np.cumsum((m**2)[:, ::-1], 1)[:, ::-1]
        return np.sqrt(np.c_[squares, np.zeros(len(m))])

    rest_q, rest_r = remaining(queries), remaining(rows)
    places = [*range(0, width, _STEP), width]
    # Where the index of a row ends: from there its norm cannot reach alone.
    reach = rest_q[:, places].max(0, initial=0) * rest_r[:, places] + 0.5 >= least.min(initial=np.inf)
    extent = reach.sum(1)
    order = np.argsort(-extent, kind="stable")
    rows, rest_r, extent = rows[order], rest_r[order], extent[order]
    partial = np.zeros((len(queries), len(rows)))
    found = []
    indexed = int((extent > 0).sum())

    def alive(a, b, place):
        bound = rest_q[:, place, None] * rest_r[None, a:b, place]
        q, r = np.nonzero(partial[:, a:b] + bound + 0.5 >= least[:, None])
        return q, r + a

    def complete(q, r, place):
        score = partial[q, r]
        for a in range(0, len(q), 1 << 16):
            part = slice(a, a + (1 << 16))
            score[part] += np.einsum("ij,ij->i", queries[q[part], place:], rows[r[part], place:])
        kept = score >= least[q]
        found.append((q[kept], order[r[kept]], score[kept]))

    for k, (a, b) in enumerate(zip(places, places[1:])):
        now = int((extent > k).sum())
        if now < indexed:
            complete(*alive(now, indexed, a), a)
            indexed = now
        if not indexed:
            break
        partial[:, :indexed] += queries[:, a:b] @ rows[:indexed, a:b].T
        q, r = alive(0, indexed, b)
        if b == width or len(q) * 16 < len(queries) * indexed:
            complete(q, r, b)
            break
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))


def _all_pairs(queries: np.ndarray, rows: np.ndarray, least: np.ndarray):
    """As ``_reaching`` for components so large that only whole-number
    arithmetic is exact."""
    scores = np.clip(queries.astype(object) @ rows.astype(object).T, _LOWEST, _HIGHEST).astype(np.int64)
    q, r = np.nonzero(scores >= least[:, None])
    return q, r, scores[q, r]


def _cell(same: bool, most: int):
    """Join of one block of rows with one block of anchors: the first rows of
    every window of every anchor, by label equal to the anchor's or not."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, queries = _matrix(left["units"]), _matrix(right["units"])
        width = max(rows.shape[1], queries.shape[1], 1)
        rows, queries = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (rows, queries))
        largest = [max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in (rows, queries)]
        pairs = _all_pairs
        if width * largest[0] * largest[1] < _EXACT and width * max(largest) ** 2 < _EXACT:
            pairs, rows, queries = _reaching, rows.astype(float), queries.astype(float)
        ids, anchors = left["vec_id"].to_numpy(), right["anchor_id"].to_numpy()
        labels, own = left["label"].to_numpy(), right["label"].to_numpy()
        windows = [[(w["tag"], w["least"], w["most"]) for w in row] for row in right["windows"].to_pylist()]
        least = np.array([min((w[1] for w in row), default=_HIGHEST) for row in windows], np.int64)
        exact = least if pairs is _all_pairs else least.astype(float)
        # Anchors of one label, or of like thresholds, go together.
        if same:
            groups = [(np.flatnonzero(own == v), np.flatnonzero(labels == v)) for v in np.unique(own)]
        else:
            groups = [(np.argsort(least, kind="stable"), np.arange(len(ids)))]
        out = []
        for of, among in groups:
            for a in range(0, len(of), _CHUNK):
                part = of[a : a + _CHUNK]
                if not len(among):
                    continue
                q, r, score = pairs(queries[part], rows[among], exact[part])
                q, r = part[q.astype(np.int64)], among[r.astype(np.int64)]
                kept = (ids[r] != anchors[q]) & ((labels[r] == own[q]) == same)
                q, r, score = q[kept], r[kept], score[kept].astype(np.int64)
                order = np.lexsort((ids[r], -score, q))
                q, r, score = q[order], r[order], score[order]
                for k in np.unique(q):
                    first, last = np.searchsorted(q, [k, k + 1])
                    own_scores = -score[first:last]
                    for tag, low, high in windows[k]:
                        i, j = np.searchsorted(own_scores, -high), np.searchsorted(own_scores, -low, "right")
                        j = min(j, i + most)
                        out += [(anchors[k], tag, ids[r[first + p]], score[first + p]) for p in range(i, j)]
        values = np.array(out, np.int64).reshape(-1, 4)
        return pa.table({name: values[:, k] for k, name in enumerate(("anchor_id", "tag", "vec_id", "score"))})

    return join


def within_windows(rows: DataFrame, wanted: DataFrame, n_rows: int, same: bool, most: int) -> DataFrame:
    """(anchor_id, tag, vec_id, score, rank): for every window (tag, least, most)
    of every anchor the first rows with a score in it, exactly.

    ``wanted``: anchor_id, label, units and an array of windows.
    """
    row_blocks = -(-max(n_rows, 1) // ROW_BLOCK)
    anchor_blocks = -(-max(wanted.count(), 1) // ANCHOR_BLOCK)
    grid = {"row_block": (row_blocks, "vec_id"), "anchor_block": (anchor_blocks, "anchor_id")}

    def dealt(df, own, other):
        number, key = grid[own]
        return df.withColumns(
            {
                own: F.pmod(F.xxhash64(key), F.lit(number)).cast("int"),
                other: F.explode(F.sequence(F.lit(0), F.lit(grid[other][0] - 1))),
            }
        )

    cells = ["row_block", "anchor_block"]
    found = (
        dealt(rows, *cells)
        .groupBy(*cells)
        .cogroup(dealt(wanted, *cells[::-1]).groupBy(*cells))
        .applyInArrow(_cell(same, most), "anchor_id long, tag long, vec_id long, score long")
    )
    order = Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _filled(rows: DataFrame, asked: DataFrame, bounds, n_rows: int, same: bool, most: int, purpose: str) -> DataFrame:
    """First rows of every asked window, by rounds of falling thresholds.

    ``asked``: anchor_id, label, units, tag, bound (the window's least score) and
    top. ``bounds``: a threshold column for each round, the last one None.
    """
    keys, parts = ["anchor_id", "tag"], []
    for threshold in bounds:
        least = F.col("bound") if threshold is None else F.greatest("bound", threshold)
        wanted = asked.groupBy("anchor_id").agg(
            F.first("label").alias("label"),
            F.first("units").alias("units"),
            F.collect_list(F.struct("tag", least.alias("least"), F.col("top").alias("most"))).alias("windows"),
        )
        found = stored(within_windows(rows, wanted, n_rows, same, most), purpose)
        if threshold is None:
            parts.append(found)
            break
        full = found.filter(F.col("rank") == most).select(*keys)
        parts.append(found.join(full, keys, "left_semi"))
        asked = stored(asked.join(full, keys, "left_anti"), purpose)
        if asked.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts)


def mined(embeddings: DataFrame, every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = stored(participants(embeddings), "vectors")
    n_rows = rows.count()
    anchors = rows.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "anchor_id")
    squared = F.aggregate("units", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    asked = anchors.select(
        "anchor_id", "label", "units", F.lit(0).cast("long").alias("tag"),
        F.lit(_LOWEST).alias("bound"), F.lit(_HIGHEST).alias("top"),
    )
    shares = [None if s is None else F.ceil(squared * s) for s in POSITIVE_SHARES]
    near = stored(_filled(rows, asked, shares, n_rows, True, positives, "positives"), "positives")
    # No negative reaches four fifths of a negative score and stays below it.
    hi = F.col("score")
    percent = lambda p: -F.floor(-hi.cast("decimal(38,0)") * p / 100).cast("long")
    wide = near.filter(hi >= 0).select(
        "anchor_id", F.col("vec_id").alias("tag"), "score",
        percent(LEAST_PERCENT).alias("bound"), F.floor(hi.cast("decimal(38,0)") * MOST_PERCENT / 100).cast("long").alias("top"),
        *[percent(p).alias(f"least_{p}") for p in NEGATIVE_PERCENTS if p is not None],
    )
    asked = anchors.join(wide, "anchor_id")
    bounds = [None if p is None else F.col(f"least_{p}") for p in NEGATIVE_PERCENTS]
    hard = _filled(rows, asked, bounds, n_rows, False, negatives, "negatives")
    scores = near.select("anchor_id", F.col("vec_id").alias("tag"), F.col("score").alias("positive_score"))
    return hard.join(scores, ["anchor_id", "tag"]).select(
        "anchor_id",
        F.col("tag").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )

"""Scoring of texts by a hierarchical Pitman-Yor language model.

Tokens are lower-case words and one end for each text. The token before chooses
a restaurant, each token its own; all context restaurants share one parent, the
restaurant of single tokens, whose base is uniform over the known tokens and one
unknown. Who sits where in the Chinese-restaurant representation is sampled by
Gibbs rounds: given its parent, the tables of every (context, token) cell are
drawn anew customer by customer, then the parent's, whose customers are the
tables below. Predictive probabilities are averaged over the samples that follow
the burn-in.

A token's cells, its parent's seats and its probability depend on other tokens
only through totals of the restaurants. So tokens are dealt out by name, each
sampled in one task. The totals are dealt out by the same names: a bucket of
tokens sends what it adds to its cells' restaurants to the buckets that these
belong to, and is answered with their totals.

1. Training cells are counted: blocks of documents are combined before they are
   dealt out, so a frequent token brings one count for each context, not its
   occurrences.
2. Rounds over the counted cells sample the seats; no seat is stored between
   rounds, each begins from the totals of the one before.
3. All occurrences are dealt out by the same names, in blocks that keep
   documents apart, meet their bucket's cells, of which the task samples the
   probabilities, and return sums for each document. A bucket with many blocks is
   dealt to several tasks, which sample the same. The probability of a cell that was never seen is a factor of
   its context times one of its token. Every token of a text is once a context,
   the end before its first one, so a bucket gives its tokens both factors, and
   a seen cell the rest.

NULL and empty texts are one end token. Rows with equal ids are scored each for
itself; a row without an id counts as id "" for the fold.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posevidence.llm.common import portions, stored, text_bytes, word_names, word_spans

#: Contexts of one message between buckets.
CONTEXTS = 1 << 16
#: Tokens that one task counts or scores before it hands over a block.
BLOCK_TOKENS = 1 << 21
BLOCK_DOCUMENTS = 60_000
#: Tokens dealt to one name bucket, about, and least number of buckets.
BUCKET_TOKENS = 1 << 21
LEAST_BUCKETS = 24
#: Blocks of one bucket scored in one task.
BUCKET_BLOCKS = 256
#: Turns in which documents are scored; what one turn shuffles is gone before the
#: next begins.
TURNS = 2
STRENGTH = 1.0
BURN_IN = 2
SAMPLES = 3

#: Name of the end token; no word's digest is reserved, a clash is one in 2^64.
_END = np.uint64(0x5EED0E7DFACE0FF5)
_BUCKET_SHIFT = np.uint64(40)


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> _BUCKET_SHIFT) % np.uint64(buckets)).astype(np.int64)


def _in_buckets(dealt: np.ndarray) -> np.ndarray:
    """The order by bucket, otherwise as before; small numbers are sorted by their digits."""
    return np.argsort(dealt.astype(np.uint16) if len(dealt) and dealt.max() < 1 << 16 else dealt, kind="stable")


def held_out(doc_id, folds: int, left_out: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == left_out


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Names of all tokens, ends included, and each one's text."""
    data, at = text_bytes(batch.column(1))
    starts, ends, before = word_spans(data, at)
    words = word_names(data, starts, ends, lower=True)
    sizes = np.diff(before) + 1
    text = np.repeat(np.arange(len(sizes)), sizes)
    names = np.full(len(text), _END, np.uint64)
    close = np.cumsum(sizes) - 1
    inside = np.ones(len(text), bool)
    inside[close] = False
    names[inside] = words
    return names, text


def _bigrams(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct names of whole texts' tokens, sorted, and the number among
    them of each token and of its context, the token before."""
    coded = pa.array(tokens, pa.uint64()).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    number = np.empty(len(found), np.uint64)
    number[order] = np.arange(len(found), dtype=np.uint64)
    names, words = found[order], number[coded.indices.to_numpy()]
    return names, words, np.r_[np.searchsorted(names, _END).astype(np.uint64), words[:-1]]


def _used(numbers: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of ``numbers`` below ``most``, and the place of each among them."""
    met = np.zeros(most, bool)
    met[numbers] = True
    return np.flatnonzero(met), (np.cumsum(met) - 1)[numbers]


def _each(batches):
    """Rows one at a time: their cells are large, and a batch holds several."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def _runs(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


COUNT_SCHEMA = "bucket int, words binary, sizes binary, names binary, contexts binary, counts binary"
_HALF = np.uint64(32)
_LOW = np.uint64((1 << 32) - 1)


def _split(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (key >> _HALF).astype(np.int64), (key & _LOW).astype(np.int64)


def _cells(names, key, counts, buckets):
    """One row for each bucket of cells; ``key`` has a cell's token and context
    as numbers of the sorted ``names`` and rises."""
    words, contexts = _split(key)
    dealt = _bucket(names, buckets)[words]
    order = _in_buckets(dealt)
    words, contexts, counts, dealt = words[order], contexts[order], counts[order], dealt[order]
    edge = _runs(dealt)
    for a, b in zip(edge, [*edge[1:], len(dealt)]):
        first = _runs(words[a:b])
        used, place = _used(contexts[a:b], len(names))
        own = counts[a:b]
        yield pa.record_batch(
            [pa.array([int(dealt[a])], pa.int32()),
             pa.array([names[words[a:b][first]].tobytes()], pa.binary()),
             pa.array([np.diff(np.r_[first, b - a]).astype("<u4").tobytes()], pa.binary()),
             pa.array([names[used].tobytes()], pa.binary()),
             pa.array([place.astype("<u4").tobytes()], pa.binary()),
             pa.array([own.astype("<u4" if own.max() < 1 << 32 else "<u8").tobytes()], pa.binary())],
            ["bucket", "words", "sizes", "names", "contexts", "counts"],
        )


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The names of a row's tokens and contexts, and key and count of every cell."""
    words, contexts = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["names"], "<u8")
    names = np.union1d(words, contexts)
    place = np.frombuffer(row["contexts"], "<u4")
    token = np.repeat(np.searchsorted(names, words), np.frombuffer(row["sizes"], "<u4")).astype(np.uint64)
    key = token << _HALF | np.searchsorted(names, contexts).astype(np.uint64)[place]
    kind = "<u4" if len(row["counts"]) == 4 * len(place) else "<u8"
    return names, key, np.frombuffer(row["counts"], kind).astype(np.int64)


def _counted(docs: DataFrame, buckets: int, folds: int, left_out: int) -> DataFrame:
    def count(batches):
        held, size = [], 0
        for batch in portions(batches, "text"):
            ids = batch.column(0).to_pylist()
            train = np.array([not held_out(d, folds, left_out) for d in ids], bool)
            names, text = _tokens(batch)
            names = names[train[text]]
            held.append(names)
            size += len(names)
            if size >= BLOCK_TOKENS:
                yield from close(held)
                held, size = [], 0
        if size:
            yield from close(held)

    def close(held):
        names, words, contexts = _bigrams(np.concatenate(held))
        key = np.sort(words << _HALF | contexts)
        head = _runs(key)
        yield from _cells(names, key[head], np.diff(np.r_[head, len(key)]), buckets)

    def combine(batches):
        held, bucket = [], None
        for row in _each(batches):
            if bucket is not None and row["bucket"] != bucket:
                yield from together(held)
                held = []
            bucket = row["bucket"]
            held.append(_opened(row))
            if len(held) >= 64:  # keeps memory to the bucket's distinct cells
                held = [_merge(held)]
        if held:
            yield from together(held)

    def together(held):
        yield from _cells(*_merge(held), buckets)

    return (
        docs.mapInArrow(count, COUNT_SCHEMA)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(combine, COUNT_SCHEMA)
    )


def _merge(held):
    names = np.unique(np.concatenate([h[0] for h in held]))
    keys = []
    for own, key, _ in held:
        number = np.searchsorted(names, own).astype(np.uint64)
        words, contexts = _split(key)
        keys.append(number[words] << _HALF | number[contexts])
    key, counts = np.concatenate(keys), np.concatenate([h[2] for h in held])
    order = np.argsort(key, kind="stable")
    key, counts = key[order], counts[order]
    head = _runs(key)
    return names, key[head], np.add.reduceat(counts, head) if len(head) else counts


@dataclass
class Totals:
    """What the restaurants know of each other."""

    customers: np.ndarray  # of each context restaurant that a bucket meets
    tables: np.ndarray  # of each context restaurant that a bucket meets
    root_tables: float
    known: int
    discount: float
    root_discount: float
    all_tables: float | None = None  # of all context restaurants, where there are others

    def parent(self, own_customers, own_tables):
        base = (STRENGTH + self.root_discount * self.root_tables) / (self.known + 1)
        whole = self.tables.sum() if self.all_tables is None else self.all_tables
        return (own_customers - self.root_discount * own_tables + base) / (STRENGTH + whole)

    def fresh(self, contexts):
        """Weight of the parent in each context, and the sum of all weights."""
        return STRENGTH + self.discount * self.tables[contexts], STRENGTH + self.customers[contexts]


def seated(customers: np.ndarray, fresh: np.ndarray, discount: float, random) -> np.ndarray:
    """Tables of each dish after its customers sat down one by one.

    A customer opens a table with weight ``fresh`` and joins one of t tables of
    n customers with weight n - discount * t. Beyond 64 customers, sittings
    are drawn in runs over which these weights change by a few hundredths.
    """
    customers = np.rint(customers).astype(np.int64)
    tables = np.ones(len(customers))
    left = np.flatnonzero(customers > 1)
    sat = 1
    while len(left):
        run = np.minimum(max(1, sat // 32), customers[left] - sat)
        chance = fresh[left] / (fresh[left] + sat - discount * tables[left])
        tables[left] += random.binomial(run, np.clip(chance, 0, 1)) if sat >= 32 else random.random(len(left)) < chance
        sat += max(1, sat // 32)
        left = left[customers[left] > sat]
    return np.minimum(tables, customers)


def _sampled(words, contexts, counts, totals: Totals, sweeps: int, keep: int, seed: int):
    """Mean tables of the cells and mean parent probabilities over the last sweeps."""
    random = np.random.default_rng(seed)
    head = _runs(words)
    number = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(words)]))
    cells = np.diff(np.r_[head, len(words)])
    parent = totals.parent(cells, np.ones(len(head)))
    weight, _ = totals.fresh(contexts)
    # A single customer has a table, whatever its weight.
    some = np.flatnonzero(counts > 1)
    alone = np.bincount(number, weights=counts == 1, minlength=len(head))
    mean_tables, mean_parent, mean_root = np.zeros(len(words)), np.zeros(len(head)), 0.0
    mean_tables[counts == 1] = 1.0
    base = (STRENGTH + totals.root_discount * totals.root_tables) / (totals.known + 1)
    for sweep in range(sweeps):
        tables = seated(counts[some], weight[some] * parent[number[some]], totals.discount, random)
        below = alone + np.bincount(number[some], weights=tables, minlength=len(head))
        root = seated(below, np.full(len(head), base), totals.root_discount, random)
        parent = totals.parent(below, root)
        if sweep >= sweeps - keep:
            mean_tables[some] += tables / keep
            mean_parent += parent / keep
            mean_root += root.sum() / keep
    return head, mean_tables, mean_parent, mean_root


def _first_totals(cells: DataFrame) -> tuple[Totals, int]:
    """Sums over all restaurants with one table for each cell, and the number of training tokens."""

    def count(batches):
        for row in _each(batches):
            sizes = np.frombuffer(row["sizes"], "<u4")
            counts = _opened(row)[2]
            sums = (
                len(sizes), len(counts), counts.sum(), (counts == 1).sum(), (counts == 2).sum(),
                (sizes == 1).sum(), (sizes == 2).sum(),
            )
            yield pa.record_batch([pa.array([int(n)], pa.int64()) for n in sums], names)

    names = ["known", "cells", "tokens", "once", "twice", "root_once", "root_twice"]
    found = cells.mapInArrow(count, ", ".join(f"{n} long" for n in names))
    sums = {n: v or 0 for n, v in found.agg(*[F.sum(n).alias(n) for n in names]).first().asDict().items()}

    def discount(once: int, twice: int) -> float:
        return min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)

    nothing = np.zeros(0)
    totals = Totals(
        nothing, nothing, float(sums["known"]), sums["known"], discount(sums["once"], sums["twice"]),
        discount(sums["root_once"], sums["root_twice"]), float(sums["cells"]),
    )
    return totals, sums["tokens"]


#: What a bucket adds to restaurants of the bucket ``to``, and what it is answered:
#: the same restaurants in the same order, without their names.
MESSAGE_SCHEMA = "to int, bucket int, piece int, names binary, customers binary, tables binary"


def _message(to, bucket, piece, names, customers, tables):
    return pa.record_batch(
        [*[pa.array([int(n)], pa.int32()) for n in (to, bucket, piece)],
         *[pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip((names, customers, tables), ("<u8", "<f8", "<f8"))]],
        ["to", "bucket", "piece", "names", "customers", "tables"],
    )


def _pieces(names: np.ndarray, buckets: int):
    """The bucket, the number and the restaurants of every message about ``names``."""
    dealt = _bucket(names, buckets)
    order = _in_buckets(dealt)
    edge = _runs(dealt[order])
    for a, b in zip(edge, [*edge[1:], len(order)]):
        for piece, start in enumerate(range(a, b, CONTEXTS)):
            yield int(dealt[order[a]]), piece, order[start : min(b, start + CONTEXTS)]


def _messages(bucket, names, contexts, counts, tables, buckets):
    """Customers and tables of a bucket's cells by restaurant; its tokens ask for their own too."""
    customers = np.bincount(contexts, weights=counts, minlength=len(names))
    tables = np.bincount(contexts, weights=tables, minlength=len(names))
    for to, piece, own in _pieces(names, buckets):
        yield _message(to, bucket, piece, names[own], customers[own], tables[own])


def _answered(messages: DataFrame) -> DataFrame:
    """Every message with the whole totals of its restaurants; those to -1 as they are."""

    def answer(batches):
        to, held = None, []
        for row in _each(batches):
            if held and row["to"] != to:
                yield from close(to, held)
                held = []
            to = row["to"]
            held.append(
                (row["bucket"], row["piece"], np.frombuffer(row["names"], "<u8"),
                 np.frombuffer(row["customers"], "<f8"), np.frombuffer(row["tables"], "<f8"))
            )
        if held:
            yield from close(to, held)

    def close(to, held):
        if to < 0:
            yield from (_message(to, *h) for h in held)
            return
        every, place = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
        customers = np.bincount(place, weights=np.concatenate([h[3] for h in held]))
        tables = np.bincount(place, weights=np.concatenate([h[4] for h in held]))
        start = 0
        for bucket, piece, names, *_ in held:
            at, start = place[start : start + len(names)], start + len(names)
            yield _message(to, bucket, piece, names[:0], customers[at], tables[at])

    return messages.repartition("to").sortWithinPartitions("to", "bucket", "piece").mapInArrow(answer, MESSAGE_SCHEMA)


#: Cells of a bucket (kind 0), totals that it is answered (1), occurrences that
#: it is to score (2) and the heads of blocks (3), of bucket -1.
JOINED_SCHEMA = (
    "bucket int, to int, piece int, kind int, block long, words binary, sizes binary, names binary, contexts binary, "
    "counts binary, customers binary, tables binary, docs binary"
)
_JOINED = [c.split() for c in JOINED_SCHEMA.split(", ")]


def _filled(rows: DataFrame, kind: int) -> DataFrame:
    """``rows`` with all columns of ``JOINED_SCHEMA``."""
    have = {*rows.columns}
    other = {"kind": F.lit(kind)}
    return rows.select(
        *[(F.col(c) if c in have else other.get(c, F.lit(None))).cast(t).alias(c) for c, t in _JOINED]
    )


def _with_answers(cells: DataFrame, answers: DataFrame) -> DataFrame:
    return _filled(cells, 0).unionByName(_filled(answers.filter("to >= 0").drop("names"), 1))


class _Bucket:
    """A bucket's cells, and the totals of their restaurants as they come in."""

    def __init__(self, row: dict, buckets: int):
        self.number, self.row = row["bucket"], row
        self.names, key, self.counts = _opened(row)
        self.words, self.contexts = _split(key)
        self.customers, self.tables = np.zeros(len(self.names)), np.zeros(len(self.names))
        self.pieces = {(to, piece): own for to, piece, own in _pieces(self.names, buckets)}

    def answer(self, row: dict) -> None:
        own = self.pieces[row["to"], row["piece"]]
        self.customers[own] = np.frombuffer(row["customers"], "<f8")
        self.tables[own] = np.frombuffer(row["tables"], "<f8")

    def sampled(self, totals: Totals, sweeps: int, keep: int, seed: int):
        self.totals = replace(totals, customers=self.customers, tables=self.tables)
        return _sampled(self.words, self.contexts, self.counts, self.totals, sweeps, keep, seed + self.number)

    def factors(self, totals: Totals, seed: int):
        """Tokens with their counts and the log10 of both their factors, as a token
        and as a context; contexts, cells, and what is left of the cells' log10."""
        head, tables, parent, _ = self.sampled(totals, BURN_IN + SAMPLES, SAMPLES, seed)
        fresh, whole = self.totals.fresh(slice(None))
        of_token, of_context = np.log10(parent), np.log10(fresh / whole)
        number = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(self.words)]))
        at = self.contexts
        seen = (self.counts - self.totals.discount * tables + fresh[at] * parent[number]) / whole[at]
        rest = np.log10(seen) - of_context[at] - of_token[number]
        words = self.words[head]
        return (
            self.names[words], np.add.reduceat(self.counts, head), of_token + of_context[words], self.names,
            number << 32 | at, rest,
        )


def _first_messages(cells: DataFrame, buckets: int) -> DataFrame:
    def first(batches):
        for row in _each(batches):
            names, key, counts = _opened(row)
            yield from _messages(row["bucket"], names, _split(key)[1], counts, np.ones(len(key)), buckets)

    return cells.mapInArrow(first, MESSAGE_SCHEMA)


def _next_messages(cells: DataFrame, answers: DataFrame, totals: Totals, buckets: int, seed: int) -> DataFrame:
    """Messages of the seats that one round samples, and for each bucket one to
    -1 with its sum of tables and of the parent's."""

    def sample(batches):
        own = None
        for row in _each(batches):
            if row["kind"]:
                own.answer(row)
                continue
            if own is not None:
                yield from close(own)
            own = _Bucket(row, buckets)
        if own is not None:
            yield from close(own)

    def close(own):
        _, tables, _, root = own.sampled(totals, BURN_IN, 1, seed)
        yield _message(-1, own.number, 0, own.names[:0], own.names[:0], np.array([tables.sum(), root]))
        yield from _messages(own.number, own.names, own.contexts, own.counts, tables, buckets)

    rows = _with_answers(cells, answers).repartition("bucket").sortWithinPartitions("bucket", "kind")
    return rows.mapInArrow(sample, MESSAGE_SCHEMA)


BLOCK_SCHEMA = (
    "bucket int, kind int, block long, words binary, sizes binary, names binary, contexts binary, counts binary, docs binary"
)


def _row(bucket, kind, number, *binaries):
    return pa.record_batch(
        [pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([number], pa.int64()),
         *[pa.array([x], pa.binary()) for x in binaries]],
        [c.split()[0] for c in BLOCK_SCHEMA.split(", ")],
    )


def _occurrences(docs: DataFrame, buckets: int, folds: int, left_out: int) -> DataFrame:
    """Blocks of occurrences by bucket, and a head row for each block: its
    documents, which are held out, and their numbers of tokens."""

    def block(held, docs_held, number):
        tokens, docs_of = (np.concatenate(c) for c in zip(*held))
        lengths = np.bincount(docs_of, minlength=len(docs_held))
        ids = np.array([-1 if d is None else d for d in docs_held], "<i8")
        flags = np.array([2 * (d is None) + held_out(d, folds, left_out) for d in docs_held], np.uint8)
        yield _row(-1, 3, number, ids.tobytes(), flags.tobytes(), b"", b"", lengths.astype("<i8").tobytes(), b"")
        names, words, contexts = _bigrams(tokens)
        # In order of token, context and document; tokens come in the documents' order.
        if len(names) < 1 << 24:
            base = np.uint64(len(names))
            key = np.sort((words * base + contexts) << np.uint64(16) | docs_of.astype(np.uint64))
            head = _runs(key)
            pair, docs_of = key[head] >> np.uint64(16), (key[head] & np.uint64(0xFFFF)).astype(np.int64)
            words, contexts = (pair // base).astype(np.int64), (pair % base).astype(np.int64)
        else:
            pair = words << _HALF | contexts
            order = np.argsort(pair, kind="stable")
            key, docs_of = pair[order], docs_of[order]
            head = _runs(key, docs_of)
            (words, contexts), docs_of = _split(key[head]), docs_of[head]
        count = np.diff(np.r_[head, len(key)])
        dealt = _bucket(names, buckets)[words]
        order = _in_buckets(dealt)
        words, contexts, docs_of, count, dealt = (x[order] for x in (words, contexts, docs_of, count, dealt))
        edge = _runs(dealt)
        for a, b in zip(edge, [*edge[1:], len(dealt)]):
            first = _runs(words[a:b])
            used, place = _used(contexts[a:b], len(names))
            own = count[a:b]
            yield _row(
                int(dealt[a]), 2, number, names[words[a:b][first]].tobytes(),
                np.diff(np.r_[first, b - a]).astype("<u4").tobytes(), names[used].tobytes(),
                place.astype("<u2" if len(used) <= 1 << 16 else "<u4").tobytes(),
                own.astype("<u1" if own.max() < 256 else "<u4").tobytes(), docs_of[a:b].astype("<u2").tobytes(),
            )

    def deal(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, docs_held, size = [], [], 0
        for batch in portions(batches, "text"):
            names, text = _tokens(batch)
            if docs_held and (size + len(names) > BLOCK_TOKENS or len(docs_held) + batch.num_rows > BLOCK_DOCUMENTS):
                yield from block(held, docs_held, number)
                held, docs_held, size = [], [], 0
                number += 1
            held.append((names, text + len(docs_held)))
            docs_held += batch.column(0).to_pylist()
            size += len(names)
        if docs_held:
            yield from block(held, docs_held, number)

    return docs.mapInArrow(deal, BLOCK_SCHEMA)


def _summed(joined: DataFrame, totals: Totals, buckets: int, seed: int) -> DataFrame:
    """(block, kind, docs, known, base, score): sums of each block in each bucket.
    Every task samples its bucket's seats; tasks of one bucket sample the same."""

    def score(batches):
        own, model, at = None, None, None
        unknown = float(np.log10(totals.parent(0.0, 0.0)))
        for row in _each(batches):
            if row["kind"] == 3:
                yield sums(row["block"], 2, row["words"], row["counts"], row["sizes"], b"")
                continue
            if at != row["bucket"]:
                own, model, at = None, None, row["bucket"]
            if row["kind"] == 0:
                own = _Bucket(row, buckets)
            elif row["kind"] == 1:
                own.answer(row)
            else:
                if own is not None:  # else no token of this bucket is known
                    own, model = None, own.factors(totals, seed)
                yield occurrences(row, model, unknown)

    def occurrences(row, model, unknown):
        words, own_names = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["names"], "<u8")
        sizes, docs = np.frombuffer(row["sizes"], "<u4"), np.frombuffer(row["docs"], "<u2")
        contexts = np.frombuffer(row["contexts"], "<u2" if len(row["contexts"]) == 2 * len(docs) else "<u4")
        count = np.frombuffer(row["counts"], "<u1" if len(row["counts"]) == len(docs) else "<u4").astype(np.int64)
        which = np.repeat(np.arange(len(words)), sizes)
        seen, value, rest = np.zeros(len(words), np.int64), np.full(len(words), unknown), np.zeros(len(which))
        if model is not None:
            known_words, seen_of, value_of, names, cells, rest_of = model
            spot = np.minimum(np.searchsorted(known_words, words), len(known_words) - 1)
            known = known_words[spot] == words
            seen[known] = seen_of[spot[known]]
            value[known] = value_of[spot[known]]
            place = np.minimum(np.searchsorted(names, own_names), len(names) - 1)
            met = names[place] == own_names
            wanted = spot[which] << 32 | place[contexts]
            cell = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
            hit = (cells[cell] == wanted) & known[which] & met[contexts]
            rest[hit] = rest_of[cell[hit]]
        log_p = value[which] + rest
        base = np.log10(seen + 0.5)[which]
        n = int(docs.max()) + 1
        present = np.flatnonzero(np.bincount(docs, minlength=n))
        pick = lambda w: np.bincount(docs, weights=w, minlength=n)[present].astype("<f8").tobytes()
        return sums(
            row["block"], 1, present.astype("<u2").tobytes(), pick(count * (seen > 0)[which]), pick(count * base),
            pick(count * log_p),
        )

    def sums(block, kind, docs, known, base, total):
        return pa.record_batch(
            [pa.array([block], pa.int64()), pa.array([kind], pa.int32()),
             *[pa.array([x], pa.binary()) for x in (docs, known, base, total)]],
            ["block", "kind", "docs", "known", "base", "score"],
        )

    return (
        joined.repartition("bucket", "salt")
        .sortWithinPartitions("bucket", "salt", "kind")
        .mapInArrow(score, "block long, kind int, docs binary, known binary, base binary, score binary")
    )


def _by_document(summed: DataFrame) -> DataFrame:
    def add(batches):
        block, head, parts = None, None, []
        for row in _each(batches):
            if row["block"] != block and head is not None:
                yield close(head, parts)
                head, parts = None, []
            block = row["block"]
            if row["kind"] == 2:
                ids = np.frombuffer(row["docs"], "<i8")
                head = (ids, np.frombuffer(row["base"], np.uint8), np.frombuffer(row["known"], "<i8"))
                parts = [np.zeros(len(ids)) for _ in range(3)]
                continue
            docs = np.frombuffer(row["docs"], "<u2")
            for total, name in zip(parts, ("known", "base", "score")):
                total[docs] += np.frombuffer(row[name], "<f8")
        if head is not None:
            yield close(head, parts)

    def close(head, parts):
        ids, flags, lengths = head
        return pa.record_batch(
            [pa.array(ids, pa.int64(), mask=flags >= 2), pa.array((flags & 1).astype(bool)), pa.array(lengths, pa.int64()),
             pa.array(parts[0].astype(np.int64)), pa.array(parts[1]), pa.array(parts[2])],
            ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"],
        )

    return (
        summed.repartition("block")
        .sortWithinPartitions("block", F.desc("kind"))
        .mapInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    )


def scored(
    docs: DataFrame, folds: int = 5, left_out: int = 1, doc_id: str = "doc_id", text: str = "text", seed: int = 1
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score),
    one row for each row of ``docs``; ``score`` is the log10 probability of the
    text under the model, ``base_score`` under smoothed counts of single tokens.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // 6 // BUCKET_TOKENS))
    cells = stored(_counted(rows, buckets, folds, left_out), "cells")
    totals, tokens = _first_totals(cells)
    answers = stored(_answered(_first_messages(cells, buckets)), "totals")
    answers = stored(_answered(_next_messages(cells, answers, totals, buckets, seed)), "totals")
    # One row of two numbers for each bucket comes to the driver.
    sums = [np.frombuffer(r["tables"], "<f8") for r in answers.filter("to < 0").select("bucket", "tables").orderBy("bucket").collect()]
    if sums:
        totals = replace(totals, all_tables=float(sum(s[0] for s in sums)), root_tables=float(sum(s[1] for s in sums)))
    # A bucket's blocks go to several tasks where there are many of them.
    salts = max(1, -(-size // 6 // BLOCK_TOKENS // BUCKET_BLOCKS))
    copies = _with_answers(cells, answers).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    turns = []
    for turn in range(TURNS):
        some = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(TURNS)) == turn)
        blocks = _filled(_occurrences(some, buckets, folds, left_out), 2)
        dealt = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
        turns.append(stored(_by_document(_summed(copies.unionByName(dealt), totals, buckets, seed + 1)), "scores"))
    found = reduce(DataFrame.unionByName, turns)
    total = np.log10(tokens + 0.5 * (totals.known + 1))
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(float(total))).alias("base_score"), "score",
    )

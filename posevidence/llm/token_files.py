"""Token ids in files: frequency ranks in byte-aligned variable-length coding.

A corpus is tokenised once to count its ids; an id is then written as its rank
by falling count (ties by id), so that common ids take one byte. Ranks are
written in one to four bytes; their lengths go to separate control bytes, two
bits for each of four ranks, so that a block is decoded without branches by
looking lengths up in a table.

Files are rows of blocks, written and read by Spark in any store it reaches:
one part for each range of ids in ascending order, blocks numbered within it.
``ranks`` holds the id of each rank. A NULL text is empty; a row with a NULL id
comes before all others; rows with equal ids keep one row each.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posevidence.llm.common import portions, stored, text_bytes

#: Ids in one block, about.
BLOCK_IDS = 1 << 18
#: Bound of the cache of one worker process, in entries, in two halves: where the
#: newer is full the older goes, and what was used since stays. Longer parts are not kept.
PART_CACHE = 3 << 17
CACHED_LENGTH = 48
#: New parts that the library encodes as one text.
TOGETHER = 1000

_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    lengths = 1 + (values >= 1 << 8) + (values >= 1 << 16).astype(np.int64) + (values >= 1 << 24)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    out = np.zeros((count, 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


# Not the dotted capital I: lowered, its dot is a sign that joins those after it.
_LETTERS, _SIGNS, _BLANK = "A-Za-zÀ-ÖØ-öø-įı-ſ", "!-&(-/:-@\\[-`{-~", "\\x20\\x09-\\x0D"
# Surely one part to the library, and surely two.
_ONE, _TWO = f"^(?:[{_LETTERS}]+|[{_SIGNS}]+)$", f"^[{_LETTERS}]+[{_SIGNS}]+$"
_TAIL = "".join(c for c in map(chr, range(33, 127)) if re.match(f"[{_SIGNS}]", c))
# Runs of letters, or of signs, that the next character surely ends.
_PARTS = re.compile(
    f"[{_LETTERS}]++(?![^{_BLANK}{_SIGNS}])|[{_SIGNS}]++(?![^{_BLANK}{_LETTERS}])|[^{_BLANK}]+"
)


class WordTokenizer:
    """A tokenizer of the tokenizers library that ends words at white space and
    between letters and signs.

    Arrow finds the distinct words of a portion, and their distinct parts where
    the library surely cuts a word into letters and signs. Parts not yet kept are
    encoded by the library, many in one call; their ids are kept in a bounded
    cache. Texts that hold a special token's string go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[number] = token.endswith("</w>")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Ids as bytes of the tokenizer's width, which join without a loop.
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text; of a NULL text, none."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        odd, whole = pa.array(np.zeros(len(texts), bool)), {}
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        if pc.any(odd).as_py():
            for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                whole[k] = self._bytes(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids)
            texts = pc.if_else(odd, "", texts)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        ids, ends = _taken(*self._words(coded.dictionary), coded.indices.to_numpy())
        raw, cut = ids.tobytes(), (ends[split.offsets.to_numpy()] * self.dtype.itemsize).tolist()
        return [whole.get(k) or raw[a:b] for k, (a, b) in enumerate(zip(cut, cut[1:]))]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words end to end, and how many each has."""
        two = pc.match_substring_regex(words, _TWO)
        # The library lowers letters itself, so plain ones share a key.
        plain = pc.or_(two, pc.match_substring_regex(words, _ONE))
        core = pc.if_else(two, pc.ascii_rtrim(words, _TAIL), words)
        tail = pc.if_else(two, pc.replace_substring_regex(words, f"^[{_LETTERS}]+", ""), "")
        coded = pa.concat_arrays([pc.if_else(plain, pc.ascii_lower(core), core), tail]).dictionary_encode()
        flat, sizes = self._learned(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = coded.indices.to_numpy().reshape(2, -1).T.ravel()
        ids, ends = _taken(flat, sizes, at)
        return ids, np.diff(ends[::2])

    def _learned(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) >= PART_CACHE // 2:
            self.older, self.parts = self.parts, {}
        parts = self.parts
        known = list(map(parts.get, distinct))
        lacking = [k for k, ids in enumerate(known) if ids is None]
        new = []
        for k in lacking:
            if (ids := self.older.get(distinct[k])) is None:
                new.append(distinct[k])
            else:
                parts[distinct[k]] = ids
        self._learn(new)
        for k in lacking:
            known[k] = parts[distinct[k]]
        for p in new:
            if len(p) > CACHED_LENGTH:
                del parts[p]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        return np.frombuffer(b"".join(known), self.dtype), sizes

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _learn(self, new: list[str]) -> None:
        one = pc.match_substring_regex(pa.array(new, pa.string()), _ONE).to_numpy(zero_copy_only=False)
        plain = [new[i] for i in np.flatnonzero(one).tolist()]
        for k in range(0, len(plain), TOGETHER):
            some = plain[k : k + TOGETHER]
            ids = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids
            ids = np.array(ids, self.dtype)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
            # None has fewer than one end, so equal numbers mean one for each.
            if len(ends) == len(some):
                raw = ids.tobytes()
                self.parts.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        cut = {p: _PARTS.findall(p) for p in new if p not in self.parts}
        apart = list({p for row in cut.values() for p in row})
        found = self.tokenizer.encode_batch_fast(apart, add_special_tokens=False)
        ids = {p: self._bytes(encoding.ids) for p, encoding in zip(apart, found)}
        for p, row in cut.items():
            self.parts[p] = b"".join(map(ids.__getitem__, row))


def _taken(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries numbered ``at`` of a ragged array end to end, and their bounds."""
    taken = sizes[at]
    ends = np.r_[0, np.cumsum(taken)]
    return flat[np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], taken) + np.arange(ends[-1])], ends


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def tokenised(docs: DataFrame, path: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): ids of each text as little-endian values of the tokenizer's width."""

    def encode(batches):
        own = _tokenizer(path)
        end = np.array([] if end_id is None else [end_id], own.dtype).tobytes()
        for batch in portions(batches, "text"):
            found = own.encode(batch.column(1))
            yield pa.record_batch(
                [batch.column(0), pa.array([f + end for f in found], pa.binary())],
                ["doc_id", "ids"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids binary")


def id_counts(tokens: DataFrame, dtype: np.dtype) -> DataFrame:
    """How often each id occurs: (id, n)."""

    def count(batches):
        _tokenizers.clear()  # its caches are of no more use to this worker
        counts = np.zeros(0, np.int64)
        for batch in batches:
            data, _ = text_bytes(batch.column(0))
            more = np.bincount(np.frombuffer(data.tobytes(), dtype), minlength=len(counts))
            more[: len(counts)] += counts
            counts = more
        found = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(found, pa.int32()), pa.array(counts[found], pa.int64())], ["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(
    docs: DataFrame, folder: str, path: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Tokenise ``docs`` and write the blocks and ranks under ``folder``."""
    spark = docs.sparkSession
    dtype = _tokenizer(path).dtype
    tokens = stored(tokenised(docs, path, end_id, doc_id, text), "tokens")
    # At most one row for each id of the vocabulary comes to the driver.
    ordered = sorted(id_counts(tokens, dtype).collect(), key=lambda r: (-r["n"], r["id"]))
    ids = [r["id"] for r in ordered]
    spark.createDataFrame(list(enumerate(ids)), "rank int, id int").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(max(ids, default=0) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def blocks(batches):
        from pyspark import TaskContext

        _tokenizers.clear()
        ranks = shared.value
        part = TaskContext.get().partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        size = before = number = 0

        def block():
            nonlocal held, size, before, number
            values = np.concatenate([v for _, v in held])
            control, data = pack(values)
            row = pa.record_batch(
                [
                    pa.array([part], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([len(values)], pa.int64()),
                    pa.array([[d for d, _ in held]], pa.list_(pa.int64())),
                    pa.array([[len(v) for _, v in held]], pa.list_(pa.int32())),
                    pa.array([control], pa.binary()),
                    pa.array([data], pa.binary()),
                ],
                ["part", "block", "before", "n", "doc_ids", "counts", "control", "data"],
            )
            before += len(values)
            number += 1
            held, size = [], 0
            return row

        for batch in batches:
            for d, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = ranks[np.frombuffer(found, dtype)]
                held.append((d, values))
                size += len(values) + 1
                if size >= BLOCK_IDS:
                    yield block()
        if held:
            yield block()

    (
        tokens.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
        .mapInArrow(
            blocks,
            "part int, block int, before long, n long, doc_ids array<long>, counts array<int>, control binary, data binary",
        )
        .write.option("compression", "none")
        .parquet(f"{folder}/blocks")
    )


def _opened(spark: SparkSession, folder: str, schema: str, shown) -> DataFrame:
    """Rows of ``shown(doc_ids, starts, ids, offsets)`` for every block."""
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    shared = spark.sparkContext.broadcast(np.array([r["id"] for r in ranks], np.uint32))
    blocks = spark.read.parquet(f"{folder}/blocks")
    # One row for each part comes to the driver.
    sums = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts, total = {}, 0
    for part, n in sums:
        starts[part] = total
        total += n

    def open_blocks(batches):
        id_of = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                ids = id_of[unpack(row["control"], row["data"], row["n"])] if row["n"] else np.zeros(0, np.uint32)
                counts = np.array(row["counts"], np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                before = starts[row["part"]] + row["before"] + offsets[:-1]
                yield shown(pa.array(row["doc_ids"], pa.int64()), pa.array(before, pa.int64()), ids, offsets)

    return blocks.mapInArrow(open_blocks, schema)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids): every document's ids and how many precede them."""

    def shown(doc_ids, starts, ids, offsets):
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32), pa.int32()))
        return pa.record_batch([doc_ids, starts, lists], ["doc_id", "start", "ids"])

    return _opened(spark, folder, "doc_id long, start long, ids array<int>", shown)


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the ids that ``read_ids`` gives,
    taken where a block is opened, so that no id leaves the task."""

    def shown(doc_ids, starts, ids, offsets):
        raw, cut = memoryview(ids.astype("<u4")).cast("B"), (4 * offsets).tolist()
        crcs = [zlib.crc32(raw[a:b]) for a, b in zip(cut, cut[1:])]
        return pa.record_batch(
            [doc_ids, starts, pa.array(np.diff(offsets), pa.int64()), pa.array(crcs, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )

    return _opened(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", shown)


def ids_crc32(ids: Column) -> Column:
    """crc32 of the ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def crc(lists: pa.Array) -> pa.Array:
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        at = lists.offsets.to_numpy()
        return pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at[1:])], pa.int64())

    return crc(ids)

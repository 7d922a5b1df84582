"""Similarity join of documents by the Jaccard coefficient of their word shingles.

Documents link when 100 * intersection >= percent * union. The search is by
T-occurrence: a query of s shingles needs T = ceil(percent * s / 100) of them in
a partner. DivideSkip sets the longest inverted lists of a query aside, merges
the short ones, and probes the long ones by binary search only for documents
that the short ones brought within reach of T.

Which documents meet in one search is settled by parts. Two linked sets of at
most S shingles differ in H = (100 - percent) * 2S / (100 + percent) shingles
at most, so of H + 1 + s parts of their shingles, dealt by name, s + 1 are the
same in both. Every document leaves one name for each part, for the two size bands
that a partner may share with it, and does without the s of them that most
documents left: parts of no shingle or a common passage, whose groups would grow
with the corpus. Names that several documents then left make groups:

1. Documents with one and the same set are one class; its smallest id stands
   for it.
2. In every group the set that meets most others in its groups is searched
   against the others and then leaves it: of near copies that is one in their
   middle, mostly the text that they were made from. A group of near copies is
   linked by this alone, with one link for each member. A group whose rest is in
   several components gets another round.
3. In groups that are then still in several components all sets that are not
   of one component are compared, in blocks, by parity sketches; groups with the
   same members once. A block gives each set that a sketch cannot exclude once,
   not its pairs; those sets are searched in their block, which gives no more
   links than join its components.

A sketch holds the parities of a set's shingles in buckets: each parity in which
two sets differ is a shingle that they do not share, so it excludes no link.

So no link between different components is missed, and no group's pairs are
listed. NULL, empty and blank texts have no shingles and link with nothing; a
text with fewer words than a shingle is one shingle. Rows with equal ids are one
node, linked by the sets of all its rows; a row without an id has no component.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from posevidence.llm.common import mix, pair_hash, portions, stored, text_bytes, word_names, word_spans
from posevidence.llm.components import components

#: Documents of one index.
BLOCK = 512
#: Of so many shingles that two linked sets may differ in, one is a part more.
SPARE_OF = 4
#: Rounds in which groups are searched from the set left that meets most others.
STAR_ROUNDS = 2
#: Turns in which groups are compared in full; what one turn shuffles is gone
#: before the next begins.
TURNS = 4
#: Weight of probing against merging in the choice of lists set aside.
PROBE_WEIGHT = 0.01


def shingle_names(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle names of each text, sorted, and n + 1 offsets."""
    starts, ends, before = word_spans(data, at)
    names = word_names(data, starts, ends, lower=True)
    sizes = np.diff(before)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(names)) - before[text] if len(names) else np.zeros(0, np.int64)
    # A shingle begins where ``width`` words follow, or at a short text's start.
    ok = (place + width <= sizes[text]) | (place == 0)
    first = np.flatnonzero(ok)
    owner = text[first]
    value = mix(names[first] + np.uint64(width))
    for k in range(1, width):
        inside = place[first] + k < sizes[owner]
        following = names[np.minimum(first + k, len(names) - 1)]
        value = np.where(inside, pair_hash(value, following), value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])] if len(value) else np.zeros(0, bool)
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(sizes) + 1))


class Parts:
    """The size bands of a similarity, and the parts of each pair of bands."""

    def __init__(self, percent: int, most: int = 1 << 34):
        if not 0 < percent <= 100:
            raise ValueError("percent lies between 1 and 100")
        low, ends = 1, []
        while low <= most:
            ends.append(low * 100 // percent)
            low = ends[-1] + 1
        self.ends = np.array(ends)
        # A level joins a band and the next one.
        differ = (100 - percent) * 2 * self.ends[1:] // (100 + percent)
        #: Two linked sets have one part more than these in common, at least.
        self.spare = differ // SPARE_OF + 1
        self.parts = differ + 1 + self.spare

    def spares(self, sizes: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """How many parts a set of that size can do without, on its ``odd`` or even level."""
        band = np.searchsorted(self.ends, sizes)
        return self.spare[np.maximum(band - ((band & 1) != odd), 0)]

    def names(self, shingles: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Part names of every text, both levels, and their n + 1 offsets."""
        sizes = np.diff(at)
        band = np.searchsorted(self.ends, sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        found, owners = [], []
        for down in (0, 1):
            level = band - down
            used = (level >= 0) & (sizes > 0)
            own = used[owner]
            text = owner[own]
            value = mix(shingles[own] ^ (level[text].astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)))
            parts = self.parts[np.maximum(level, 0)]
            part = ((value >> np.uint64(32)) * parts[text].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            base = np.concatenate([[0], np.cumsum(np.where(used, parts, 0))])
            slot = base[text] + part
            order = np.argsort(slot, kind="stable")
            slot_s, value_s = slot[order], mix(value[order])
            count = np.bincount(slot, minlength=base[-1])
            total = np.zeros(base[-1], np.uint64)
            heads = np.flatnonzero(np.r_[True, slot_s[1:] != slot_s[:-1]]) if len(slot_s) else np.zeros(0, np.int64)
            if len(heads):
                total[slot_s[heads]] = np.add.reduceat(value_s, heads)
            whose = np.repeat(np.arange(len(sizes)), np.where(used, parts, 0))
            index = np.arange(base[-1]) - base[whose]
            own_level = level[whose].astype(np.uint64)
            name = pair_hash(total + count.astype(np.uint64), (own_level << np.uint64(40)) + index.astype(np.uint64))
            # The last bit tells a set's two levels apart.
            found.append((name & ~np.uint64(1)) | (own_level & np.uint64(1)))
            owners.append(whose)
        name, whose = np.concatenate(found), np.concatenate(owners)
        order = np.argsort(whose, kind="stable")
        return name[order], np.searchsorted(whose[order], np.arange(len(sizes) + 1))


class Inverted:
    """Inverted lists over some documents' sorted shingle names."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        names = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(names, kind="stable")
        names, self.owners = names[order], owners[order]
        head = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.zeros(0, np.int64)
        self.keys = names[head]
        self.start = np.r_[head, len(names)]
        # List and document in one ascending number, for binary search.
        self.entry = np.repeat(np.arange(len(head)), np.diff(self.start)) * len(sets) + self.owners

    def search(self, query: np.ndarray, percent: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """Documents, of those ``wanted``, that link with the query."""
        need = -(-percent * len(query) // 100)
        nothing = np.zeros(0, np.int64)
        if not len(self.keys) or not need:
            return nothing
        at = np.searchsorted(self.keys, query)
        at = at[self.keys[np.minimum(at, len(self.keys) - 1)] == query]
        if len(at) < need:
            return nothing
        lengths = self.start[at + 1] - self.start[at]
        by_length = np.argsort(lengths, kind="stable")
        at, lengths = at[by_length], lengths[by_length]
        # Lists set aside, at most all but one of the needed occurrences.
        aside = min(need - 1, int(need / (PROBE_WEIGHT * np.log2(int(lengths[-1]) + 1) + 1)))
        short = len(at) - aside
        some = lengths[:short]
        places = np.repeat(self.start[at[:short]] - np.r_[0, np.cumsum(some)[:-1]], some) + np.arange(some.sum())
        merged = np.sort(self.owners[places], kind="stable")  # merges the sorted lists
        head = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]])
        count = np.diff(np.r_[head, len(merged)])
        doc = merged[head]
        sizes = self.sizes[doc]
        within = (count >= need - aside) & (100 * sizes >= percent * len(query)) & (percent * sizes <= 100 * len(query))
        if wanted is not None:
            within &= wanted[doc]
        doc, count = doc[within], count[within]
        linked = []
        # Probe the long lists, shortest first, as long as a document is open.
        k, step = short, 8
        while len(doc):
            enough = 100 * count >= percent * (len(query) + self.sizes[doc] - count)
            if enough.any():
                linked.append(doc[enough])
            open_ = ~enough & (count + (len(at) - k) >= need)
            doc, count = doc[open_], count[open_]
            if not len(doc) or k == len(at):
                break
            asked = at[k : k + step, None] * len(self.sizes) + doc
            spot = np.minimum(np.searchsorted(self.entry, asked), len(self.entry) - 1)
            count = count + (self.entry[spot] == asked).sum(axis=0)
            k, step = min(k + step, len(at)), 4 * step
        return np.concatenate(linked) if linked else nothing


def _wholes(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A name of every set; 0 for the empty one."""
    sizes = np.diff(offsets)
    total = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        total[full] = mix(np.add.reduceat(mix(shingles), offsets[full]) + sizes[full].astype(np.uint64))
    return total


def _parities(shingles: np.ndarray, size: int) -> np.ndarray:
    """Parities of the shingles' counts in ``size`` buckets, 64 in a number."""
    count = np.bincount((shingles % np.uint64(size)).astype(np.int64), minlength=size)
    return np.packbits(count & 1).view(np.uint64)


def _sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles' counts in buckets, two or more buckets for each."""
    size = 64
    while size < 2 * len(shingles):
        size *= 2
    return _parities(shingles, size).tobytes()


def _folded(sketch: bytes, size: int) -> int:
    """The sketch of the same set with fewer buckets, as one number."""
    bits, value = 8 * len(sketch), int.from_bytes(sketch, "big")
    # Bucket b stands at bit bits - 1 - b; halving the number joins b and b + half.
    while bits > size:
        bits //= 2
        value = (value >> bits) ^ (value & ((1 << bits) - 1))
    return value


def _half_sketch(column: str) -> Column:
    """Sketches with half their buckets, of 64 at least."""

    @F.arrow_udf("binary")
    def half(sketches: pa.Array) -> pa.Array:
        sizes = [(raw, max(64, 4 * len(raw))) for raw in sketches.to_pylist()]
        return pa.array([_folded(raw, size).to_bytes(size // 8, "big") for raw, size in sizes], pa.binary())

    return half(column)


def _may_link(a: int, b: int, n_a: int, n_b: int, percent: int) -> bool:
    """False only where two sets surely do not link: every bucket whose parity
    differs holds a shingle that the other set lacks."""
    return 100 * min(n_a, n_b) >= percent * max(n_a, n_b) and (a ^ b).bit_count() <= (100 - percent) * (n_a + n_b) // (
        100 + percent
    )


def _named(docs: DataFrame, width: int, rows, schema: str) -> DataFrame:
    def name(batches):
        for batch in portions(batches, "text", 1 << 20):
            data, at = text_bytes(batch.column(1))
            shingles, offsets = shingle_names(data, at, width)
            yield rows(batch.column(0), shingles, offsets)

    return docs.mapInArrow(name, schema)


def set_names(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, whole, sketch) of every row; equal sets have equal wholes."""

    def rows(ids, shingles, offsets):
        sketches = [_sketch(shingles[a:b]) for a, b in zip(offsets, offsets[1:])]
        return pa.record_batch(
            [ids, pa.array(np.diff(offsets), pa.int64()), pa.array(_wholes(shingles, offsets).view(np.int64)),
             pa.array(sketches, pa.binary())],
            ["doc_id", "n_shingles", "whole", "sketch"],
        )

    return _named(docs, width, rows, "doc_id long, n_shingles long, whole long, sketch binary")


def part_names(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(part, whole): the parts that every set leaves."""
    parts = Parts(percent)

    def rows(ids, shingles, offsets):
        names, ends = parts.names(shingles, offsets)
        wholes = np.repeat(_wholes(shingles, offsets), np.diff(ends))
        return pa.record_batch([pa.array(names.view(np.int64)), pa.array(wholes.view(np.int64))], ["part", "whole"])

    return _named(docs, width, rows, "part long, whole long")


def shared_parts(rows: DataFrame) -> DataFrame:
    """The distinct (part, whole) rows of parts that several sets left, in one
    pass over sorted rows that remembers one of them."""

    def walk(batches):
        held, known = None, False  # the last row, and whether its part has others
        for batch in batches:
            part, whole = (batch.column(k).to_numpy() for k in range(2))
            if held is not None:
                part, whole = np.r_[held[0], part], np.r_[held[1], whole]
            if not len(part):
                continue
            keep = np.r_[True, (part[1:] != part[:-1]) | (whole[1:] != whole[:-1])]
            part, whole = part[keep], whole[keep]
            same = part[1:] == part[:-1]
            several = np.r_[known, same] | np.r_[same, False]
            out = np.flatnonzero(several[:-1])
            if len(out):
                yield pa.record_batch([pa.array(part[out]), pa.array(whole[out])], ["part", "whole"])
            held, known = (part[-1], whole[-1]), bool(np.r_[known, same][-1])
        if held is not None and known:
            yield pa.record_batch([pa.array([held[0]]), pa.array([held[1]])], ["part", "whole"])

    return rows.repartition("part").sortWithinPartitions("part", "whole").mapInArrow(walk, "part long, whole long")


def rarest_parts(shared: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(part, whole, n_shingles, met): of the ``shared`` parts of every set those
    that fewest sets left; ``met`` is how many left it.

    Two linked sets have one part more than the spare ones in common on a level.
    Put in one order, the rarest of these has all spare ones behind it, so it is
    among what is left of both when each does without its most crowded ones.
    ``sizes``: (whole, n_shingles).
    """
    parts = Parts(percent)

    @F.arrow_udf("long")
    def spare(sizes: pa.Array, odd: pa.Array) -> pa.Array:
        return pa.array(parts.spares(sizes.to_numpy(), odd.to_numpy()), pa.int64())

    met = shared.groupBy("part").agg(F.count("*").alias("met"))
    level = F.col("part").bitwiseAND(1)
    crowded_first = Window.partitionBy("whole", level).orderBy(F.desc("met"), "part")
    rows = shared.join(met, "part").join(sizes, "whole").withColumn("__place", F.row_number().over(crowded_first))
    return rows.filter(F.col("__place") > spare("n_shingles", level)).select("part", "whole", "n_shingles", "met")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(whole, shingles): sorted distinct names, as little-endian 64-bit values."""

    def rows(ids, shingles, offsets):
        sets = [shingles[a:b].astype("<u8").tobytes() for a, b in zip(offsets, offsets[1:])]
        return pa.record_batch(
            [pa.array(_wholes(shingles, offsets).view(np.int64)), pa.array(sets, pa.binary())], ["whole", "shingles"]
        )

    return _named(docs, width, rows, "whole long, shingles binary")


def _by_key(batches, keys: int):
    """Rows of equal leading columns, which are next to each other, as tables."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        new[0] = last is not None and first != last
        start = 0
        for c in np.flatnonzero(new).tolist():
            if c > start:
                held.append(batch.slice(start, c - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], c
        held.append(batch.slice(start))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u8") for b in column.to_pylist()]


LINK = "a long, b long"


def _links(a: list, b: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def search_from_one(rows: DataFrame, percent: int) -> DataFrame:
    """Links of a group's query document. ``rows``: (group, block, query, whole, shingles)."""

    def search(batches):
        for group in _by_key(batches, 2):
            ids = group.column("whole").to_pylist()
            asks = group.column("query").to_pylist()
            sets = _sets(group.column("shingles"))
            members = [k for k, q in enumerate(asks) if not q]
            index = Inverted([sets[k] for k in members])
            a, b = [], []
            for k, q in enumerate(asks):
                if q:
                    found = index.search(sets[k], percent)
                    a += [ids[k]] * len(found)
                    b += [ids[members[f]] for f in found]
            if a:
                yield _links(a, b)

    return rows.repartition("group", "block").sortWithinPartitions("group", "block").mapInArrow(search, LINK)


def open_in_full(rows: DataFrame, percent: int) -> DataFrame:
    """(group, block, whole, component): the sets of every block that may link,
    by their sketches, with one of another component.

    ``rows``: (group, block, side, apart, whole, component, n_shingles, sketch).
    A block compares its sets with each other, or its sides where it has both.
    Of two linked sets one at least is outside any one component: so only sets
    outside ``apart`` ask, or outside the block's largest component where that
    is NULL.
    """

    def compare(batches):
        for group in _by_key(batches, 2):
            size = group.column("n_shingles").to_numpy()
            component = group.column("component").to_pylist()
            apart, sides = group.column("apart")[0].as_py(), group.column("side").to_numpy()
            if apart is None:
                apart = Counter(component).most_common(1)[0][0]
            raw = group.column("sketch").to_pylist()
            least = 8 * min(map(len, raw))
            bits = np.frombuffer(b"".join(_folded(r, least).to_bytes(least // 8, "big") for r in raw), np.uint64)
            bits = bits.reshape(len(raw), -1)
            _, kind = np.unique(component, return_inverse=True)
            both = 0 < sides.sum() < len(sides)
            open_ = np.zeros(len(raw), bool)
            for k in range(len(raw)):
                if component[k] == apart:
                    continue
                near = kind != kind[k]
                if both:
                    near &= sides != sides[k]
                near = _near(bits, size, k, percent, near)
                open_[near] = True
                open_[k] |= len(near) > 0
            if open_.any():
                found = group.select(["group", "block", "whole", "component"]).filter(pa.array(open_))
                yield from found.combine_chunks().to_batches()

    return (
        rows.repartition("group", "block")
        .sortWithinPartitions("group", "block")
        .mapInArrow(compare, "group long, block int, whole long, component long")
    )


def _near(bits: np.ndarray, size: np.ndarray, k: int, percent: int, of: np.ndarray) -> np.ndarray:
    """The sets ``of`` a block that may link with its set ``k``; as ``_may_link``, for all at once."""
    near = np.flatnonzero(of & (100 * np.minimum(size, size[k]) >= percent * np.maximum(size, size[k])))
    differ = np.bitwise_count(bits[near] ^ bits[k]).sum(axis=1, dtype=np.int64)
    return near[differ <= (100 - percent) * (size[near] + size[k]) // (100 + percent)]


def search_in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links that join the components of every block, none between sets that
    others of its links join. ``rows``: (group, block, whole, component, shingles)."""

    def search(batches):
        for group in _by_key(batches, 2):
            wholes, sets = group.column("whole").to_pylist(), _sets(group.column("shingles"))
            _, kind = np.unique(group.column("component").to_numpy(), return_inverse=True)
            size = np.array([len(s) for s in sets], np.int64)
            wide = max(64, 1 << int(4 * size.max()).bit_length())
            index, bits = Inverted(sets), None
            a, b = [], []
            for k in np.flatnonzero(kind != np.bincount(kind).argmax()).tolist():
                other = kind != kind[k]
                if not other.any():
                    break
                if bits is None:
                    bits = np.stack([_parities(s, wide) for s in sets])
                near = _near(bits, size, k, percent, other)
                if not len(near):
                    continue
                wanted = np.zeros(len(sets), bool)
                wanted[near] = True
                for f in index.search(sets[k], percent, wanted).tolist():
                    if kind[f] != kind[k]:
                        a.append(wholes[k])
                        b.append(wholes[f])
                        kind[kind == kind[f]] = kind[k]
            if a:
                yield _links(a, b)

    return rows.repartition("group", "block").sortWithinPartitions("group", "block").mapInArrow(search, LINK)


def _block_links(rows: DataFrame, class_of: DataFrame, known: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of the blocks of ``open_in_full``. Blocks with the same sets are
    searched once; their sets are made from the texts of ``known`` anew."""
    once = (
        rows.groupBy("group", "block")
        .agg(F.sum(F.col("whole").cast("decimal(38,0)")).alias("who"), F.count("*").alias("n"))
        .groupBy("who", "n").agg(F.min(F.struct("group", "block")).alias("first"))
        .select("first.group", "first.block")
    )
    rows = stored(rows.join(once, ["group", "block"]), "open-blocks")
    needed = rows.select("whole").distinct().join(class_of, "whole").select(F.col("class").alias("doc_id"))
    # One set of a name, though repeated rows of an id bring theirs again.
    sets = shingle_sets(known.join(needed, "doc_id", "left_semi"), width)
    sets = sets.groupBy("whole").agg(F.first("shingles").alias("shingles"))
    rows = rows.join(sets, "whole").select("group", "block", "whole", "component", "shingles")
    return stored(search_in_blocks(rows, percent), "links")


def _star_links(pairs: DataFrame, class_of: DataFrame, known: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Links of each ``group`` with the ``whole`` rows beside it. Only pairs that
    may link by their sketches are searched with their sets, which are made from
    the texts of ``known`` anew: kept for all calls they are larger than the texts."""

    @F.arrow_udf("boolean")
    def may_link(a: pa.Array, n_a: pa.Array, b: pa.Array, n_b: pa.Array) -> pa.Array:
        out = []
        for x, n_x, y, n_y in zip(*(c.to_pylist() for c in (a, n_a, b, n_b))):
            size = 8 * min(len(x), len(y))
            out.append(_may_link(_folded(x, size), _folded(y, size), n_x, n_y, percent))
        return pa.array(out, pa.bool_())

    one = class_of.select(F.col("whole").alias("group"), F.col("sketch").alias("sketch_a"), F.col("n_shingles").alias("n_a"))
    two = class_of.select("whole", F.col("sketch").alias("sketch_b"), F.col("n_shingles").alias("n_b"))
    near = pairs.join(one, "group").join(two, "whole").filter(may_link("sketch_a", "n_a", "sketch_b", "n_b"))
    pairs = stored(near.select("group", "whole"), "star-pairs")
    counts = pairs.groupBy("group").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    members = pairs.join(counts, "group").select(
        "group", F.pmod(F.xxhash64("whole"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("query"), "whole"
    )
    asking = counts.select(
        "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(True).alias("query"), F.col("group").alias("whole"),
    )
    rows = members.unionByName(asking)
    needed = rows.select("whole").distinct().join(class_of, "whole").select(F.col("class").alias("doc_id"))
    # Repeated rows of one id bring their set twice, and at most a link twice.
    sets = shingle_sets(known.join(needed, "doc_id", "left_semi"), width)
    rows = rows.join(sets, "whole").select("group", "block", "query", "whole", "shingles")
    return stored(search_from_one(rows, percent), "links")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = rows.filter(F.col("doc_id").isNotNull())
    signed = stored(set_names(rows, width), "set-names")

    # 1. Classes of equal sets.
    sized = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    class_of = stored(
        sized.groupBy("whole").agg(
            F.min("doc_id").alias("class"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
        ),
        "classes",
    )
    same = sized.join(class_of, "whole").select(F.col("doc_id").alias("a"), F.col("class").alias("b"))

    def by_class(links):
        """Links of wholes as links of documents."""
        a = class_of.select(F.col("whole").alias("a"), F.col("class").alias("class_a"))
        b = class_of.select(F.col("whole").alias("b"), F.col("class").alias("class_b"))
        return links.join(a, "a").join(b, "b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))

    # 2. Groups of sets with a part in common, each searched from one in the middle.
    shared = stored(shared_parts(part_names(known, width, percent)), "shared-parts")
    rare = stored(rarest_parts(shared, class_of.select("whole", "n_shingles"), percent), "rare-parts")
    # How many rows a set meets in its groups; any order would lose no link.
    met = rare.groupBy("whole").agg(F.sum("met").alias("met"))
    groups = stored(rare.drop("met").join(met, "whole"), "met-parts")
    links = same
    for _ in range(STAR_ROUNDS):
        middle = groups.groupBy("part").agg(F.max(F.struct("met", "whole", "n_shingles")).alias("first"))
        middle = middle.select("part", F.col("first.whole").alias("group"), F.col("first.n_shingles").alias("n_group"))
        others = groups.select("part", "whole", "n_shingles", "met").join(middle, "part").filter(F.col("whole") != F.col("group"))
        # Sets of too different a size cannot link, and go before a sketch is moved.
        like = 100 * F.least("n_shingles", "n_group") >= percent * F.greatest("n_shingles", "n_group")
        pairs = others.filter(like).select("group", "whole").distinct()
        links = links.unionByName(by_class(_star_links(pairs, class_of, known, width, percent, block)))
        # This one has been compared with all; the others go on if they are
        # still in several components.
        at = class_of.select("whole", "class").join(components(links), F.col("class") == F.col("node"), "left").select(
            "whole", F.coalesce("component", "class").alias("component")
        )
        others = others.select("part", "whole", "n_shingles", "met").join(at, "whole")
        several = others.groupBy("part").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        several = several.filter(F.col("low") < F.col("high")).select("part", "low")
        groups = stored(others.join(several, "part"), "open-groups")

    # 3. Groups that are still in several components, searched in full.
    several = (
        groups.groupBy("part")
        .agg(F.first("low").alias("low"), F.sum(F.col("whole").cast("decimal(38,0)")).alias("who"), F.count("*").alias("n"))
        .groupBy("who", "n").agg(F.min("part").alias("part"), F.min("low").alias("low"))
        .withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
        .select("part", "blocks", F.when(F.col("blocks") > 1, F.col("low")).alias("apart"))
    )
    members = groups.drop("low", "n_shingles", "met").join(several, "part").withColumn("own", F.pmod(F.xxhash64("whole"), F.col("blocks")).cast("int"))
    members = stored(members, "open-members")
    # What moves to the blocks is half a sketch; what it leaves is searched by its sets.
    half = stored(class_of.select("whole", "n_shingles", _half_sketch("sketch").alias("sketch")), "half-sketches")
    turns = []
    for turn in range(TURNS):
        some = members.filter(F.pmod(F.xxhash64("part"), F.lit(TURNS)) == turn)
        # Block (i, j) searches the sets of i against those of j.
        some = some.select(
            F.col("part").alias("group"), "whole", "component", "own", "blocks", "apart",
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
        ).select(
            "group", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("block"),
            F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "apart", "whole", "component",
        )
        found = open_in_full(
            some.join(half, "whole").select(
                "group", "block", "side", "apart", "whole", "component", "n_shingles", "sketch"
            ),
            percent,
        )
        turns.append(stored(found, "open-sets"))
    full = _block_links(reduce(DataFrame.unionByName, turns), class_of, known, width, percent)
    found = components(links.unionByName(by_class(full)))
    return (
        signed.select("doc_id", "n_shingles")
        .join(found, F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )

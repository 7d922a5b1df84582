"""Documents that hold benchmark questions, also with other names and numbers.

A text becomes a row of canonical tokens: runs of letters and digits, lower
case, with typed placeholders for numbers, names (capitalised words, the first
of a sentence included, since a name may stand there, but no word in capitals
throughout) and units. Windows of the
row are templates. A document's templates are hash-joined with the benchmark's;
where they meet, the values in the slots must correspond one to one along the
passage: one value for each value of the question, and back. A document holds a
question when consistent windows cover ``least_cover`` of its tokens.

Before the join, documents' windows are tested on a bitmap of fixed size that
the benchmark's windows set; a larger benchmark lets more windows through to
the join and changes no result.

NULL and empty texts have no tokens. A question with fewer tokens than a window
is one template, met by texts of just those tokens if half of them are literal.
All other places and windows are searched too: short questions anywhere in a
document, as templates where they have as many literal tokens as a window must
have, and by their own values whatever they have; and windows with fewer literal
tokens than half by the values in their slots. A copy of any question is so
found, however short it is and whatever it consists of; a question of one common
word is in every document that has the word. Rows with equal ids are one
document; rows without an id are not reported. Repeated benchmark rows count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posevidence.llm.common import _BYTES, _LOWER, _POWERS, mix, pair_hash, portions, text_bytes
from posevidence.llm.repeats import doubled, spread

WINDOW = 8
LEAST_COVER = 0.5
#: Kinds of windows: templates; templates of short questions that may stand
#: anywhere; windows of values.
TEMPLATE, PART, VALUES = range(3)
#: Bits of the bitmap: 16 MB, whatever the benchmark's size.
BITMAP_BITS = 27
_CHUNK_BITS = 15

# Words that name a unit.
UNITS = (
    "mm cm m km in ft yd mi mile miles meter meters metre metres foot feet inch inches yard yards mg g kg t lb lbs oz "
    "gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur gbp percent degree degrees mph kmh kph hz khz mhz ghz kb mb gb tb "
    "watt watts kw kwh volt volts amp amps joule joules kj"
).split()

NUMBER, NAME, UNIT = (np.uint64(k) for k in (0x11, 0x22, 0x33))
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_JOINT = np.zeros(256, bool)
_JOINT[[ord(c) for c in ".,:/"]] = True


def _token_names(data, starts, ends, inside=None):
    place = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
    lower = _LOWER[data]
    # Two-byte capitals of Latin letters with accents.
    lower[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 0x20
    value = _BYTES[lower] * (_POWERS[place & 63] + (place >> 6).astype(np.uint64))
    value[~(_INSIDE[data] if inside is None else inside)] = 0
    return mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))


def _unit_names() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    inside = _INSIDE[data]
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    ends = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    return np.sort(_token_names(data, starts, ends))


_UNIT_NAMES = _unit_names()


def canonical(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical name, first and end byte of every token, and tokens before each text."""
    inside = _INSIDE[data]
    first = inside & ~np.r_[False, inside[:-1]] if len(data) else inside
    last = inside & ~np.r_[inside[1:], False] if len(data) else inside
    edges = at[at < len(data)]
    first[edges] = inside[edges]
    edges = at[at > 0] - 1
    last[edges] = inside[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, np.zeros(len(at), np.int64)
    names = _token_names(data, starts, ends)
    lead = data[starts]
    number = _DIGIT[lead]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    # A word in capitals throughout is shouted, not a name.
    final, inner = data[ends - 1], data[np.maximum(ends - 2, 0)]
    longer = ends - starts > 1 + (lead == 0xC3)
    capital &= ~(longer & (((final >= 65) & (final <= 90)) | ((inner == 0xC3) & (final >= 0x80) & (final <= 0x9E))))
    spot = np.minimum(np.searchsorted(_UNIT_NAMES, names), len(_UNIT_NAMES) - 1)
    unit = (_UNIT_NAMES[spot] == names) & ~capital
    names[unit] = UNIT
    names[capital] = NAME
    names[number] = NUMBER
    # One number may be written with points and commas.
    text = np.searchsorted(at, starts, "right")
    part = np.zeros(len(starts), bool)
    part[1:] = (
        number[1:] & number[:-1] & (starts[1:] - ends[:-1] == 1) & _JOINT[data[starts[1:] - 1]] & (text[1:] == text[:-1])
    )
    whole = ~part
    heads = np.flatnonzero(whole)
    ends = ends[np.r_[heads[1:] - 1, len(ends) - 1]]
    return names[whole], starts[whole], ends, np.searchsorted(starts[whole], at)


def _is_slot(names: np.ndarray) -> np.ndarray:
    return (names == NUMBER) | (names == NAME) | (names == UNIT)


def _windows(names, before):
    """Names of windows, their first tokens, widths and texts."""
    sizes = np.diff(before)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(names)) - before[text] if len(names) else np.zeros(0, np.int64)
    width = np.minimum(sizes, WINDOW)[text] if len(names) else np.zeros(0, np.int64)
    first = np.flatnonzero(place + width <= sizes[text]) if len(names) else np.zeros(0, np.int64)
    padded = np.concatenate([names, np.zeros(WINDOW, np.uint64)])
    # Tokens after a short text's end do not count.
    full = width[first] == WINDOW if len(first) else np.zeros(0, bool)
    value, length, step = padded, 1, 0
    while length < WINDOW:
        value, length, step = doubled(value, length, step), 2 * length, step + 1
    window = spread(value[first]) if len(first) else np.zeros(0, np.uint64)
    for k in np.flatnonzero(~full):
        own = np.zeros(WINDOW, np.uint64)
        own[: width[first[k]]] = names[first[k] : first[k] + width[first[k]]]
        length, step = 1, 0
        while length < WINDOW:
            own, length, step = doubled(own, length, step), 2 * length, step + 1
        window[k] = spread(own)[0] ^ np.uint64(int(width[first[k]]))
    slots = np.concatenate([[0], np.cumsum(_is_slot(names))])
    literal = width[first] - (slots[first + width[first]] - slots[first])
    good = 2 * literal >= width[first]
    return window[good], first[good], width[first][good], text[first][good]


def _values(data, starts, ends):
    """Names of tokens by their own letters and digits, lower case; a number's
    points and commas belong to it."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    return _token_names(data, starts, ends, np.cumsum(step)[:-1] > 0)


def _cut(names, before, widths):
    """Windows of the given widths at every place: width, names, first tokens, texts."""
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    left = before[text + 1] - np.arange(len(names))
    window = mix(names)
    for width in range(1, min(max(widths, default=0), len(names)) + 1):
        if width > 1:
            window = pair_hash(window[:-1], names[width - 1 :])
        if width in widths:
            first = np.flatnonzero(left[: len(window)] >= width)
            yield width, window[first], first, text[first]


def _others(names, values, before, widths=None):
    """Windows of short questions and of values, with their kinds: of questions, or of
    documents where the widths of the questions' windows of each kind are given."""
    sizes = np.diff(before)
    slots = np.concatenate([[0], np.cumsum(_is_slot(names))])
    all_widths = {PART: range(1, WINDOW), VALUES: range(1, WINDOW + 1)}
    for kind, own in ((PART, names), (VALUES, values)):
        for width, window, first, text in _cut(own, before, (widths or all_widths)[kind]):
            literal = width - (slots[first + width] - slots[first])
            good = literal >= WINDOW // 2 if kind == PART else np.ones(len(first), bool)
            if widths is None:
                good &= np.minimum(sizes[text], WINDOW) == width
                if kind == VALUES:
                    good &= (sizes[text] < WINDOW) | (2 * literal < width)
            window = mix(window ^ np.uint64(kind << 8 | width))
            yield window[good], first[good], np.full(int(good.sum()), width), text[good], np.full(int(good.sum()), kind)


WINDOW_SCHEMA = "window long, id long, at int, width int, kind int, n_tokens int, slots array<string>"


def _templates(bits=None, widths=None):
    """Windows of texts; with a bitmap, only those it lets through."""

    def make(batches):
        bitmap = bits.value if bits is not None else None
        for batch in portions(batches, "text", 1 << 20):
            data, at = text_bytes(batch.column(1))
            names, starts, ends, before = canonical(data, at)
            plain = _windows(names, before)
            parts = [(*plain, np.full(len(plain[0]), TEMPLATE))]
            wanted = widths is None or widths[VALUES]
            parts += _others(names, _values(data, starts, ends) if wanted else names, before, widths)
            if bitmap is not None:
                for n, part in enumerate(parts):
                    place = part[0] >> np.uint64(64 - BITMAP_BITS)
                    seen = (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    parts[n] = tuple(column[seen] for column in part)
            window, first, width, text, kind = (np.concatenate(column) for column in zip(*parts))
            slot = _is_slot(names)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            values = []
            for f, w, own in zip(first.tolist(), width.tolist(), (kind == VALUES).tolist()):
                values.append([
                    data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace").lower() if own or slot[k] else None
                    for k in range(f, f + w)
                ])
            yield pa.record_batch(
                [pa.array(window.view(np.int64)), pa.array(ids[text], pa.int64()),
                 pa.array((first - before[text]).astype(np.int32)), pa.array(width.astype(np.int32)),
                 pa.array(kind.astype(np.int32)),
                 pa.array(np.diff(before)[text].astype(np.int32)), pa.array(values, pa.list_(pa.string()))],
                ["window", "id", "at", "width", "kind", "n_tokens", "slots"],
            )

    return make


def _bitmap(templates: DataFrame) -> np.ndarray:
    """The bitmap of all windows, put together chunk by chunk on the cluster."""

    def chunk(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _CHUNK_BITS, np.uint8)
        bits[table.column("bit").to_numpy()] = 1
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([packed], pa.binary())})

    places = templates.select(F.shiftrightunsigned("window", 64 - BITMAP_BITS).alias("place")).distinct()
    chunks = (
        places.select(
            F.shiftright("place", _CHUNK_BITS).cast("int").alias("chunk"),
            F.col("place").bitwiseAND((1 << _CHUNK_BITS) - 1).cast("int").alias("bit"),
        )
        .groupBy("chunk")
        .applyInArrow(chunk, "chunk int, bits binary")
        .collect()
    )
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    size = 1 << (_CHUNK_BITS - 3)
    for row in chunks:
        out[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def _consistent(rows: list[dict]) -> tuple[int, bool]:
    """Tokens of the question that consistent windows cover; whether all slots agree."""
    covered: set[int] = set()
    same = True
    diagonals: dict[int, list[dict]] = {}
    for row in rows:
        diagonals.setdefault(row["at"] - row["item_at"], []).append(row)
    for _, windows in sorted(diagonals.items()):
        there: dict[str, str] = {}
        back: dict[str, str] = {}
        for row in sorted(windows, key=lambda r: r["item_at"]):
            pairs = [(a, b) for a, b in zip(row["item_slots"], row["slots"]) if a is not None]
            if any(there.get(a, b) != b or back.get(b, a) != a for a, b in pairs):
                continue
            if any({a: b for a, b in pairs}[a] != b or {b: a for a, b in pairs}[b] != a for a, b in pairs):
                continue
            there.update(pairs)
            back.update((b, a) for a, b in pairs)
            same &= all(a == b for a, b in pairs)
            covered.update(range(row["item_at"], row["item_at"] + len(row["slots"])))
    return len(covered), same


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least_cover: float = LEAST_COVER, doc_id: str = "doc_id",
    text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_covered, n_tokens, exact): questions that documents hold."""
    spark = docs.sparkSession
    items = (
        benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text"))
        .filter(F.col("id").isNotNull())
        .distinct()
    )
    # A question may be shouted; its names are then words like others.
    shouted = items.withColumn("text", F.upper("text"))
    asked = items.unionByName(shouted).mapInArrow(_templates(), WINDOW_SCHEMA).distinct()
    widths: dict[int, set[int]] = {PART: set(), VALUES: set()}
    for row in asked.filter(F.col("kind") != TEMPLATE).select("kind", "width").distinct().collect():
        widths[row["kind"]].add(row["width"])
    bits = spark.sparkContext.broadcast(_bitmap(asked))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull())
    found = rows.mapInArrow(_templates(bits, widths), WINDOW_SCHEMA)
    met = found.select("window", F.col("id").alias("doc_id"), "at", "width", "kind", "slots").join(
        asked.select(
            "window", F.col("kind").alias("item_kind"), F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("width").alias("item_width"),
            "n_tokens", F.col("slots").alias("item_slots"),
        ),
        "window",
    ).filter((F.col("width") == F.col("item_width")) & (F.col("kind") == F.col("item_kind")))

    def judge(batches):
        held, last = [], None

        def close():
            covered, same = _consistent(held)
            size = held[0]["n_tokens"]
            if covered >= least_cover * size:
                return pa.record_batch(
                    [pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([covered], pa.int32()),
                     pa.array([size], pa.int32()), pa.array([same])],
                    ["doc_id", "item_id", "n_covered", "n_tokens", "exact"],
                )
            return None

        for batch in batches:
            for row in batch.to_pylist():
                key = row["doc_id"], row["item_id"]
                if key != last and held:
                    if (out := close()) is not None:
                        yield out
                    held = []
                last = key
                held.append(row)
        if held and (out := close()) is not None:
            yield out

    return (
        met.select("doc_id", "item_id", "at", "item_at", "n_tokens", "slots", "item_slots")
        .repartition("doc_id", "item_id")
        .sortWithinPartitions("doc_id", "item_id")
        .mapInArrow(judge, "doc_id long, item_id long, n_covered int, n_tokens int, exact boolean")
    )

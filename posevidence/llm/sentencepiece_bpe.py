"""Encoding into, and decoding from, the pieces of a merge-type SentencePiece model.

Greedy merging has one result for every text, and a row of pieces is that
result exactly when each piece and each pair of neighbours, encoded alone, is
left as it is: merges on both sides of a kept boundary do not see each other.
So every prefix of a text has one last piece. ``PrefixTable`` finds it from
left to right: an automaton reports the pieces that end at a place, and the one
is stored that is compatible with the last piece of the prefix before it. The
pieces are read back from the end of the table.

No piece holds a space mark or most punctuation after a letter. The text is
cut there into segments; a segment's pieces do not depend on its neighbours,
and recurring words and segments are kept in one bounded cache, their ids as bytes
of the model's width, which join without a loop. The cache forgets what has not
been used for long; it goes, with the table, where another operator begins in the
worker process, which lives on through the stages that follow.

NULL and empty texts give no ids; no text is cut, whatever its length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posevidence.llm.common import kept_by, strings

SPACE = "▁"
#: Bounds of the caches of one worker process, in entries.
CACHE = 1 << 20
PAIR_CACHE = 1 << 19
#: Longer segments are encoded without being kept.
CACHED_LENGTH = 48


class PrefixTable:
    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = {}
        self.ids, self.score = {}, {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.score[piece] = model.get_score(i)
        self.dtype = np.dtype("<u2" if len(self.pieces) <= 1 << 16 else "<u4")
        self.packed = {p: self._bytes([i]) for p, i in self.ids.items()}
        self.unknown = model.unk_id()
        self.silent = {i for i in range(len(self.pieces)) if model.is_control(i)}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("this model has pieces that cross a space mark")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            # A piece that its own encoding splits never occurs.
            if self.merged(piece) == [piece]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.words, self.segments = self._cuts()
        self.compatible = _Cache(self._stays, PAIR_CACHE)
        self.word_ids = _Cache(self.encode_word, CACHE, CACHED_LENGTH)

    def _cuts(self) -> tuple[re.Pattern, re.Pattern]:
        """Patterns of the words of a text, and of the segments of a word.

        A word begins with its blanks, which stand for space marks; a character
        that no longer piece holds stands alone. Within a word, signs that no piece holds after a
        letter begin a segment.
        """
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        lone = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        words = f" *[^ {lone}]+| +" + (f"|[{lone}]" if lone else "")
        after_letter = {b for p in self.ids for a, b in zip(p, p[1:]) if a.isalpha()}
        letters = "".join(sorted(c for c in {*"".join(self.ids)} if c.isalpha() and ord(c) < 1 << 16))
        cut = "".join(re.escape(c) for c in "!#$%&*,.;:?|" if c not in after_letter)
        other, going = f"[^{letters}]", f"[^{letters}{cut}]"
        return re.compile(words), re.compile(
            f"(?s:(?=.){other}*[{letters}]*(?:{going}{other}*[{letters}]*)*)"
        )

    def merged(self, text: str) -> list[str]:
        """Greedy merging, best score and then leftmost first; for short texts."""
        parts, score, none = list(text), self.score, -np.inf
        gains = [score.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while gains:
            best = max(gains)
            if best == none:
                break
            k = gains.index(best)
            joined = parts[k] + parts.pop(k + 1)
            parts[k] = joined
            del gains[k]
            if k:
                gains[k - 1] = score.get(parts[k - 1] + joined, none)
            if k < len(gains):
                gains[k] = score.get(joined + parts[k + 1], none)
        return parts

    def _stays(self, pair: tuple[str, str]) -> bool:
        """Whether two neighbouring pieces, encoded together, stay two."""
        return self.merged(pair[0] + pair[1]) == [*pair]

    def last_pieces(self, segment: str) -> list[str]:
        """For every prefix of the segment, its last piece."""
        last = [""] * (len(segment) + 1)
        compatible = self.compatible
        reached = 0
        for end, piece in self.automaton.iter(segment):
            end += 1
            while reached < end - 1:  # characters that no piece ends at
                reached += 1
                if not last[reached]:
                    last[reached] = segment[reached - 1]
            if last[end]:
                continue
            start = end - len(piece)
            if start:
                before = last[start]
                known = compatible.get((before, piece))
                if not (compatible[before, piece] if known is None else known):
                    continue
            last[end] = piece
            reached = end
        for k in range(1, len(last)):
            if not last[k]:
                last[k] = segment[k - 1]
        return last

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def encode_segment(self, segment: str) -> bytes:
        last = self.last_pieces(segment)
        packed = self.packed
        found, at = [], len(segment)
        while at:
            piece = last[at]
            at -= len(piece)
            own = packed.get(piece)
            if own is None:
                # Without byte pieces a character stands for itself and is unknown.
                own = self._bytes([self.bytes[b] for b in piece.encode("utf-8")] if self.bytes else [self.unknown])
            found.append(own)
        found.reverse()
        return b"".join(found)

    def encode_word(self, word: str) -> bytes:
        marked = word.replace(" ", SPACE)
        parts = self.segments.findall(marked)
        if len(parts) == 1:
            return self.encode_segment(marked)
        kept, found = self.word_ids, []
        for part in parts:
            key = part.replace(SPACE, " ")
            ids = kept.get(key)
            found.append(kept.made(key, self.encode_segment, part) if ids is None else ids)
        return b"".join(found)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        # Words are kept with blanks for space marks, which take half the memory.
        words = self.words.findall(" " + text.replace(SPACE, " "))
        return np.frombuffer(b"".join(map(self.word_ids.__getitem__, words)), self.dtype)


class _Cache(dict):
    """Results of a function, as many as a worker process may keep: at most ``most``.

    Where half of them are new, those that were not asked for since the last time
    that this was so are forgotten. Keys longer than ``longest`` are not kept.
    """

    def __init__(self, make, most: int, longest: int = 1 << 30):
        self.make, self.most, self.longest = make, most, longest
        self.before: dict = {}

    def __missing__(self, key):
        return self.made(key, self.make, key)

    def made(self, key, make, of):
        """The result for a key that is not held now: ``make(of)``."""
        found = self.before.get(key)
        if found is None:
            found = make(of)
        if len(key) <= self.longest:
            if len(self) >= self.most // 2:
                self.before = dict(self)
                self.clear()
            self[key] = found
        return found


class Decoder:
    def __init__(self, table: PrefixTable):
        self.table = table
        self.byte_of = {i: b for b, i in table.bytes.items()}
        self.shown = [p.replace(SPACE, " ") for p in table.pieces]
        for i in table.silent:
            self.shown[i] = ""
        self.shown[table.unknown] = " ⁇ "
        for i, b in self.byte_of.items():
            if b < 0x80:
                self.shown[i] = chr(b)
        self.high = np.zeros(len(table.pieces), bool)
        self.high[[i for i, b in self.byte_of.items() if b >= 0x80]] = True

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[~np.isin(ids, list(self.table.silent))] if len(ids) and self.table.silent else ids
        if not len(ids):
            return ""
        if self.high[ids].any():
            text = self._with_runs(ids)
        else:
            text = "".join(map(self.shown.__getitem__, ids.tolist()))
        return text[1:] if self.table.pieces[ids[0]].startswith(SPACE) else text

    def _with_runs(self, ids: np.ndarray) -> str:
        out, run = [], bytearray()
        for i in ids.tolist():
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            out.append(_characters(run))
            run.clear()
            out.append(self.shown[i])
        out.append(_characters(run))
        return "".join(out)


def _characters(run: bytearray) -> str:
    """UTF-8 characters of a byte run; a byte that begins none is U+FFFD."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def table(model_path: str) -> PrefixTable:
    """One table for each worker process."""
    tables = kept_by("sentencepiece")
    if model_path not in tables:
        tables[model_path] = PrefixTable(model_path)
    return tables[model_path]


def ids_of(text: Column, model_path: str) -> Column:
    """array<int>: the ids of a text, without begin or end ids."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        own = table(model_path)
        found = [own.encode(t) for t in strings(texts)]
        offsets = np.cumsum([0, *map(len, found)])
        flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))

    return encode(text)


def text_of(ids: Column, model_path: str) -> Column:
    """string: the text that ids stand for; NULL and no ids give an empty text."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        decoder = Decoder(table(model_path))
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        flat = lists.values.to_numpy(zero_copy_only=False)
        at = lists.offsets.to_numpy()
        whole = lists.is_valid().to_numpy(zero_copy_only=False)
        return pa.array(
            [decoder.decode(flat[a:b]) if ok else "" for a, b, ok in zip(at, at[1:], whole)], pa.string()
        )

    return decode(ids)


def encoded(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with its ids; a column already named ``ids`` is replaced."""
    return docs.withColumn(ids, ids_of(F.col(text), model_path))


def decoded(docs: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    return docs.withColumn(text, text_of(F.col(ids), model_path))

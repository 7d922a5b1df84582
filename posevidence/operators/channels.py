"""Channels: decoding a mask, the channels present, the channels left out."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits per machine word a mask is cut into.
_WORD = 62


class ChannelDecoder:
    """Adds channel names and numbers to rows that carry a mask.

    The channel dimension has an entry for a bit of the mask, so it is never
    longer than a mask is wide. It becomes part of the expression: the stretches
    of the mask any channel uses are read as words, each channel tests its bit,
    and every row is decoded where it stands, in generated code, without a join
    or a shuffle. Entries that share a bit are listed in the order of their
    names; an entry without a name adds its number only.
    """

    def __init__(self, channels: DataFrame):
        rows = channels.select(F.col("bitpos").cast("int").alias("bitpos"), "name").collect()
        self._inline = sorted(
            ((r.bitpos, r.name) for r in rows if r.bitpos is not None and r.bitpos >= 0),
            key=lambda c: (c[0], c[1] is None, c[1] or ""),
        )

    def _with_words(self, df: DataFrame, mask: str) -> DataFrame:
        """The mask's used stretches as integers, low word first."""
        used = sorted({b // _WORD for b, _ in self._inline})
        words = {}
        for k in used:
            # Bits [k * _WORD, (k + 1) * _WORD) from the right; a shorter mask
            # has none of the missing ones.
            upto = F.right(F.col(mask), F.lit((k + 1) * _WORD))
            low = F.lit(k * _WORD)
            bits = F.left(upto, F.greatest(F.length(upto) - low, F.lit(0))) if k else upto
            words[f"__word{k}"] = F.coalesce(F.conv(bits, 2, 10).try_cast("bigint"), F.lit(0))
        return df.withColumns(words)

    def _bit(self, bitpos: int) -> Column:
        return F.getbit(F.col(f"__word{bitpos // _WORD}"), F.lit(bitpos % _WORD)) == 1

    def _any_set(self) -> Column:
        masks: dict[int, int] = {}
        for b, _ in self._inline:
            masks[b // _WORD] = masks.get(b // _WORD, 0) | (1 << b % _WORD)
        tests = [F.col(f"__word{k}").bitwiseAND(F.lit(m).cast("bigint")) != 0 for k, m in masks.items()]
        return reduce(or_, tests, F.lit(False))

    def add(self, df: DataFrame, mask: str = "groups", numbers: bool = True) -> DataFrame:
        """``channels`` (and ``channel_numbers``), NULL when no bit is set."""
        def listed(separator: str, texts: list[str]) -> Column:
            set_ones = [F.when(self._bit(b), F.lit(x).cast("string")) for (b, _), x in zip(self._inline, texts)]
            return F.concat_ws(separator, *set_ones)

        found = self._with_words(df, mask)
        any_set = self._any_set()
        added = {"channels": F.when(any_set, listed(", ", [n for _, n in self._inline]))}
        if numbers:
            added["channel_numbers"] = F.when(any_set, listed(",", [str(b) for b, _ in self._inline]))
        return found.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(n) for n, c in added.items()])

    def present(self, rows: DataFrame, mask: str = "groups") -> DataFrame:
        """The channels at least one row carries, as (bitpos, name)."""
        # One flag per channel, combined map-side to a single row.
        flags = self._with_words(rows.select(mask), mask).agg(
            *[F.max(self._bit(b)).alias(f"f{i}") for i, (b, _) in enumerate(self._inline)],
            F.lit(True).alias("any"),
        )
        entries = F.array(
            *[
                F.struct(F.lit(b).alias("bitpos"), F.lit(n).cast("string").alias("name"), F.col(f"f{i}").alias("seen"))
                for i, (b, n) in enumerate(self._inline)
            ]
        ).cast("array<struct<bitpos:int,name:string,seen:boolean>>")
        return (
            flags.select(F.explode(entries).alias("c")).filter(F.col("c.seen")).select("c.bitpos", "c.name")
        )


def excluded_channels(available: DataFrame, selected: tuple[int, ...] | None) -> DataFrame:
    """One row: the state of the answer and the sorted names left out.

    ``no filter`` has no names (NULL): nothing was left out on purpose.
    ``verified`` lists what was present and not selected, possibly nothing
    (an empty list). A caller whose channel query failed reports ``unknown``.
    ``names`` is an array, since a name may hold any separator.
    """
    if selected is None:
        return available.sparkSession.range(1).select(
            F.lit("no filter").alias("state"), F.lit(None).cast("array<string>").alias("names")
        )
    left_out = available.filter(~F.col("bitpos").isin([int(c) for c in selected]))
    return left_out.agg(
        F.lit("verified").alias("state"),
        F.sort_array(F.collect_list("name")).alias("names"),
    )


def excluded_channels_unknown(spark) -> DataFrame:
    return spark.range(1).select(
        F.lit("unknown").alias("state"), F.lit(None).cast("array<string>").alias("names")
    )

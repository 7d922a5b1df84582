"""Quality rules whose thresholds follow the corpus.

Fixed rules reject what no corpus wants. For the rest, each rate of a document
is held against fences of its language and source: quartiles from mergeable
quantile sketches, widened by three times their distance. They are widened by a
rate's ``step`` at least, so a group whose documents are all alike rejects none
of them for small differences; there is no bound that all groups share.
Everything is built from DataFrame functions; no text leaves its row.

NULL and empty texts have no words and fail the fixed rules. A NULL language or
source is a group like any other. Rows are judged one by one: repeated rows and
equal ids get equal verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posevidence.llm.common import WORD_SEPARATORS, stored

#: Accuracy of the quantile sketches: ranks are exact to 1 / ACCURACY.
ACCURACY = 1000
#: Fences lie this many quartile distances outside the quartiles.
REACH = 3.0
#: (rate, whether it may also be too low, step): the least distance of a fence
#: from its quartile.
RATES = (
    ("symbol_rate", False, 0.05),
    ("dup_line_rate", False, 0.1),
    ("repeat_rate", False, 0.05),
    ("mean_word_chars", True, 0.5),
)
_WINDOW = 5


def _split(text: Column) -> Column:
    return F.filter(F.split(text, WORD_SEPARATORS), lambda w: w != "")


def _windows(names: Column) -> Column:
    """Names of the words' windows, one for each place that starts one."""
    count = F.greatest(F.size(names) - (_WINDOW - 1), F.lit(0))
    out = F.slice(names, 1, count)
    for k in range(1, _WINDOW):
        out = F.zip_with(out, F.slice(names, k + 1, count), lambda a, b: F.xxhash64(a, b))
    return out


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    and n_lines; columns of these names are replaced."""
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumn("_words", _split(body))
    step = step.withColumn("_names", F.transform("_words", lambda w: F.xxhash64(w)))
    step = step.withColumn(
        "_lines", F.filter(F.split(body, "\n"), lambda s: F.length(F.regexp_replace(s, WORD_SEPARATORS, "")) > 0)
    )
    # Windows with their places, equal ones side by side.
    step = step.withColumn("_windows", F.sort_array(F.transform(_windows(F.col("_names")), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    # Places of windows that another one equals, in order.
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.col("_windows"))
    after = F.concat(F.slice("_windows", 2, F.greatest(F.size("_windows"), F.lit(1))), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    sides = F.zip_with(
        F.slice(before, 1, F.size("_windows")), F.slice(after, 1, F.size("_windows")),
        lambda b, a: F.struct(b["h"].alias("b"), a["h"].alias("a")),
    )
    twice = F.zip_with(
        F.col("_windows"), sides,
        lambda w, s: F.when(w["h"].eqNullSafe(s["b"]) | w["h"].eqNullSafe(s["a"]), w["i"]),
    )
    step = step.withColumn("_twice", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    # A window adds the words up to the next one, five at most.
    following = F.slice("_twice", 2, F.greatest(F.size("_twice") - 1, F.lit(0)))
    gaps = F.zip_with(
        F.slice("_twice", 1, F.greatest(F.size("_twice") - 1, F.lit(0))), following,
        lambda a, b: F.least(b - a, F.lit(_WINDOW)),
    )
    covered = F.aggregate(gaps, F.lit(0), lambda s, g: s + g) + F.when(F.size("_twice") > 0, _WINDOW).otherwise(0)
    return step.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.regexp_replace(body, WORD_SEPARATORS, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
            "n_lines": F.size("_lines").cast("long"),
        }
    ).drop("_words", "_names", "_lines", "_windows", "_twice")


def fixed_rules_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _rates(counts: DataFrame) -> DataFrame:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return counts.withColumns(
        {
            "symbol_rate": F.col("n_symbols") / words,
            "dup_line_rate": F.col("n_dup_lines") / lines,
            "repeat_rate": F.col("n_repeat_words") / words,
            "mean_word_chars": F.col("word_chars") / words,
        }
    )


def fences(counts: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """For every group, the bounds that a rate may not leave.

    Documents that fail the fixed rules do not shape their group's fences.
    """
    sketched = (
        _rates(counts)
        .filter(~fixed_rules_failed())
        .groupBy(*groups)
        .agg(*[F.percentile_approx(r, [0.25, 0.75], ACCURACY).alias(f"_{r}") for r, _, _ in RATES])
    )
    bounds = {}
    for rate, low, step in RATES:
        q1, q3 = F.col(f"_{rate}")[0], F.col(f"_{rate}")[1]
        reach = F.greatest(REACH * (q3 - q1), F.lit(step))
        if low:
            bounds[f"least_{rate}"] = q1 - reach
        bounds[f"most_{rate}"] = q3 + reach
    return sketched.select(*groups, *[v.alias(k) for k, v in bounds.items()])


def judged(counts: DataFrame, bounds: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``counts`` with base_failed and kept, joined with the fences of its groups."""
    renamed = bounds.select(*[F.col(g).alias(f"_{g}") for g in groups], *[c for c in bounds.columns if c not in groups])
    on = None
    for g in groups:
        same = F.col(g).eqNullSafe(F.col(f"_{g}"))
        on = same if on is None else on & same
    inside = F.lit(True)
    for rate, low, _ in RATES:
        if low:
            inside &= F.coalesce(F.col(rate) >= F.col(f"least_{rate}"), F.lit(True))
        inside &= F.coalesce(F.col(rate) <= F.col(f"most_{rate}"), F.lit(True))
    extra = [c for c in renamed.columns] + [r for r, _, _ in RATES]
    return (
        _rates(counts)
        .join(renamed, on, "left")
        .withColumn("base_failed", fixed_rules_failed())
        .withColumn("kept", ~F.col("base_failed") & inside)
        .drop(*extra)
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its counts, base_failed and kept.

    ``docs`` has ``lang`` and ``source``; counts are made once and kept as a
    narrow table that the sketches and the filter both read.
    """
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), F.col("lang"), F.col("source"), F.col(text).alias("text")
    )
    counts = stored(measured(narrow).drop("text"), "quality-counts")
    return judged(counts, fences(counts)).select("doc_id", *COUNTS, "base_failed", "kept")

"""Quality rules: a threshold table compiled into one Spark projection.

Words are runs of characters that are no white space.  The projection has the
base measures (words, their characters, symbols, repeated lines, words in
repeated three-word windows) and the ratios of ``THRESHOLDS``; a document is
kept where the base rule holds and every ratio lies in its range.

Defined results: null and empty texts have no words and fail the base rule;
every ratio of a text without words or lines is 0; repeated rows are measured
alike; an empty table gives an empty result; other columns are kept in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
_SPACE = r"[\x20\x09-\x0D]+"

# Very frequent function words of the languages that are expected.
STOP_WORDS = ["the", "of", "and", "to", "in", "a", "is", "that", "it", "on", "with",
              "der", "die", "das", "und", "den", "zu", "ist", "von", "ein",
              "le", "la", "les", "des", "et", "un", "une", "que", "pour",
              "el", "los", "las", "del", "y", "en", "de", "con"]

#: (name, least, most) of the ratios; None: no bound.
THRESHOLDS = [
    ("mean_word_chars", 2.0, 20.0),
    ("symbols_per_word", None, 0.3),
    ("stop_words_per_word", 0.01, None),
    ("duplicate_lines_per_line", None, 0.5),
    ("bullet_lines_per_line", None, 0.95),
    ("ellipsis_lines_per_line", None, 0.5),
]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _repeated(hashes: str) -> Column:
    """Words in three-word windows that stand twice or more, first included:
    windows sorted by hash and place, equal neighbours marked."""
    h = F.col(hashes)
    windows = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(
        F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
    return F.when(F.size(h) >= 3, windows).otherwise(F.array().cast("array<bigint>"))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the
    ratios of THRESHOLDS."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    step = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("t"))
    step = step.select("row", "t", F.array_remove(F.split("t", _SPACE), "").alias("words"),
                       F.filter(F.split("t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    step = step.select(
        "row", "t", "words", "lines", F.size("words").cast("bigint").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.aggregate("words", F.lit(0).cast("bigint"), lambda n, w: n + F.char_length(w)).alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop"),
        F.size(F.filter("lines", lambda s: s.rlike(r"^\s*[-*•·]"))).alias("n_bullet"),
        F.size(F.filter("lines", lambda s: s.rlike(r"(\.\.\.|…)\s*$"))).alias("n_ellipsis"))
    step = step.withColumn("windows", _repeated("hashes"))
    step = step.withColumn("sorted", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    same = lambda a, b: F.get(F.col("sorted"), a)["k"] == F.get(F.col("sorted"), b)["k"]
    twice = F.filter("sorted", lambda s, j: F.coalesce(same(j, j + 1), F.lit(False))
                     | F.coalesce(F.when(j > 0, same(j, j - 1)), F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(
        twice, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2))))
    ratio = {
        "mean_word_chars": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"),
        "stop_words_per_word": ("n_stop", "n_words"), "duplicate_lines_per_line": ("n_dup_lines", "n_lines"),
        "bullet_lines_per_line": ("n_bullet", "n_lines"), "ellipsis_lines_per_line": ("n_ellipsis", "n_lines")}
    # inline() keeps later filters from being pushed down, which would put the whole
    # expression of a measure in place of its column, inside the lambdas too.
    return step.select("row", F.inline(F.array(F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(F.size(covered), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        *[_ratio(F.col(x), F.col(y)).alias(k) for k, (x, y) in ratio.items()]))))


def rated(docs: DataFrame, text_col: str = "text",
          thresholds: list[tuple[str, float | None, float | None]] = THRESHOLDS) -> DataFrame:
    """``measured`` with base_failed and kept."""
    passes = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            passes = passes & (F.col(name) >= least)
        if most is not None:
            passes = passes & (F.col(name) <= most)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return (measured(docs, text_col).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & passes))

"""Quality rules: a threshold table compiled into one projection of built-in functions.

Ratios of length, symbols, stop words, lines and repetition are columns, each
rule of the table compares one of them with its limits, and a row is kept if
no rule fails. No user function runs and nothing is shuffled.

Null text counts as an empty text; a text without words has ratios of 0 and
fails the rule on length. Rows that repeat are judged alike, an empty table
gives an empty result, columns of the input with other names don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in is for that it as was with be by on not he this are or his from at which but have an had they "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie "
    "le la les de des et un une du en est que qui dans pour pas sur au par plus ce il se sont avec "
    "el los las y del que una por con para como su al lo más o pero sus"
).split()

# (name, ratio, least, most): a row fails a rule if the ratio is below the least or above the most allowed value.
RULES = (
    ("length", "n_words", 50, None),
    ("word_length_low", "mean_word_chars", 2.0, None),
    ("word_length_high", "mean_word_chars", None, 14.0),
    ("symbols", "symbols_per_word", None, 0.1),
    ("stop_words", "stop_word_share", 0.02, None),
    ("upper_case", "upper_share", None, 0.3),
    ("marks", "shouting_share", None, 0.1),
    ("repeated_words", "repeated_word_share", None, 0.5),
    ("repeated_neighbours", "same_as_next_share", None, 0.2),
    ("repeated_lines", "repeated_line_share", None, 0.5),
)


def _count(found: Column) -> Column:
    return F.size(found).cast("bigint")


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``doc_id``, counts and ratios of every row."""
    # No array of strings that Spark can hold has 2^28 words.
    low = (1 << 28) - 1
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.btrim(text, F.lit(BLANKS)).alias("bare"))
    words = F.when(F.col("bare") != "", F.split("bare", f"[{BLANKS}]+")).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    # One pass over the characters; the few that are left are counted apart.
    marks = F.regexp_replace("text", "[^#*$%&|<>!?]++", "")
    upper = F.length(F.regexp_replace("text", r"[^\p{Lu}]++", "")).cast("bigint")
    cut = base.select("doc_id", words.alias("words"), lines.alias("lines"), marks.alias("marks"), upper.alias("n_upper"))
    hashed = cut.select(
        "doc_id",
        _count(F.col("words")).alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("marks", "[!?]+", "")).cast("bigint").alias("n_symbols"),
        F.length("marks").cast("bigint").alias("n_all_marks"), "n_upper",
        _count(F.col("lines")).alias("n_lines"),
        (_count(F.col("lines")) - _count(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    # Stop words by their hash, as written and with a capital.
    forms = sorted({f for w in stop_words for f in (w, w.capitalize())})
    stops = [F.xxhash64(F.lit(f)) for f in forms]
    windows = F.transform(
        F.slice("h", 3, F.greatest(F.size("h") - 2, F.lit(0))), lambda c, i: F.xxhash64(F.get("h", i), F.get("h", i + 1), c)
    )
    same = _count(F.filter("h", lambda h, i: F.coalesce(h == F.get("h", i + 1), F.lit(False))))
    triples = hashed.withColumn("n_stop_words", _count(F.filter("h", lambda h: h.isin(stops)))).withColumn("windows", windows)
    triples = triples.withColumn("n_same_as_next", same)
    # Texts without a repeated window stop here.
    repeats = triples.withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    # 36 bits of the hash above 28 bits of place: primitive longs sort fast and equal windows come side by side.
    packed = repeats.withColumn(
        "packed",
        F.when(
            F.col("repeats"),
            F.sort_array(F.transform("windows", lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("bigint")))),
        ),
    )

    def alike(x: Column, y: Column) -> Column:
        return F.coalesce(x.bitwiseXOR(y).bitwiseAND(F.lit(~low)) == 0, F.lit(False))

    near = packed.withColumn(
        "near",
        F.filter("packed", lambda x, i: alike(x, F.get("packed", i + 1)) | alike(x, F.get("packed", i - 1))),
    )

    def window(x: Column) -> Column:
        return F.get("windows", x.bitwiseAND(F.lit(low)).cast("int"))

    # Different windows that share 36 bits (about never) are told apart by comparing whole hashes with all others.
    mixed = F.exists(
        F.zip_with("near", F.slice("near", 2, F.greatest(F.size("near"), F.lit(1))), lambda x, y: alike(x, y) & (window(x) != window(y))),
        lambda different: F.coalesce(different, F.lit(False)),
    )
    exact = F.filter("near", lambda x: F.size(F.filter("near", lambda y: window(x) == window(y))) > 1)
    found = near.withColumn("mixed", F.coalesce(mixed, F.lit(False))).withColumn(
        "places",
        F.when(~F.col("repeats"), F.array().cast("array<bigint>")).otherwise(
            F.sort_array(F.transform(F.when(F.col("mixed"), exact).otherwise(F.col("near")), lambda x: x.bitwiseAND(F.lit(low))))
        ),
    )
    # A window covers three words; the next one adds what it does not share with it.
    covered = F.aggregate(
        F.transform("places", lambda p, i: F.least(F.coalesce(F.get("places", i + 1) - p, F.lit(3)), F.lit(3))),
        F.lit(0).cast("bigint"),
        lambda total, gap: total + gap,
    )
    done = found.withColumn("n_repeat_words", covered).withColumn("n_marks", F.col("n_all_marks") - F.col("n_symbols"))
    return done.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _share("word_chars", "n_words").alias("mean_word_chars"),
        _share("n_symbols", "n_words").alias("symbols_per_word"),
        _share("n_stop_words", "n_words").alias("stop_word_share"),
        _share("n_upper", "word_chars").alias("upper_share"),
        _share("n_marks", "word_chars").alias("shouting_share"),
        _share("n_repeat_words", "n_words").alias("repeated_word_share"),
        _share("n_same_as_next", "n_words").alias("same_as_next_share"),
        _share("n_dup_lines", "n_lines").alias("repeated_line_share"),
    )


def compiled(rules: Sequence[tuple] = RULES) -> Column:
    """Names of the rules a measured row fails, in the order of the table."""

    def fails(ratio: str, least, most) -> Column:
        tests = [F.col(ratio) < least] * (least is not None) + [F.col(ratio) > most] * (most is not None)
        return reduce(lambda a, b: a | b, tests)

    failed = [F.when(fails(ratio, least, most), F.lit(name)) for name, ratio, least, most in rules]
    return F.array_compact(F.array(*failed))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[tuple] = RULES) -> DataFrame:
    """Measured rows with ``failed`` (names of failed rules) and ``passed``."""
    rows = measured(docs, id_col, text_col).withColumn("failed", compiled(rules))
    return rows.withColumn("passed", F.size("failed") == 0)

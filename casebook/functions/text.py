"""Text and name expressions; all of them compile to built-in Spark functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from casebook.functions.fixed import CHINESE_DIGITS, GREETING, SALUTATION


def quote_words(words: Sequence[str]) -> str:
    """A regex alternation in which every word is taken literally."""
    return "|".join("\\Q" + w + "\\E" for w in words)


def matches_any(col: str | Column, words: Sequence[str], ci: bool = True) -> Column:
    """Whether a word occurs, in any case unless ``ci`` is off; null text counts as no.

    Plain search in the lower-cased text: several times faster than a
    case-insensitive pattern, and words are literal without quoting.
    """
    c = F.col(col) if isinstance(col, str) else col
    return contains_any(F.lower(c), [w.lower() for w in words]) if ci else contains_any(c, words)


def contains_any(col: str | Column, words: Sequence[str]) -> Column:
    """Case-sensitive literal test; null text counts as no."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(reduce(lambda a, b: a | b, [c.contains(w) for w in words], F.lit(False)), F.lit(False))


def fold_spaces(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def strip_all_spaces(col: Column) -> Column:
    return F.regexp_replace(col, r"\s+", "")


def strip_brackets(col: Column) -> Column:
    """Drop bracketed parts, full-width and plain, then fold the blanks."""
    plain = F.regexp_replace(F.regexp_replace(col, "（[^）]*）", ""), r"\([^)]*\)", "")
    return fold_spaces(plain)


def length_without_brackets(col: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(col, r"\([^)]*\)", ""), "（[^）]*）", ""))


def is_number_text(col: Column) -> Column:
    return col.rlike(r"^\d+(\.\d+)?$")


def clean_title(col: Column) -> Column:
    """Markup, characters no file name may hold, and blanks removed."""
    bare = F.regexp_replace(col, r"<[^>]+>", "")
    return F.regexp_replace(F.regexp_replace(bare, r'[\\/:*?"<>|]', ""), r"\s+", "")


def pad_code(col: Column, width: int = 6) -> Column:
    """Left-pad with zeros; longer codes stay whole."""
    text = col.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def before_marker(col: Column, marker: str) -> Column:
    return F.substring_index(col, marker, 1)


def ellipsis(col: Column, limit: int, keep: int) -> Column:
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, keep), F.lit("..."))).otherwise(col)


def composite_key(*cols: str, sep: str = "_") -> Column:
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def first_group(col: Column, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` with null instead of an empty string."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def id_from_url(col: Column, digits: int = 11) -> Column:
    return F.coalesce(first_group(col, rf"(\d{{{digits}}})"), F.lit("N/A"))


def drop_salutations(col: Column) -> Column:
    """Remove the polite address up to, not including, the next delimiter."""
    return F.regexp_replace(col, SALUTATION, "$1")


def drop_greetings(col: Column) -> Column:
    """Remove a greeting up to and including the mark that ends it."""
    return F.regexp_replace(col, GREETING, "")


def drop_leading_titles(col: Column, titles: Sequence[str]) -> Column:
    return F.regexp_replace(col, "(?m)^(" + quote_words(titles) + ")", "")


def normalise_document(col: Column, titles: Sequence[str]) -> Column:
    return fold_spaces(drop_leading_titles(col, titles))


def sentences_with(col: Column, words: Sequence[str], stop: str = "[。？！.?!]+") -> Column:
    """Array of the sentences that hold one of the words."""
    parts = F.transform(F.split(col, stop), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: contains_any(s, words))


def first_keyword_category(col: str | Column, lexicon: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Name of the first category, in list order, with a word in the text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(*[F.when(contains_any(c, words), F.lit(name)) for name, words in lexicon], F.lit(default))


def word_tokens(col: Column) -> Column:
    """Lower-case letter runs."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"(\p{L}+)"), F.lit(1))


def kept_tokens(col: Column, stop_words: Sequence[str] = (), min_len: int = 2) -> Column:
    """Tokens without stop words and short tokens (numbers never match a letter run)."""
    stops = list(stop_words)

    def keep(t: Column) -> Column:
        long_enough = F.length(t) >= min_len
        return long_enough & ~t.isin(stops) if stops else long_enough

    return F.filter(word_tokens(col), keep)


def chinese_number(col: Column) -> Column:
    """Value of a small Chinese or plain numeral such as 二十一, 十, 二〇二三 or 12."""
    digits = F.translate(col, "".join(CHINESE_DIGITS), "000123456789")
    tens = F.nullif(F.substring_index(digits, "十", 1), F.lit("")).try_cast("int")
    ones = F.nullif(F.substring_index(digits, "十", -1), F.lit("")).try_cast("int")
    with_ten = F.coalesce(tens, F.lit(1)) * 10 + F.coalesce(ones, F.lit(0))
    return F.when(digits.contains("十"), with_ten).otherwise(digits.try_cast("int"))

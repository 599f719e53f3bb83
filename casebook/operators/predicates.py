"""Row filters and conditional columns. Every test treats null as false."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from casebook.functions.text import contains_any, matches_any


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; present are {df.columns}")
    return df


def first_present(df: DataFrame, candidates: Sequence[str]) -> Column:
    """The first candidate the table has, decided when the plan is built."""
    for c in candidates:
        if c in df.columns:
            return F.col(c)
    raise ValueError(f"none of {list(candidates)} in {df.columns}")


def yes(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def keyword_filter(df: DataFrame, col: str, words: Sequence[str], ci: bool = True) -> DataFrame:
    return df.filter(matches_any(col, words, ci))


def literal_filter(df: DataFrame, col: str, words: Sequence[str]) -> DataFrame:
    return df.filter(contains_any(col, words))


def guarded_filter(df: DataFrame, col: str, drop_words: Sequence[str], unless: Sequence[str]) -> DataFrame:
    """Drop rows that hit ``drop_words`` and none of ``unless``."""
    return df.filter(~(contains_any(col, drop_words) & ~contains_any(col, unless)))


def kept_and_rejected(df: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """The rows for which the test holds, and all others."""
    return df.filter(yes(test)), df.filter(~yes(test))


def name_or_text_route(
    df: DataFrame, name: str, text: str, name_words: Sequence[str], shared_name: str, text_words: Sequence[str]
) -> DataFrame:
    """Flag rows by name alone, or by one shared name plus the text; blank the name of hits."""
    hit = matches_any(name, name_words) | (yes(F.col(name) == shared_name) & matches_any(text, text_words))
    return df.withColumn("routed", hit).withColumn(name, F.when(hit, F.lit("")).otherwise(F.col(name)))


def tiered_relevance(
    col: str, precise: Sequence[str], context: dict[str, Sequence[str]], patterns: Sequence[str], labels: Sequence[str]
) -> Column:
    """Why a text is relevant: precise term, words of two context groups, or a pattern; else null."""
    c = F.col(col)
    groups = F.lit(0)
    for words in context.values():
        groups = groups + contains_any(c, words).cast("int")
    pattern = F.lit(False)
    for p in patterns:
        pattern = pattern | yes(c.rlike(p))
    return (
        F.when(contains_any(c, precise), F.lit(labels[0]))
        .when(groups >= 2, F.lit(labels[1]))
        .when(pattern, F.lit(labels[2]))
    )


def closed_range(col: str, low: Column, high: Column) -> Column:
    return F.col(col).between(low, high)


def open_range(col: str, low: Column, high: Column) -> Column:
    return (F.col(col) > low) & (F.col(col) < high)


def years_and_part(year: Column, quarter: Column, first: int, last: int, last_quarter: int) -> Column:
    """Whole years from ``first`` to before ``last``, plus the first quarters of ``last``."""
    return ((year >= first) & (year < last)) | ((year == last) & (quarter <= last_quarter))


def relabel(df: DataFrame, col: str, mapping: dict, name: str, default: Column | None = None) -> DataFrame:
    """Look a code up in a literal map; unknown codes get ``default`` (null if none)."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    value = F.try_element_at(F.create_map(*pairs), F.col(col))
    return df.withColumn(name, value if default is None else F.coalesce(value, default))

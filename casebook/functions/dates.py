"""Date expressions that do not depend on the session time zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from casebook.functions.fixed import CHINESE_DIGITS, DATE_LAYOUTS
from casebook.functions.text import chinese_number, first_group

DAY_MICROS = 86_400_000_000
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def micros(col: str | Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp."""
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), c)


def as_instant(col: str | Column) -> Column:
    """Zone-free timestamp to an instant, reading the clock as UTC."""
    return F.timestamp_micros(micros(col))


def as_clock(col: Column) -> Column:
    """Instant back to the zone-free UTC clock."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(col), F.expr(EPOCH))


def whole_days(earlier: Column, later: Column) -> Column:
    """Whole days from one zone-free timestamp to the other, rounded down."""
    return F.floor(F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(float(DAY_MICROS))).cast("bigint")


def parse_clock(col: Column, layout: str = "yyyy年MM月dd日 HH:mm") -> Column:
    """Fixed layout; anything else becomes null."""
    return F.try_to_timestamp(col, F.lit(layout)).cast("timestamp_ntz")


def parse_any_date(col: Column, layouts: Sequence[str] = tuple(DATE_LAYOUTS)) -> Column:
    """First layout that fits, then whatever Spark reads as a date; null if nothing does."""
    tries = [F.try_to_timestamp(col, F.lit(p)).cast("date") for p in layouts]
    return F.coalesce(*tries, col.try_cast("date"))


def year_before(col: Column, mark: str = "年") -> Column:
    return first_group(col, rf"(\d{{4}}){mark}").cast("int")


def year_in_text(col: Column, low: int = 2000, high: int = 2030) -> Column:
    """Leading year of ``y-m-d`` or ``y/m/d``; null outside the plausible range."""
    day = F.substring_index(col, " ", 1)
    year = first_group(day, r"^(\d+)[-/]").try_cast("int")
    return F.when(year.between(low, high), year)


def quarter_of(month: Column) -> Column:
    return (F.floor((month - 1) / 3) + 1).cast("int")


def in_years(col: str, first: int, last: int) -> Column:
    """Years as a half-open range on the raw column, so that files can be skipped."""
    start, end = f"timestamp_ntz'{first}-01-01 00:00:00'", f"timestamp_ntz'{last + 1}-01-01 00:00:00'"
    return (F.col(col) >= F.expr(start)) & (F.col(col) < F.expr(end))


def meeting_date(col: Column, word: str = "董事会", reach: int = 100) -> Column:
    """Date written near ``word``: plain numerals after it, before it, then Chinese numerals."""
    day = r"(\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日)"
    near = f".{{0,{reach}}}"
    cjk = "[" + "".join(CHINESE_DIGITS) + "十]"
    cjk_day = rf"({cjk}{{4}}\s*年\s*{cjk}{{1,3}}\s*月\s*{cjk}{{1,3}}\s*日)"
    found = F.coalesce(
        first_group(col, f"(?s){word}{near}{day}"),
        first_group(col, f"(?s){day}{near}{word}"),
        first_group(col, f"(?s){word}{near}?{cjk_day}"),
    )
    tight = F.regexp_replace(found, r"\s", "")
    parts = [
        chinese_number(F.substring_index(tight, "年", 1)),
        chinese_number(F.substring_index(F.substring_index(tight, "月", 1), "年", -1)),
        chinese_number(F.substring_index(F.substring_index(tight, "日", 1), "月", -1)),
    ]
    return F.format_string("%04d-%02d-%02d", *parts).try_cast("date")


def meeting_year(col: Column, word: str = "股东大会", reach: int = 100) -> Column:
    cjk = "[" + "".join(CHINESE_DIGITS) + "]"
    found = F.coalesce(
        first_group(col, rf"(?s)(\d{{4}})\s*.{{0,{reach}}}年度{word}"),
        first_group(col, rf"(?s)(\d{{4}})\s*年\s*.{{0,{reach}}}{word}"),
        first_group(col, rf"(?s)({cjk}{{4}})\s*.{{0,{reach}}}年度{word}"),
        first_group(col, rf"(?s)({cjk}{{4}})\s*年\s*.{{0,{reach}}}{word}"),
    )
    return chinese_number(found)

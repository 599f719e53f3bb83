"""Old and new wording of clauses in amendment texts, and two-column tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from casebook.functions import fixed
from casebook.functions.text import (
    contains_any, first_keyword_category, is_number_text, length_without_brackets,
)


def is_revision_draft(col: Column) -> Column:
    """Whether a title names a revision draft: a mark inside brackets, or one of the draft endings."""
    open_, close = "[（(]", "[）)]"
    inner = "|".join(f"{open_}[^）)]*{m}" + ("[^）)]*" + close if m == "修订" else "") for m in fixed.REVISION_MARKS)
    return F.coalesce(col.rlike(inner) | col.rlike("修订稿|修订[版案]$"), F.lit(False))


def clause_changes(
    df: DataFrame, id_col: str, text: str, clause: str, original_marks: Sequence[str], modified_marks: Sequence[str]
) -> DataFrame:
    """One row per clause with old or new wording: (id, clause_no, original, modified).

    A line that fits ``clause`` opens a clause. Its side follows from marks
    in the line, else in the line before; lines up to the next clause belong
    to it. Lines stay with their document, so no window outgrows one text.
    """
    lines = df.select(id_col, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    seq = W.partitionBy(id_col).orderBy("i")
    before = F.lag("line").over(seq)

    def side(c: Column) -> Column:
        return F.when(contains_any(c, original_marks), "o").when(contains_any(c, modified_marks), "m")

    opened = lines.withColumn("_open", F.col("line").rlike(clause)).withColumn("_side", F.coalesce(side(F.col("line")), side(before)))
    numbered = opened.withColumn("clause_no", F.sum(F.col("_open").cast("int")).over(seq))
    whole = numbered.filter(F.col("clause_no") > 0).groupBy(id_col, "clause_no").agg(
        F.max(F.when(F.col("_open"), F.col("_side"))).alias("_side"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("i", F.trim("line").alias("t")))), lambda s: s["t"]), " "
        ).alias("_t"),
    )
    return whole.filter(F.col("_side").isNotNull()).select(
        id_col, "clause_no",
        F.when(F.col("_side") == "o", F.col("_t")).alias("original"),
        F.when(F.col("_side") == "m", F.col("_t")).alias("modified"),
    )


class _Pair:
    """Old and new wording gathered so far."""

    def __init__(self) -> None:
        self.sides = {"original": [], "modified": []}

    def text(self, side: str) -> str:
        return "".join(self.sides[side])

    def complete(self) -> bool:
        new = self.text("modified")
        return len(new) >= fixed.SHORT_LINE or (not new and bool(self.text("original")))

    def take(self) -> tuple[str, str]:
        out = self.text("original"), self.text("modified")
        self.sides = {"original": [], "modified": []}
        return out


def _wordings(lines: list[str], clause, original, appended, modified, ends) -> Iterator[tuple[str, str]]:
    pair, side, adding, seen = _Pair(), None, False, set()
    for line in lines:
        if len(line) < fixed.SHORT_LINE and ends(line):
            break
        old_mark, new_mark = original(line), modified(line)
        if old_mark:
            side, adding = "original", False
        if appended(line):
            adding = True
        number = None if new_mark else clause(line)
        if new_mark:
            side = "modified"
        elif number is not None:
            if number in seen:
                seen.discard(number)
                side, adding = "modified", False
            elif not adding:
                seen.add(number)
                side = "original"
            if old_mark:
                side = "original"
        if (new_mark or number is not None) and pair.complete():
            yield pair.take()
        if side:
            pair.sides[side].append(line)
    if pair.text("original") or pair.text("modified"):
        yield pair.take()


def clause_changes_in_sequence(
    df: DataFrame,
    id_col: str,
    text: str,
    clause: str = "(" + fixed.CLAUSE_NUMBER + r"\s*).{0,100}[一-鿿].{0,100}[一-鿿]",
    original_marks: Sequence[str] = tuple(fixed.ORIGINAL_MARKS),
    append_marks: Sequence[str] = tuple(fixed.APPEND_MARKS),
    modified_marks: Sequence[str] = tuple(fixed.MODIFIED_MARKS),
    end_marks: Sequence[str] = tuple(fixed.END_MARKS),
    categories: Sequence[tuple[str, Sequence[str]]] = tuple(fixed.CLAUSE_CATEGORIES),
    default: str = fixed.OTHER_CATEGORY,
) -> DataFrame:
    """Full form: (id, change_no, original, modified, category).

    A clause number met for the first time opens the old wording, met again
    the new one, unless additions are listed. That toggling depends on all
    earlier lines of the text, so each text is walked once in a vectorised
    function; texts are spread over tasks like any rows.
    """
    schema = T.StructType(
        [df.schema[id_col], T.StructField("change_no", T.IntegerType()), T.StructField("original", T.StringType()),
         T.StructField("modified", T.StringType())]
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        def any_of(marks):
            found = re.compile("|".join(map(re.escape, marks))) if marks else re.compile(r"(?!)")
            return lambda line: found.search(line) is not None

        pattern = re.compile(clause)

        def number_of(line: str):
            m = pattern.search(line)
            return m.group(1) if m else None

        tests = [any_of(m) for m in (original_marks, append_marks, modified_marks, end_marks)]
        for batch in batches:
            rows = [
                (key, i, old, new)
                for key, value in zip(batch[id_col], batch[text])
                if value is not None
                for i, (old, new) in enumerate(_wordings(value.split("\n"), number_of, *tests))
            ]
            yield pd.DataFrame(rows, columns=schema.names)

    changes = df.select(id_col, text).mapInPandas(walk, schema)
    category = F.when(F.col("modified") != "", first_keyword_category("modified", categories, default)).otherwise("")
    return changes.withColumn("category", category)


def two_column_pairs(
    rows: DataFrame,
    id_col: str,
    order: str,
    cells: str,
    original_marks: Sequence[str] = tuple(fixed.ORIGINAL_MARKS),
    modified_marks: Sequence[str] = tuple(fixed.MODIFIED_MARKS),
    taboo: Sequence[str] = tuple(fixed.TABOO_MARKS),
) -> DataFrame:
    """Old and new cells below the header row of extracted table rows.

    The header is the first row with a short cell of old marks and one of
    new marks; its places give the columns. Empty cells do not count for
    places. Rows of short taboo words or of bare numbers are left out.
    """
    full = rows.withColumn("_c", F.filter(cells, lambda c: F.coalesce(c, F.lit("")) != ""))

    def place(marks: Sequence[str]) -> Column:
        flags = F.transform(
            "_c", lambda c: (length_without_brackets(c) < fixed.SHORT_LINE) & contains_any(c, marks)
        )
        return F.array_position(flags, True)

    headed = full.withColumn("_o", place(original_marks)).withColumn("_m", place(modified_marks))
    header = headed.filter((F.col("_o") > 0) & (F.col("_m") > 0)).groupBy(id_col).agg(
        F.min(order).alias("_first"), F.min_by(F.struct("_o", "_m"), order).alias("_at")
    )
    below = full.join(header, id_col).filter(F.col(order) > F.col("_first"))
    pairs = below.select(
        id_col, order,
        F.try_element_at("_c", F.col("_at._o").cast("int")).alias("original"),
        F.try_element_at("_c", F.col("_at._m").cast("int")).alias("modified"),
    ).filter(F.col("original").isNotNull() & F.col("modified").isNotNull())
    short = (length_without_brackets(F.col("original")) < fixed.SHORT_LINE) & (
        length_without_brackets(F.col("modified")) < fixed.SHORT_LINE
    )
    barred = short & (contains_any("original", taboo) | contains_any("modified", taboo))
    numbers = is_number_text(F.col("original")) | is_number_text(F.col("modified"))
    return pairs.filter(~(barred | numbers))



"""Counts, shares, panels, trends and joined texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casebook.functions.ranking import numbered, seeded_key


def frequency_table(df: DataFrame, key: str, count: str = "n", rank: str = "rank") -> DataFrame:
    """Count per key with its place, most frequent first, ties by key."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(count)).withColumn("_down", -F.col(count))
    return numbered(counts, ["_down", key], rank).drop("_down")


def count_of_counts(df: DataFrame, key: str) -> DataFrame:
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("times"))
        .groupBy("times").agg(F.count(F.lit(1)).alias("keys"))
    )


def distinct_sketches(df: DataFrame, by: Sequence[str], cols: Sequence[str], precision: int = 12) -> DataFrame:
    """One HyperLogLog sketch of each of ``cols`` per group, to be kept and merged later.

    A sketch has at most about ``2 ** precision`` bytes, however many values it
    saw; its relative error is about 0.8 / sqrt(2 ** precision), 1.3 % at 12.
    Nulls are not counted.
    """
    values = {c: F.col(c) if df.schema[c].dataType.typeName() in ("integer", "long", "string", "binary") else F.col(c).cast("string") for c in cols}
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(v, F.lit(precision)).alias(c) for c, v in values.items()])


def merged_distinct_counts(sketches: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Approximate distinct counts per group of ``by``, from sketches of any finer groups; no row is read again."""
    return sketches.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in cols])


def conditional_counts(df: DataFrame, by: Sequence[str], tests: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(t).alias(name) for name, t in tests.items()])


def subset_and_total(df: DataFrame, by: str, test: Column) -> DataFrame:
    """Hits and rows per object, for objects with at least one hit."""
    out = df.groupBy(by).agg(F.count_if(test).alias("hits"), F.count(F.lit(1)).alias("total"))
    return out.filter(F.col("hits") > 0)


def hits_per_period(df: DataFrame, period: Column, test: Column, name: str = "year") -> DataFrame:
    """Rows that pass the test per period, and a row ``all``."""
    hits = df.filter(test).groupBy(period.cast("string").alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = hits.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("all").alias(name), "n")
    return hits.unionByName(total)


def missing_share(df: DataFrame, by: Column, col: str, name: str = "year") -> DataFrame:
    blank = F.count_if(F.col(col).isNull())
    return df.groupBy(by.alias(name)).agg(
        blank.alias("missing"), F.round(100.0 * blank / F.count(F.lit(1)), 6).alias("percent")
    )


def filled_cells(cols: Sequence[str]) -> Column:
    out = F.lit(0)
    for c in cols:
        out = out + F.col(c).isNotNull().cast("int")
    return out


def column_profile(df: DataFrame) -> DataFrame:
    """(column, filled): non-null cells of every column, from one pass."""
    one = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return one.selectExpr(f"stack({len(df.columns)}, {pairs}) as (column, filled)")


def concat_texts(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, sep: str = " ") -> DataFrame:
    """One text per key, its pieces in order: (keys, text, pieces).

    The text is one cell, so a key must fit a cell; ``ordered_pieces`` has
    the same pieces as rows, for keys of any size.
    """
    piece = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(text).alias("t"))
    return df.filter(F.col(text).isNotNull()).groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["t"]), sep).alias(text),
        F.count(F.lit(1)).alias("pieces"),
    )


def ordered_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str) -> DataFrame:
    """The pieces of every key, numbered in order: (keys, piece_no, text). No key is gathered in one place."""
    rows = df.filter(F.col(text).isNotNull()).select(*keys, *order, text)
    return numbered(rows, order, "piece_no", keys).select(*keys, "piece_no", text)


def joined_values(df: DataFrame, key: str, col: str, out: str, sep: str = "; ") -> DataFrame:
    """Distinct non-blank values of each key, sorted and joined; one row per key."""
    trimmed = df.select(key, F.trim(col).alias(out)).filter(F.col(out) != "").distinct()
    return concat_texts(trimmed, [key], [out], out, sep).drop("pieces")


def entity_month_panel(df: DataFrame, entity: Column, when: str, source: Column | None = None) -> DataFrame:
    """Rows per entity and month with year, month and, if given, the distinct sources joined."""
    base = df.select(
        F.coalesce(F.nullif(F.trim(entity), F.lit("")), F.lit("unknown")).alias("entity"),
        F.date_format(when, "yyyyMM").alias("ym"),
        (source if source is not None else F.lit(None).cast("string")).alias("source"),
    ).filter(F.col("ym").isNotNull())
    inner = base.groupBy("entity", "ym", "source").agg(F.count(F.lit(1)).alias("n"))
    out = inner.groupBy("entity", "ym").agg(
        F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources")
    )
    return out.select(
        "entity", "ym", F.substring("ym", 1, 4).cast("int").alias("year"),
        F.substring("ym", 5, 2).cast("int").alias("month"), "n", "sources",
    )


def wide_panel(panel: DataFrame, index: str, column: str, measure: str, values: Sequence | None = None) -> DataFrame:
    """One column per value of ``column``, 0 where there is no row.

    All values of the panel become columns, from the least to the greatest;
    ``values`` names them where they are known before.
    """
    if values is None:
        values = sorted(r[0] for r in panel.select(column).filter(F.col(column).isNotNull()).distinct().collect())
    return panel.groupBy(index).pivot(column, list(values)).agg(F.sum(measure)).fillna(0)


def trend(df: DataFrame, when: str, grain: str) -> DataFrame:
    labels = {
        "year": F.date_format(when, "yyyy"),
        "quarter": F.concat(F.date_format(when, "yyyy"), F.lit("Q"), F.quarter(when).cast("string")),
        "month": F.date_format(when, "yyyy-MM"),
    }
    return df.groupBy(labels[grain].alias("period")).agg(F.count(F.lit(1)).alias("n"))


def trend_set(df: DataFrame, when: str) -> DataFrame:
    """Yearly, quarterly and monthly counts, the coarser ones added up from the months."""
    months = df.groupBy(F.date_trunc("month", F.col(when)).alias("_m")).agg(F.count(F.lit(1)).alias("n"))
    grains = [months.select(F.lit(g).alias("grain"), _period(g, "_m").alias("period"), "n") for g in ("year", "quarter", "month")]
    out = grains[0].unionByName(grains[1]).unionByName(grains[2])
    return out.groupBy("grain", "period").agg(F.sum("n").alias("n"))


def _period(grain: str, col: str) -> Column:
    if grain == "year":
        return F.date_format(col, "yyyy")
    if grain == "quarter":
        return F.concat(F.date_format(col, "yyyy"), F.lit("Q"), F.quarter(col).cast("string"))
    return F.date_format(col, "yyyy-MM")


def latest_periods(counts: DataFrame, period: str, k: int = 24) -> DataFrame:
    return counts.orderBy(F.col(period).desc()).limit(k).orderBy(period)


def shares(df: DataFrame, by: str) -> DataFrame:
    """Count and percent per category; the total is taken over the counted table."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def coverage(df: DataFrame, test: Column) -> DataFrame:
    hit = F.count_if(test)
    return df.agg(
        F.count(F.lit(1)).alias("total"), hit.alias("matched"), (F.count(F.lit(1)) - hit).alias("unmatched"),
        F.round(100.0 * hit / F.count(F.lit(1)), 6).alias("percent"),
    )


def new_entities(df: DataFrame, entity: str, words: Sequence[str], licensed: DataFrame, default: str) -> DataFrame:
    """Unlicensed entities whose name holds a keyword: rows, hits (one per keyword and row), first keyword.

    The keywords are looked for in the distinct names, after counting.
    """
    names = df.groupBy(F.trim(entity).alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    fresh = names.join(licensed.select(F.col("entity")), "entity", "left_anti")
    kinds = F.lit(0)
    category = []
    for w in words:
        kinds = kinds + F.lower(F.col("entity")).contains(w.lower()).cast("int")
        category.append(F.when(F.col("entity").contains(w), F.lit(w)))
    return (
        fresh.withColumn("_k", kinds).filter(F.col("_k") > 0)
        .select("entity", "n", (F.col("n") * F.col("_k")).alias("hits"), F.coalesce(*category, F.lit(default)).alias("category"))
    )


def month_consistency(df: DataFrame, group: str, when: str, expected: Column) -> DataFrame:
    """Whether each part holds one month only, and the expected one."""
    ym = F.date_format(when, "yyyyMM")
    return df.groupBy(group).agg(
        F.countDistinct(ym).alias("months"),
        F.min(ym).alias("first_month"),
        ((F.countDistinct(ym) == 1) & (F.max(ym) == F.max(expected))).alias("consistent"),
    )


def object_counts(df: DataFrame, by: str, order: str, example: str) -> DataFrame:
    """Rows per object and the value of its first row."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min_by(example, order).alias(example))


def mode_value(df: DataFrame, col: str):
    """Most frequent non-null value; the smallest of several."""
    top = (
        df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col(col)).limit(1).collect()
    )
    return top[0][col] if top else None


def fill_with_mode(df: DataFrame, col: str) -> DataFrame:
    """Put the mode where the value is missing; a column without values stays as it is."""
    value = mode_value(df, col)
    return df if value is None else df.withColumn(col, F.coalesce(F.col(col), F.lit(value).cast(df.schema[col].dataType)))


def screen_objects(
    df: DataFrame, by: str, id_col: str, test: Column, rows: int = 10, hits: int = 2, seed: int = 42
) -> DataFrame:
    """Look at up to ``rows`` rows of each object; keep them if ``hits`` or more pass the test."""
    drawn = W.partitionBy(by).orderBy(seeded_key(id_col, seed))
    seen = df.filter(F.col(by).isNotNull()).withColumn("_rn", F.row_number().over(drawn)).filter(F.col("_rn") <= rows)
    whole = W.partitionBy(by)
    return seen.withColumn("_hits", F.sum(test.cast("int")).over(whole)).filter(F.col("_hits") >= hits).drop("_rn", "_hits")

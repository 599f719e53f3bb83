"""Rule cascade that turns written names into dictionary names and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casebook.functions import fixed
from casebook.functions.text import before_marker, contains_any


def _substrings(name: Column, lengths: list[int]) -> Column:
    """All distinct substrings of the given lengths."""

    def of_length(size: int) -> Column:
        starts = F.when(F.length(name) >= size, F.sequence(F.lit(1), F.length(name) - size + 1))
        starts = F.coalesce(starts, F.array().cast("array<int>"))
        return F.transform(starts, lambda p: F.substring(name, p, F.lit(size)))

    return F.array_distinct(F.flatten(F.array(*[of_length(k) for k in lengths])))


def _lengths(df: DataFrame, col: str) -> list[int]:
    return sorted(r[0] for r in df.select(F.length(col)).distinct().collect() if r[0])


def resolve_names(
    df: DataFrame,
    name: str,
    text: str,
    progress: str,
    dictionary: DataFrame,
    aliases: DataFrame,
    short_names: dict[str, str] | None = None,
    brands: dict[str, str] | None = None,
    brand_words: list[str] | None = None,
) -> DataFrame:
    """Add ``canonical``, ``code`` and ``status`` to every row.

    ``dictionary`` is (entry, code, ord), ``aliases`` is (alias, canonical).
    All rules run on the distinct (name, text mentions finance) pairs and are
    joined back. Whether a name is part of an entry, or an entry part of a
    name, is decided by equi-joins on substrings: names are short, and only
    lengths that occur on the other side are cut.
    """
    short_names = fixed.BANK_SHORT_NAMES if short_names is None else short_names
    brands = fixed.FINANCE_BRANDS if brands is None else brands
    brand_words = fixed.FINANCE_WORDS if brand_words is None else brand_words

    noted = F.coalesce(F.col(name).contains(fixed.UNASSIGNED_NOTE), F.lit(False))
    asked = F.nullif(F.regexp_extract(F.col(name), r"(\S+)\s+" + fixed.UNASSIGNED_NOTE, 1), F.lit(""))
    rows = (
        df.withColumn("_open", noted | F.coalesce(F.col(progress).contains(fixed.UNASSIGNED_PROGRESS), F.lit(False)))
        .withColumn("_name", F.coalesce(F.when(noted, asked).otherwise(F.col(name)), F.lit("")))
        .withColumn("_fin", contains_any(text, brand_words))
    )
    known = rows.select("_name", "_fin").distinct()
    codes = dictionary.groupBy(F.col("entry").alias("_entry")).agg(F.max_by("code", "ord").alias("_code"))
    entries = dictionary.filter(F.col("entry") != "").groupBy("entry").agg(
        F.min("ord").alias("ord"), F.max_by("code", "ord").alias("code")
    )
    alias = aliases.groupBy(F.col("alias").alias("_alias")).agg(F.max("canonical").alias("_canon"))

    plain = known.select("_name").filter(F.col("_name") != "").distinct()
    spelled = (
        plain.join(alias, F.col("_name") == F.col("_alias"))
        .select("_name", F.col("_canon").alias("_r1"))
    )
    cut = (
        plain.filter(F.col("_name").contains(fixed.SERVICE_DESK))
        .withColumn("_stem", before_marker(F.col("_name"), fixed.SERVICE_DESK))
        .join(alias, F.col("_stem") == F.col("_alias"))
        .select("_name", F.col("_canon").alias("_r6"))
    )
    inside_entry = (
        entries.withColumn("_name", F.explode(_substrings(F.col("entry"), _range_to_longest(entries, "entry"))))
        .groupBy("_name")
        .agg(F.min_by("code", "ord").alias("_c4"))
        # Exploded pieces are more than Spark estimates: never broadcast.
        .join(plain.hint("merge"), "_name")
    )
    holds_entry = (
        plain.withColumn("entry", F.explode(_substrings(F.col("_name"), _lengths(entries, "entry"))))
        .join(entries.hint("merge"), "entry")
        .groupBy("_name")
        .agg(F.min_by(F.struct("entry", "code"), "ord").alias("_r5"))
    )
    state = known.join(spelled, "_name", "left").join(inside_entry, "_name", "left")
    state = state.join(holds_entry, "_name", "left").join(cut, "_name", "left")

    fixed_hit = F.coalesce(F.col("_r1"), *[F.when(F.col("_name").contains(k), F.lit(v)) for k, v in short_names.items()])
    branded = [F.when(F.col("_fin") & F.col("_name").contains(k), F.lit(v)) for k, v in brands.items()]
    early = F.coalesce(fixed_hit, *branded)
    state = state.withColumn("_early", early).withColumn(
        "canonical",
        F.coalesce(
            F.col("_early"),
            F.when(F.col("_c4").isNotNull(), F.col("_name")),
            F.col("_r5.entry"),
            F.col("_r6"),
        ),
    )
    looked_up = F.when(F.col("_early").isNotNull(), F.col("_early")).when(
        F.col("_c4").isNull() & F.col("_r5").isNull(), F.col("_r6")
    )
    state = (
        state.withColumn("_key", looked_up)
        .join(codes, F.col("_key") == F.col("_entry"), "left")
        .withColumn("_found", F.when(F.col("_key").isNotNull(), F.col("_code")).otherwise(F.coalesce("_c4", "_r5.code")))
        .select("_name", "_fin", "canonical", F.col("_found").alias("_found"))
    )
    matched = F.col("canonical").isNotNull()
    out = rows.join(state, ["_name", "_fin"], "left")
    out = out.withColumn(
        "status",
        F.when(F.col("_open"), F.when(matched, fixed.MATCHED_FROM_NOTE).otherwise(fixed.UNASSIGNED))
        .when(matched, fixed.MATCHED)
        .otherwise(fixed.UNMATCHED),
    ).withColumn("code", F.when(matched, F.col("_found")).when(F.col("_open"), F.lit(-2)).otherwise(F.lit(-1)))
    stem = F.when(F.col("_name").contains(fixed.SERVICE_DESK), before_marker(F.col("_name"), fixed.SERVICE_DESK))
    out = out.withColumn("canonical", F.coalesce("canonical", stem, "_name"))
    return out.drop("_open", "_name", "_fin", "_found")


def _range_to_longest(df: DataFrame, col: str) -> list[int]:
    longest = df.agg(F.max(F.length(col))).first()[0] or 0
    return list(range(1, longest + 1))

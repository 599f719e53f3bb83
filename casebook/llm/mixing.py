"""Mixing sources to target weights by capped water-filling.

Each source gets a share of the whole budget by its weight; sources above
their ceiling (``max_epochs`` times their size) are clamped and the excess
goes to the others by weight, until none is above. A source's target is met
by whole repetitions of all its documents and a seeded partial repetition:
documents in the order of a hashed key, up to the words that are missing.

Null text has size 0, a null source is a source of its own and comes last.
Rows of equal key are taken or left together. Empty tables give empty
results; if nothing has a size, all targets are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casebook.functions.ranking import key_bucket, numbered, seeded_key
from casebook.functions.runtime import cut_lineage, join_on, settle

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 42


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    marks = F.regexp_replace(F.ltrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r")), r"[^ \t\n\x0B\f\r]++[ \t\n\x0B\f\r]*+", "x")
    return F.length(marks).cast("bigint")


def weighted_sources(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``source``, its size and its weight; weights repeat over the sources in order, null last."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = numbered(totals.withColumn("last", F.col("source").isNull()), ["last", "source"], "place")
    weight = F.get(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("place") - 1) % len(weights)).cast("int"))
    return ordered.select("source", "source_size", weight.cast("bigint").alias("weight"))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target``; ``sources`` has ``source``, ``source_size`` and ``weight``.

    Each round is one sum over the sources; a round clamps at least one more
    source, and what is clamped stays so, because the level only rises.
    """
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    ceiling = F.col("source_size") * F.lit(max_epochs)
    level = None
    while True:
        # A source is above if weight * rest / free exceeds its ceiling: compared in whole numbers.
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level[0]) > ceiling * F.lit(level[1])
        r = sources.agg(
            F.sum(F.when(above, ceiling).otherwise(F.lit(0))).alias("clamped"),
            F.sum(F.when(above, F.lit(0)).otherwise(F.col("weight"))).alias("free"),
        ).first()
        following = (budget - (r["clamped"] or 0), r["free"] or 0)
        if following == level or not following[1]:
            break
        level = following
    if level is None or not level[1]:
        return sources.withColumn("target", ceiling.cast("double"))
    above = F.col("weight") * F.lit(level[0]) > ceiling * F.lit(level[1])
    even = F.col("weight").cast("double") * F.lit(float(level[0])) / F.lit(float(level[1]))
    return sources.withColumn("target", F.when(above, ceiling.cast("double")).otherwise(even))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """Per row: ``doc_id``, ``source``, ``mark``, ``size``, ``source_size``, ``target``, ``copies``."""
    key = F.coalesce(seeded_key(id_col, seed), F.lit(""))
    sizes = cut_lineage(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("mark"),
            word_count(F.col(text_col)).alias("size"), key.alias("key"),
            key_bucket(key).alias("bucket"),
        )
    )
    # Sources are summed once; the rounds read the written sums.
    targets = cut_lineage(water_fill(cut_lineage(weighted_sources(sizes, weights)), max_epochs))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("whole", whole.cast("bigint")).withColumn(
        "missing", F.col("target") - F.col("whole") * F.col("source_size")
    )
    # Words in the buckets of a source, in the order of the key; one bucket holds the cut.
    sums = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    order = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    spans = sums.withColumn("end", F.sum("words").over(order)).withColumn("begin", F.col("end") - F.col("words"))
    edge = (
        join_on(targets.select("source", "missing"), spans, ["source"])
        .filter((F.col("begin") <= F.col("missing")) & (F.col("missing") < F.col("end")))
        .select("source", "bucket", (F.col("missing") - F.col("begin")).alias("room"))
    )
    # One row a source at most: broadcast if few, so that the rows of a hot source stay where they are.
    edge = settle(edge)
    inside = join_on(sizes.select("source", "bucket", "key", "size"), edge, ["source", "bucket"])
    before = W.partitionBy("source").orderBy("key").rangeBetween(W.unboundedPreceding, 0)
    cut = (
        inside.withColumn("upto", F.sum("size").over(before))
        # The document on the edge is taken if that comes nearer.
        .filter(F.col("upto") - F.col("size") / 2 <= F.col("room"))
        .groupBy("source").agg(F.max("key").alias("cut"))
    )
    edges = edge.select("source", "bucket").withColumnRenamed("bucket", "edge")
    plan = join_on(join_on(targets, edges, ["source"], "left"), cut, ["source"], "left")
    joined = join_on(sizes, settle(plan), ["source"])
    inside_cut = (F.col("bucket") == F.col("edge")) & (F.col("key") <= F.col("cut"))
    taken = F.coalesce(F.col("bucket") < F.col("edge"), F.lit(True)) | F.coalesce(inside_cut, F.lit(False))
    extra = (F.col("missing") > 0) & taken
    copies = F.least(F.col("whole") + extra.cast("bigint"), F.lit(max_epochs).cast("bigint"))
    return joined.select("doc_id", "source", "mark", "size", "source_size", "target", copies.alias("copies"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    plan = mix(docs, id_col, text_col, source_col, **options).filter("copies > 0")
    plan = plan.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("copies").alias("__copies"))
    plan = plan.groupBy("__id", "__mark").agg(F.max("__copies").alias("__copies"))
    joined = docs.join(plan, F.col(id_col).eqNullSafe(F.col("__id")) & F.xxhash64(text_col).eqNullSafe(F.col("__mark")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)

"""Row numbers and rank cut-offs that never gather a whole group in one task.

A plain ``row_number`` over one group sorts that group in a single task. Here
the order is first cut into buckets that follow it, bucket sizes are
aggregated (partial sums on the map side), and only the rows inside a bucket
are sorted together. A rank is the size of the earlier buckets plus the
position inside the own one, so it is exact however skewed the groups are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casebook.functions.runtime import join_on

KEY_DIGITS = 3
FANOUT = 32
ROWS_PER_BUCKET = 250_000


def seeded_key(col: str | Column, seed: int = 42) -> Column:
    """Repeatable pseudo-random order of ids: md5 of ``id|seed``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}")).cast("binary"))


def key_bucket(key: Column, digits: int = KEY_DIGITS) -> Column:
    """Leading hex digits: even in size for hashed keys, and in key order."""
    return F.substring(key, 1, digits)


def _bounds(df: DataFrame, order: Sequence[str], want: int) -> list:
    """At most ``want - 1`` bounds from a bounded, repeatable sample of order values."""
    picked = (
        df.select(*order)
        .orderBy(F.xxhash64(*order), *order)
        .limit(want * 16)
        .select(F.struct(*order).alias("o"))
        .orderBy("o")
        .collect()
    )
    values = [r["o"] for r in picked]
    return [values[len(values) * i // want] for i in range(1, want)]


def range_bucket(
    df: DataFrame, order: Sequence[str], fanout: int = FANOUT, rows_per_bucket: int = ROWS_PER_BUCKET
) -> Column | None:
    """Bucket number that grows with ``order`` (ascending, nulls first).

    None for a table that was counted and fits one bucket.

    The number of buckets follows the number of rows, up to ``fanout**2``.
    Bounds come from a bounded sample, so buckets are about even for any
    distribution. They are searched by halves: one comparison per doubling of
    their number, ten at most with the default.
    """
    want = min(fanout * fanout, -(-df.count() // rows_per_bucket))
    if want <= 1:
        return None
    values = _bounds(df, order, want)
    types = [df.schema[c].dataType for c in order]

    def literal(value) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(value, types, order)])

    here = F.struct(*[F.col(c) for c in order])
    bounds = F.array(*[literal(v) for v in values])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(values).bit_length()))])

    def place(row: Column) -> Column:
        # Past the last bound there is null, and nothing is added.
        return F.aggregate(steps, F.lit(0), lambda at, by: F.when(F.get(bounds, at + by - 1) <= row, at + by).otherwise(at))

    # The row's values are put together once, not at every step.
    return F.get(F.transform(F.array(here), place), F.lit(0))


def _spans(df: DataFrame, groups: list[str]) -> DataFrame:
    """Per (group, bucket): how many rows of the group lie before it and up to its end."""
    counts = df.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    running = W.partitionBy(*groups).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumn("_end", F.sum("_n").over(running)).withColumn("_start", F.col("_end") - F.col("_n"))


def numbered(
    df: DataFrame,
    order: Sequence[str],
    name: str = "rn",
    groups: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add the 1-based row number of each row (within ``groups``) in ``order``."""
    groups = list(groups)
    bucket = range_bucket(df, order, rows_per_bucket=rows_per_bucket)
    if bucket is None:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*groups).orderBy(*order)).cast("bigint"))
    keyed = df.withColumn("_b", bucket)
    local = keyed.withColumn("_place", F.row_number().over(W.partitionBy(*groups, "_b").orderBy(*order)))
    spans = _spans(keyed.select(*groups, "_b"), groups).select(*groups, "_b", "_start")
    joined = join_on(local, spans, groups + ["_b"])
    return joined.withColumn(name, (F.col("_start") + F.col("_place")).cast("bigint")).drop("_b", "_place", "_start")


def running_total(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of the group (0 for the first)."""
    groups = list(groups)
    bucket = range_bucket(df, order, rows_per_bucket=rows_per_bucket)
    if bucket is None:
        before = W.partitionBy(*groups).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(value.cast("bigint")).over(before), F.lit(0)))
    keyed = df.withColumn("_b", bucket).withColumn("_v", value.cast("bigint"))
    inside = W.partitionBy(*groups, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = keyed.withColumn("_local", F.sum("_v").over(inside) - F.col("_v"))
    sums = keyed.groupBy(*groups, "_b").agg(F.sum("_v").alias("_n"))
    running = W.partitionBy(*groups).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    spans = sums.select(*groups, "_b", (F.sum("_n").over(running) - F.col("_n")).alias("_start"))
    joined = join_on(local, spans, groups + ["_b"])
    return joined.withColumn(name, F.col("_start") + F.col("_local")).drop("_b", "_v", "_local", "_start")


def values_at_ranks(df: DataFrame, order: Sequence[str], ranks: Sequence[int], bucket: Column | None = None) -> dict:
    """The ``order`` values found at the given 1-based ranks of the whole table.

    Collects one row per rank. Ranks past the end are left out.
    """
    wanted = sorted({int(r) for r in ranks if r >= 1})
    if not wanted:
        return {}
    bucket = range_bucket(df, order) if bucket is None else bucket
    keyed = df.select(*order, (F.lit(0) if bucket is None else bucket).alias("_b"))
    sizes = sorted((r["_b"], r["n"]) for r in keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect())
    places, before, todo = [], 0, list(wanted)
    for b, n in sizes:
        while todo and todo[0] <= before + n:
            rank = todo.pop(0)
            places.append((b, rank - before, rank))
        before += n
    if not places:
        return {}
    hit = F.lit(False)
    for b, nth, _ in places:
        hit = hit | ((F.col("_b") == F.lit(b)) & (F.col("_rn") == nth))
    edge = (
        keyed.filter(F.col("_b").isin(sorted({b for b, _, _ in places})))
        .withColumn("_rn", F.row_number().over(W.partitionBy("_b").orderBy(*order)))
        .filter(hit)
        .collect()
    )
    found = {(r["_b"], r["_rn"]): tuple(r[c] for c in order) for r in edge}
    return {rank: found[(b, nth)] for b, nth, rank in places}


def cutoffs(
    df: DataFrame,
    groups: list[str],
    targets: DataFrame,
    key: str,
    bucket: Callable[[Column], Column] = key_bucket,
) -> DataFrame:
    """For each target rank ``_upto`` of a group, the key found at that rank.

    ``targets`` has the group columns, ``_step`` and ``_upto``. ``_cut`` is null
    when the group is not longer than ``_upto``: then all its rows qualify.
    """
    keyed = df.select(*groups, F.col(key).alias("_k")).withColumn("_b", bucket(F.col("_k")))
    spans = _spans(keyed.select(*groups, "_b"), groups)
    edges = (
        join_on(targets, spans, groups)
        .filter((F.col("_start") < F.col("_upto")) & (F.col("_upto") <= F.col("_end")))
        .select(*groups, "_step", "_b", (F.col("_upto") - F.col("_start")).alias("_nth"))
    )
    ranked = join_on(keyed, edges, groups + ["_b"]).withColumn(
        "_rn", F.row_number().over(W.partitionBy(*groups, "_step", "_b").orderBy("_k"))
    )
    cuts = ranked.filter(F.col("_rn") == F.col("_nth")).select(*groups, "_step", F.col("_k").alias("_cut"))
    return join_on(targets, cuts, groups + ["_step"], "left")

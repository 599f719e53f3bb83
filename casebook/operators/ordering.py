"""De-duplication, sequence numbers, slices, unions and bin packing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from casebook.functions.ranking import numbered, values_at_ranks
from casebook.functions.runtime import settle


def keep_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], digest: bool = False
) -> DataFrame:
    """First row of each key in ``order``.

    With ``digest`` a single text key is compared by its SHA-256, so that
    long texts travel only if they are part of the result.

    Spark turns the ``= 1`` test into a per-task limit ahead of the shuffle,
    so a key with very many copies sends one row per task.
    """
    parts = [F.sha2(F.col(keys[0]), 256)] if digest and len(keys) == 1 else list(keys)
    w = W.partitionBy(*parts).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def sequence_number(df: DataFrame, order: Sequence[str], name: str = "seq") -> DataFrame:
    return numbered(df, order, name)


def slice_rows(df: DataFrame, order: Sequence[str], start: int, end: int) -> DataFrame:
    """Rows number ``start`` (0-based) up to before ``end`` in the given order.

    Only the two limiting order values are looked up; the rows themselves are
    then read with a plain range filter and never shuffled. ``order`` must be
    unique per row.
    """
    if end <= start:
        return df.filter(F.lit(False))
    found = values_at_ranks(df, order, [start + 1, end])
    if start + 1 not in found:
        return df.filter(F.lit(False))
    out = df.filter(_compare(df, order, found[start + 1], ">="))
    return out.filter(_compare(df, order, found[end], "<=")) if end in found else out


def _compare(df: DataFrame, order: Sequence[str], value: Sequence, op: str) -> Column:
    types = [df.schema[c].dataType for c in order]
    if len(order) == 1:
        here, there = F.col(order[0]), F.lit(value[0]).cast(types[0])
    else:
        here = F.struct(*[F.col(c) for c in order])
        there = F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(value, types, order)])
    return here >= there if op == ">=" else here <= there if op == "<=" else here > there


def contiguous_parts(df: DataFrame, order: Sequence[str], parts: int, name: str = "part") -> DataFrame:
    """Label rows 1..parts in contiguous runs of ``ceil(rows / parts)``."""
    size = -(-df.count() // parts)
    return runs_of(df, order, size, parts, name)


def runs_of(df: DataFrame, order: Sequence[str], size: int, parts: int, name: str = "part") -> DataFrame:
    """Label runs of ``size`` rows from the order values at which runs end; no shuffle of the rows."""
    ends = values_at_ranks(df, order, [size * i for i in range(1, parts)])
    label = F.lit(1)
    for value in ends.values():
        label = label + _compare(df, order, value, ">").cast("int")
    return df.withColumn(name, label.cast("bigint"))


def align_union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_seen_union(lists: Sequence[DataFrame], col: str) -> DataFrame:
    """Distinct words of several lists with the first list that has each."""
    tagged = [d.select(F.col(col), F.lit(i).cast("bigint").alias("list_no")) for i, d in enumerate(lists)]
    return align_union(tagged).groupBy(col).agg(F.min("list_no").alias("list_no"))


def pack_blocks(df: DataFrame, block: str, bins: int = 20) -> DataFrame:
    """Assign whole blocks to bins of about equal size.

    Blocks are dealt in the order of their size, largest first and ties by
    name, forth and back over the bins: a bin that got a larger block in one
    turn gets a smaller one in the next. One rule for any number of blocks,
    and nothing but a row number over the block sizes.
    """
    sizes = df.filter(F.col(block).isNotNull()).groupBy(block).agg(F.count(F.lit(1)).alias("_n"))
    ranked = numbered(sizes.withColumn("_down", -F.col("_n")), ["_down", block], "_r")
    turn = (F.col("_r") - 1) % (2 * bins)
    placed = ranked.select(block, F.when(turn < bins, turn).otherwise(2 * bins - 1 - turn).cast("int").alias("bin"))
    return df.join(placed, block)


def least_loaded_blocks(df: DataFrame, block: str, bins: int = 20) -> DataFrame:
    """Assign whole blocks to bins: in the order of their names, each to the least-loaded bin.

    Of equally loaded bins the first one gets the block. Each choice depends
    on all earlier ones, so one task passes over the counts, one row a block,
    in order; it holds the loads of the bins in a priority queue and nothing
    else. Rows without a block are left out. The rows themselves are shuffled
    only where there are too many blocks to broadcast their bins.
    """
    sizes = df.filter(F.col(block).isNotNull()).groupBy(block).agg(F.count(F.lit(1)).alias("_n"))
    schema = T.StructType([sizes.schema[block], T.StructField("bin", T.IntegerType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = [(0, b) for b in range(bins)]
        for batch in batches:
            chosen = []
            for n in batch.column("_n").to_pylist():
                load, least = loads[0]
                heapq.heapreplace(loads, (load + n, least))
                chosen.append(least)
            yield pa.record_batch([batch.column(block), pa.array(chosen, pa.int32())], names=[block, "bin"])

    placed = sizes.repartition(1).sortWithinPartitions(block).mapInArrow(deal, schema)
    return df.join(settle(placed), block)

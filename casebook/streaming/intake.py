"""Incremental intake: files as they arrive, each row handled once.

All streams read files, run with ``availableNow`` and keep their progress in
a checkpoint folder, so a run may stop anywhere and go on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from casebook.functions.dates import as_instant


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", glob: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` query; a failure is raised."""
    query.awaitTermination()


def append_stream(stream: DataFrame, path: str, progress: str) -> None:
    """Write new rows to a folder, each exactly once."""
    run(
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress)
        .outputMode("append").trigger(availableNow=True).start()
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE, CHANGELOG = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def append_new_ids(stream: DataFrame, id_col: str, order: list[str], path: str, progress: str) -> None:
    """Append rows whose id no earlier batch held; a repeated batch adds nothing.

    Of several rows of an id in one batch the first in ``order`` is kept,
    nulls first. A null id is an id like others.

    Which ids were seen is keyed state in RocksDB. A batch looks up its own
    ids only and checkpoints what it changed, so its cost does not depend on
    how many ids came before, and nothing written is read again.
    """
    columns = stream.columns
    spark = stream.sparkSession

    def unseen(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        # The rows of one id in one batch, in pieces.
        heads = [f.sort_values(order, na_position="first", kind="stable").head(1) if order else f.head(1) for f in frames]
        state.update((True,))
        first = pd.concat(heads) if len(heads) > 1 else heads[0]
        yield (first.sort_values(order, na_position="first", kind="stable") if order else first).head(1)[columns]

    fresh = stream.groupBy(id_col).applyInPandasWithState(
        unseen, stream.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout
    )
    before = {c: spark.conf.get(c, None) for c in (STORE, CHANGELOG)}
    try:
        # The query takes its settings when it starts.
        spark.conf.set(STORE, ROCKSDB)
        spark.conf.set(CHANGELOG, "true")
        query = (
            fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress)
            .outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        for c, value in before.items():
            spark.conf.unset(c) if value is None else spark.conf.set(c, value)
    run(query)


def windowed_counts(
    stream: DataFrame, when: str, by: list[str], width: str = "1 day", late: str = "1 hour"
) -> DataFrame:
    """Rows per tumbling window; a window is closed, and its state dropped, when the watermark has passed it."""
    timed = stream.withColumn("_at", as_instant(when)).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", width).alias("_w"), *by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("_w.start").alias("window_start"), *by, "n"
    )


def period_counts(stream: DataFrame, period: Column, test: Column, path: str, progress: str) -> None:
    """Add the hits per period of every batch to a folder; ``sum`` over it is the running total.

    Only one row per period and batch is written, under the batch's own
    folder, so a repeated batch replaces its part.
    """

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.filter(test).groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run(
        stream.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
    )


def first_seen(stream: DataFrame, id_col: str, when: str, late: str) -> DataFrame:
    """First row of each id; an id is remembered for ``late`` after its time."""
    timed = stream.withColumn("_at", as_instant(when)).withWatermark("_at", late)
    return timed.dropDuplicatesWithinWatermark([id_col]).drop("_at")


def keep_updates(counts: DataFrame, path: str, progress: str) -> None:
    """Write the windows that a batch changed to the batch's own folder; see ``latest_counts``.

    Update mode: windows behind the watermark leave the state, and a batch
    writes what it changed only. A repeated batch replaces its folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run(
        counts.writeStream.foreachBatch(write).option("checkpointLocation", progress).outputMode("update")
        .trigger(availableNow=True).start()
    )


def latest_counts(written: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """The last state of every window; counts only grow, so it is the largest."""
    return written.groupBy(*keys).agg(F.max(count).alias(count))

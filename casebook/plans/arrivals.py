"""Incremental intake of the events table, cut into files in time order."""

from pyspark.sql import functions as F

from casebook.functions.dates import as_clock
from casebook.functions.runtime import scratch_path, table
from casebook.plans.registry import query
from casebook.streaming import intake as N


# A batch has a cost of its own (state of every partition, progress, task reports), so larger inputs come in larger batches.
BATCHES = 12


def _arriving(spark, folder):
    """The events as a stream of files, two per batch or as many as ``BATCHES`` need."""
    path = scratch_path(spark, "arriving")
    events = table(spark, folder, "events")
    events.repartitionByRange("ts").write.option("maxRecordsPerFile", 50_000).parquet(path)
    files = len(spark.read.schema(events.schema).parquet(path).inputFiles())
    return N.file_stream(spark, path, events.schema, files_per_batch=max(2, -(-files // BATCHES)))


@query("intake_of_files", "X1", "SELECT event_id, user_id, event_type FROM events")
def _(spark, folder):
    path = scratch_path(spark, "intake")
    N.append_stream(_arriving(spark, folder).select("event_id", "user_id", "event_type"), path, path + "-progress")
    return spark.read.parquet(path)


@query("intake_of_new_ids", "X2", "SELECT DISTINCT user_id FROM events")
def _(spark, folder):
    path = scratch_path(spark, "new-ids")
    N.append_new_ids(_arriving(spark, folder).select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], path, path + "-progress")
    return spark.read.parquet(path).select("user_id")


@query(
    "windowed_counts",
    "X3",
    "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def _(spark, folder):
    path = scratch_path(spark, "windows")
    counts = N.windowed_counts(_arriving(spark, folder), "ts", ["event_type"], late="40 days")
    N.keep_updates(counts, path, path + "-progress")
    latest = N.latest_counts(spark.read.parquet(path), ["window_start", "event_type"])
    return latest.select(as_clock(F.col("window_start")).alias("window_start"), "event_type", "n")


@query(
    "hits_per_period_while_arriving",
    "X3 A7",
    "SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1",
)
def _(spark, folder):
    path = scratch_path(spark, "periods")
    N.period_counts(
        _arriving(spark, folder), F.date_format("ts", "yyyy-MM-dd"), F.col("event_type") == "error", path, path + "-progress"
    )
    return spark.read.parquet(path).groupBy("period").agg(F.sum("n").alias("n"))


@query("first_seen_ids", "X4", "SELECT DISTINCT user_id FROM events")
def _(spark, folder):
    path = scratch_path(spark, "first-seen")
    N.append_stream(N.first_seen(_arriving(spark, folder), "user_id", "ts", "40 days").select("user_id"), path, path + "-progress")
    return spark.read.parquet(path)

"""Item status and batch progress over a stream of status events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet", schema: str = EVENT_SCHEMA, max_files: int | None = None) -> DataFrame:
    """Stream of one table, stored as a single file or as a folder of part files."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # A pattern, as the stream takes a single file only by one.
    return reader.parquet(f"{folder}/[{name[0]}]{name[1:]}")


def item_status(events: DataFrame, keys: list[str]) -> DataFrame:
    """Latest status per key as streaming state of one row per key (update mode)."""
    return events.groupBy(*keys).agg(F.max(F.struct("ts", "seq", "status")).alias("t"))


def start_item_status(events: DataFrame, keys: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Write changed items per micro-batch; a repeated micro-batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        changed = batch.select(*keys, "t.ts", "t.seq", "t.status", F.lit(batch_id).alias("micro_batch"))
        writer = changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("micro_batch").parquet(out)

    query = item_status(events, keys).writeStream.outputMode("update").foreachBatch(write)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_items(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Current item status from the changes written by the stream."""
    last = F.max(F.struct("ts", "seq", "status")).alias("t")
    return changes.groupBy(*keys).agg(last).select(*keys, "t.status", "t.ts")


def throughput(events: DataFrame, width: str = "1 day", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts by status in tumbling windows, or in sliding ones that begin every ``slide``. With ``late`` the state of old windows is
    dropped, and so are rows that come later than that; without it every row counts and the state holds one row per window and status."""
    timed = events.withWatermark("ts", late) if late else events
    w = timed.groupBy(F.window("ts", width, slide), "status").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("window_start"), "status", "n")


def start_throughput(events: DataFrame, out: str, checkpoint: str, width: str = "1 day", slide: str | None = None, late: str | None = None) -> StreamingQuery:
    """Write changed windows per micro-batch; a repeated micro-batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        writer = batch.withColumn("micro_batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("micro_batch").parquet(out)

    query = throughput(events, width, late, slide).writeStream.outputMode("update").foreachBatch(write)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_windows(changes: DataFrame) -> DataFrame:
    """Current count per window from the changes written by the stream."""
    return changes.groupBy("window_start", "status").agg(F.max_by("n", "micro_batch").alias("n"))

"""Ingestion as a stream: messages in, processed versions out, at-least-once with idempotent writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexgrove.operators.embedding import Embedder
from lexgrove.operators.observed import Counts, rows as passing
from lexgrove.plans.ingest import parse_messages, process_versions
from lexgrove.session import cut_lineage
from lexgrove.sources import commits


REQUESTS = "requests"
COUNTS = "scanned long, skipped long, inserted long, sections long, failed long"


def read_messages(spark: SparkSession, path: str, max_files: int = 8) -> DataFrame:
    """JSON messages, one per line, with the time they were created (their arrival where missing)."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
    created = F.try_to_timestamp(F.get_json_object("value", "$.created_at"))
    return lines.withColumn("created_at", F.coalesce(created, F.current_timestamp()))


def _commit(rows: DataFrame, keys: DataFrame, path: str, batch: str, counted: dict[str, Column]) -> dict[str, int]:
    """Commit ``rows`` and count them on the way; where the commit is already there, after a crash, they are counted alone."""
    counts = Counts()
    if commits.replace(counts.at(rows, **counted) if counted else rows, keys, path, batch):
        return counts.get()
    return rows.agg(*(c.alias(n) for n, c in counted.items())).first().asDict() if counted else {}


def start_ingest_stream(
    spark: SparkSession, messages: str, versions: DataFrame, texts: DataFrame, policies: DataFrame, out: str, checkpoint: str,
    embedder: Embedder | None = None, model: str = "default", max_files: int = 8,
) -> StreamingQuery:
    """Process requested versions per micro-batch.

    No request is dropped for its age: what is done is read from the stored status. A version that is ready, in
    ``versions`` or by an earlier micro-batch, keeps its sections, references and embeddings and only gets its
    current pointer again; any other is processed, and every write replaces the rows of just those versions, as
    one commit of the micro-batch (see ``sources.commits``): a stream that dies between two tables runs its micro-batch
    again and skips what was committed.
    Requests for unknown versions go to the ``unknown`` table, bad messages to dead letters of their own stream.

    What each micro-batch did is counted as it runs and stands in ``counts``; listeners get the number of messages
    under the name ``requests``.
    """
    good, _ = parse_messages(read_messages(spark, messages, max_files))
    good = good.observe(REQUESTS, passing().alias("messages"))

    def write(batch: DataFrame, batch_id: int) -> None:
        wanted = cut_lineage(batch.groupBy("policy_version_id").agg(F.max("created_at").alias("requested_at")))
        if wanted.isEmpty():
            return
        mine = versions.join(wanted, "policy_version_id")
        stored = commits.read(spark, f"{out}/status")
        if stored is not None:
            # A repeated micro-batch does its own versions again.
            done = stored.where((F.col("parse_status") == "ready") & (F.col("batch_id") < batch_id))
            ready = done.select("policy_version_id", F.lit(True).alias("_ready"))
            mine = mine.join(ready, "policy_version_id", "left").withColumn("parse_status", F.when(F.col("_ready"), "ready").otherwise(F.col("parse_status"))).drop("_ready")
        counts = Counts()
        ready_now = F.col("parse_status") == "ready"
        mine = cut_lineage(counts.at(mine, scanned=passing(), skipped=F.count_if(ready_now), inserted=F.count_if(~ready_now)))
        seen = {"sections": 0, "failed": 0, **counts.get()}
        # Numbers start again with another checkpoint, ids of queries do not.
        commit = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        todo = cut_lineage(mine.where(F.col("parse_status") != "ready").select("policy_version_id"))
        result = process_versions(mine, texts, policies, embedder, model)
        unknown = wanted.join(versions, "policy_version_id", "left_anti").withColumn("batch_id", F.lit(batch_id))
        commits.replace(unknown, unknown, f"{out}/unknown", commit)
        pointers = result["current"].withColumn("batch_id", F.lit(batch_id))
        pointers.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{out}/current")
        for name in ("sections", "references", "embeddings", "status"):
            if result[name] is not None:
                rows = result[name]
                counted = {}
                if name == "references":
                    rows = rows.withColumnRenamed("source_policy_version_id", "policy_version_id")
                if name == "status":
                    rows = rows.join(todo, "policy_version_id", "left_semi").withColumn("batch_id", F.lit(batch_id))
                    counted = {"failed": F.count_if(F.col("parse_status") == "failed")}
                if name == "sections":
                    counted = {"sections": passing()}
                seen.update(_commit(rows, todo, f"{out}/{name}", commit, counted))
        row = spark.createDataFrame([tuple(seen[c.split()[0]] for c in COUNTS.split(", "))], COUNTS).withColumn("batch_id", F.lit(batch_id))
        row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{out}/counts")

    writer = good.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def start_dead_letters(spark: SparkSession, messages: str, out: str, checkpoint: str, max_files: int = 8) -> StreamingQuery:
    """Messages that cannot be processed, with the reason, in a table of their own."""
    _, bad = parse_messages(read_messages(spark, messages, max_files))
    writer = bad.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def current_pointers(spark: SparkSession, out: str) -> DataFrame:
    """Current version per policy from the pointers that the micro-batches wrote: the last request that ended ready."""
    last = F.max(F.struct("requested_at", "current_version_id")).alias("t")
    return spark.read.parquet(f"{out}/current").groupBy("policy_id").agg(last).select("policy_id", "t.current_version_id")

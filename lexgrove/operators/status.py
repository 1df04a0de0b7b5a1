"""Parse-status folding, item and batch status, progress counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.scale import bucketed_scan

# Status groups.
ACTIVE_ITEMS = ["received", "queued", "processing"]
PROCESSING = ["pending", "received", "queued", "processing"]
READY = ["ready", "parsed"]
FAILED = ["failed", "cancelled"]
DONE_BATCH = ["completed", "complete", "failed", "cancelled"]
# Events of all batches per time slice of the running count.
ROWS_PER_SLICE = 250_000
MAX_SLICES = 1024
ITEM_OF_VERSION = {"ready": "completed", "failed": "failed", "processing": "processing"}


def fold_status(events: DataFrame, keys: list[str]) -> DataFrame:
    """Latest status per key by (ts, seq), with its error columns when present."""
    extra = [c for c in ("error_code", "error_message") if c in events.columns]
    last = F.max(F.struct("ts", "seq", "status", *extra)).alias("t")
    return events.groupBy(*keys).agg(last).select(*keys, "t.status", *(f"t.{c}" for c in extra), F.col("t.ts").alias("updated_at"))


def batch_progress(items: DataFrame, by: str = "batch_id") -> DataFrame:
    """Registered / processing / ready / failed counts and the completion test."""

    def among(values: list[str]) -> Column:
        return F.count_if(F.col("status").isin(values))

    counts = items.groupBy(by).agg(
        F.count(F.lit(1)).alias("registered"),
        among(PROCESSING).alias("processing"),
        among(READY).alias("ready"),
        among(FAILED).alias("failed"),
        among(ACTIVE_ITEMS).alias("active"),
    )
    finished = (F.col("registered") > 0) & (F.col("ready") + F.col("failed") >= F.col("registered"))
    return counts.withColumn("is_complete", finished)


def poll_done(status: Column, ready: Column, failed: Column, attempts: Column) -> Column:
    return F.lower(status).isin(DONE_BATCH) | ((attempts > 0) & (ready + failed >= attempts))


def counts_of_payload(payload: Column) -> Column:
    """Batch counts from any of the shapes a service reports; later shapes win."""

    def pick(key: str) -> Column:
        found = [F.get_json_object(payload, f"$.{shape}.{key}").try_cast("long") for shape in ("summary", "status_counts", "counts")]
        return F.coalesce(*found, F.lit(0)).alias(key)

    return F.struct(*(pick(k) for k in ("registered", "processing", "ready", "failed")))


def nested_active(items: Column) -> Column:
    """Active items of a batch document that carries its items as an array."""
    return F.size(F.filter(items, lambda i: i["status"].isin(ACTIVE_ITEMS)))


def time_slices(events: DataFrame, rows: int = ROWS_PER_SLICE, most: int = MAX_SLICES) -> Column:
    """Slices of the covered time between approximate quantiles, so that some ``rows`` events lie in each wherever they fall.

    At most ``most`` edges travel with the plan; a longer history has more rows in a slice.
    """
    n = min(most, events.count() // rows + 1)
    if n < 2:
        return F.lit(0).cast("long")
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    edges = events.select(seconds.alias("s")).agg(F.percentile_approx("s", [i / n for i in range(1, n)], 10_000).alias("e")).first().e
    return _slice_of(seconds, sorted(set(edges))).cast("long")


def _slice_of(value: Column, edges: list[int]) -> Column:
    """Number of ``edges`` below ``value``, by halving."""
    if not edges:
        return F.lit(0).cast("long")
    mid = len(edges) // 2
    return F.when(value > F.lit(edges[mid]), F.lit(mid + 1) + _slice_of(value, edges[mid + 1 :])).otherwise(_slice_of(value, edges[:mid]))


def item_results(items: DataFrame, versions: DataFrame) -> DataFrame:
    """Item status from the version it led to: batch_id, item_id, policy_version_id, status.

    Items keep their own status while their version has none of the ending states.
    """
    ended = versions.select("policy_version_id", F.element_at(F.create_map(*(F.lit(x) for p in ITEM_OF_VERSION.items() for x in p)), F.col("parse_status")).alias("_new"))
    return items.join(ended, "policy_version_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def batch_status(events: DataFrame, slice_of: Column | None = None) -> DataFrame:
    """Final status per batch from its item events.

    Events: batch_id, item_id, ts, seq, status. A batch turns ``processing`` when an item starts;
    when an item ends and none is left active it turns ``completed`` or ``failed`` by that item,
    so a later success may still replace an earlier failure. The active count is a running sum of
    changes, kept per (batch, time slice) so that one huge batch is spread over many tasks.
    """
    slice_of = time_slices(events) if slice_of is None else slice_of
    order = [F.col("ts"), F.col("seq")]
    slim = events.select("batch_id", "item_id", "ts", "seq", "status")
    steps = bucketed_scan(slim, ["batch_id", "item_id"], order, slice_of, previous=(F.col("status"), "before"))
    active_now = F.col("status").isin(ACTIVE_ITEMS).cast("int")
    active_before = F.coalesce(F.col("before").isin(ACTIVE_ITEMS).cast("int"), F.lit(0))
    steps = bucketed_scan(steps, ["batch_id"], order, slice_of, running=(active_now - active_before, "active"))
    ends = F.col("active") == 0
    change = (
        F.when(F.col("status") == "processing", "processing")
        .when(F.col("status").isin(READY) & ends, "completed")
        .when(F.col("status").isin(FAILED) & ends, "failed")
    )
    marked = steps.withColumn("change", change)
    last = F.max(F.when(F.col("change").isNotNull(), F.struct("ts", "seq", "change")))
    return marked.groupBy("batch_id").agg(last.alias("t")).select(
        "batch_id", F.coalesce("t.change", F.lit("received")).alias("batch_status")
    )


def tenant_counts(sections: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Sections and embeddings per tenant."""
    s = sections.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("policy_sections"))
    e = embeddings.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("policy_embeddings"))
    return s.join(e, "tenant_id", "full_outer").na.fill(0, ["policy_sections", "policy_embeddings"])


def status_report(rows: DataFrame, values: list[str], status: str = "status") -> DataFrame:
    """One summary row with a count per status."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(status) == v).alias(v.replace("-", "_")) for v in values)
    )

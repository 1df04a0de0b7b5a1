"""Streams that take events in any order, and counts that fall out of jobs, against plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexgrove.operators import embedding, references
from lexgrove.operators.observed import Counts, StreamCounts, finish, rows
from lexgrove.operators.status import batch_status
from lexgrove.streaming import keyed

EVENTS = "batch_id long, item_id long, ts timestamp, seq long, status string"
STATES = ["received", "queued", "processing", "ready", "failed"]
HOUR = 3600


def send(spark, events, folder, start, files=1):
    """Append ``events`` as files and run the stream over what is new."""
    spark.createDataFrame(events, EVENTS).repartition(files, "seq").write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    start(stream).awaitTermination()


def at(second):
    import datetime

    return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=second)


def test_batch_status_of_shuffled_events(spark, tmp_path):
    rng = random.Random(3)
    events = [(rng.choice([1, 2, 3]), rng.randrange(6), at(rng.randint(0, 500)), i, rng.choice([*STATES, "cancelled", None])) for i in range(300)]
    rng.shuffle(events)
    start = lambda stream: keyed.start_batch_status(stream, f"{tmp_path}/out", f"{tmp_path}/state", delay="1 hour")
    for part in (events[:120], events[120:] + events[:40]):  # some come twice, after a restart
        send(spark, part, tmp_path, start, files=5)
    got = {r.batch_id: r.batch_status for r in keyed.latest_batches(spark.read.parquet(f"{tmp_path}/out")).collect()}
    want = {r.batch_id: r.batch_status for r in batch_status(spark.createDataFrame(events, EVENTS), F.lit(0).cast("long")).collect()}
    assert got == want


def test_settled_batches_keep_late_rows_apart(spark, tmp_path):
    start = lambda stream: keyed.start_batch_status(stream, f"{tmp_path}/out", f"{tmp_path}/state", delay="10 minutes")
    send(spark, [(1, 1, at(0), 0, "processing"), (1, 2, at(10), 1, "queued"), (1, 1, at(20), 2, "ready")], tmp_path, start)
    state = lambda: keyed.latest_batches(spark.read.parquet(f"{tmp_path}/out")).first()
    assert (state().batch_status, state().active) == ("processing", 1)
    # Out of order, but within the delay: item 2 had ended before item 1 did.
    send(spark, [(1, 2, at(15), 3, "failed")], tmp_path, start)
    assert (state().batch_status, state().active) == ("completed", 0)
    send(spark, [(1, 3, at(2 * HOUR), 4, "processing")], tmp_path, start)
    send(spark, [(1, 3, at(30), 5, "failed"), (1, 3, at(2 * HOUR + 5), 6, "failed")], tmp_path, start)
    assert (state().batch_status, state().active) == ("failed", 0)
    late = keyed.late_rows(spark.read.parquet(f"{tmp_path}/out"), "batch_id").collect()
    assert [(r.batch_id, r.item, r.seq, r.status) for r in late] == [(1, "3", 5, "failed")]


def test_idle_batches_give_their_state_back(spark, tmp_path):
    spark.createDataFrame([(1, 1, at(0), 0, "processing"), (1, 1, at(9), 1, "ready"), (2, 1, at(0), 2, "processing")], EVENTS).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
    query = keyed.start_batch_status(stream, f"{tmp_path}/out", f"{tmp_path}/state", delay="1 day", idle="1 second", every="1 second")
    try:
        ended = lambda: spark.read.parquet(f"{tmp_path}/out").where("kind = 'state' AND settled").select("batch_id", "active").distinct().collect()
        for _ in range(90):
            time.sleep(1)
            if query.lastProgress and query.lastProgress.batchId > 2 and len(ended()) == 2:
                break
        assert sorted(map(tuple, ended())) == [(1, 0), (2, 1)]
    finally:
        query.stop()
    got = {r.batch_id: r.batch_status for r in keyed.latest_batches(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert got == {1: "completed", 2: "processing"}


def islands(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= gap:
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return out


def test_sessions_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    start = lambda stream: keyed.start_sessions(stream, "batch_id", f"{tmp_path}/out", f"{tmp_path}/state", gap="10 minutes", delay="1 hour")
    clock, kept, late, seq = {}, {}, [], 0
    for part in range(3):
        events = []
        for _ in range(80):
            key, t = rng.choice([1, 2, None]), rng.randint(0, 4 * HOUR) + part * 3 * HOUR - rng.choice([0, 0, 0, 3 * HOUR])
            events.append((key, None, at(t), seq, None))
            seq += 1
            if key in clock and t <= clock[key] - HOUR:
                late.append((key, seq - 1))
            else:
                kept.setdefault(key, []).append(t)
        for key, times in kept.items():
            clock[key] = max(times)
        spark.createDataFrame(events, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        start(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")).awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    got = [(r.batch_id, r.session_start, r.session_end, r.n) for r in keyed.sessions(out, "batch_id").collect()]
    stamp = lambda rows_: sorted(((k, round(a.timestamp()), round(b.timestamp()), n) for k, a, b, n in rows_), key=str)
    want = [(key, at(a), at(b), n) for key, times in kept.items() for a, b, n in islands(times, 600)]
    assert stamp([(k, a.replace(tzinfo=at(0).tzinfo), b.replace(tzinfo=at(0).tzinfo), n) for k, a, b, n in got]) == stamp(want)
    assert late and sorted(((r.batch_id, r.seq) for r in keyed.late_rows(out, "batch_id").collect()), key=str) == sorted(late, key=str)


# --- counts ----------------------------------------------------------------------------------

SECTIONS = "section_id string, policy_version_id string, policy_id string, tenant_id string, policy_type string, department_scope string, authority_level int, title string, text string, parse_status string, is_current boolean"


def sections(spark, n):
    return spark.createDataFrame([(f"s{i % 9}", f"v{i}", "p", "t", "general", "all", 1, "T", f"text {i}", "ready" if i % 4 else "failed", True) for i in range(n)], SECTIONS)


@pytest.mark.parametrize("n", [0, 20])
def test_backfill_counts(spark, tmp_path, n):
    s, have = sections(spark, n), spark.createDataFrame([("s1", "m"), ("s2", "other")], "section_id string, embedding_model string")
    counts = Counts()
    plain = embedding.embed_missing(s, have, embedding.hashing_embedder(4), "m")
    counted = embedding.embed_missing(s, have, embedding.hashing_embedder(4), "m", counts=counts)
    scans = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("Scan ")
    assert scans(plain) == scans(counted)
    counted.write.parquet(f"{tmp_path}/new")
    ready = [i for i in range(n) if i % 4]
    assert counts.get() == {"scanned": len(ready), "inserted": len({i % 9 for i in ready} - {1})} == {**counts.get(), "inserted": spark.read.parquet(f"{tmp_path}/new").count()}


def test_reference_backfill_counts(spark, tmp_path):
    s = sections(spark, 12).withColumn("section_index", F.lit(0)).withColumn("section_path", F.lit("chunk-1")).withColumn("text", F.lit("See https://a.example/x and section 3."))
    p = spark.createDataFrame([("p", "t", "Some Policy")], "policy_id string, tenant_id string, name string")
    counts = Counts()
    edges, marks = references.backfill_references(s, p, spark.createDataFrame([("v1",)], "policy_version_id string"), counts)
    edges.write.parquet(f"{tmp_path}/edges")
    marks.write.parquet(f"{tmp_path}/marks")
    stored = spark.read.parquet(f"{tmp_path}/edges")
    assert counts.get() == {"inserted": stored.count(), "resolved": stored.where("resolution_status = 'resolved'").count(), "scanned": 8} and stored.count() > 0


def test_stream_counts_by_listener(spark, tmp_path):
    listener = StreamCounts()
    spark.streams.addListener(listener)
    try:
        for part in (range(5), range(5, 12)):
            spark.createDataFrame([(i,) for i in part], "x long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema("x long").parquet(f"{tmp_path}/in").observe("seen", rows().alias("n"), F.count_if(F.col("x") % 2 == 0).alias("even"))
            finish(stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
        assert listener.totals("seen") == {"n": 12, "even": 6} and len(listener.batches("seen")) == 2
    finally:
        spark.streams.removeListener(listener)

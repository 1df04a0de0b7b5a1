"""Streams over folders, late and repeated requests, outlying times, broken values, repeated writes."""

import os
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexgrove.functions import ids
from lexgrove.operators import audit, fusion, status, vectors
from lexgrove.operators.references import backfill_counts
from lexgrove.plans import registry
from lexgrove.sources import commits, files, sinks
from lexgrove.streaming import ingest_stream, progress

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
VERSIONS = [f"00000000-0000-5000-8000-00000000000{i}" for i in range(5)]


def requests(*pairs):
    line = '{{"type":"policy.process.requested","data":{{"policy_version_id":"{}"}},"created_at":"2024-01-01T{}:00Z"}}'
    return "\n".join(line.format(VERSIONS[i], at) for i, at in pairs)


def test_stream_keeps_late_requests_and_ready_versions(spark, tmp_path):
    v = spark.createDataFrame([("t", "p", x, "pending") for x in VERSIONS[:4]], "tenant_id string, policy_id string, policy_version_id string, parse_status string")
    t = spark.createDataFrame([(x, f"Text {i}", None) for i, x in enumerate(VERSIONS[:3])], "policy_version_id string, text string, error string")
    p = spark.createDataFrame([("t", "p", "Policy", "all", 1, "general", "p")], "tenant_id string, policy_id string, name string, department_scope string, authority_level int, policy_type string, external_id string")
    messages, out = tmp_path / "messages", str(tmp_path / "out")
    messages.mkdir()

    def run():
        ingest_stream.start_ingest_stream(spark, str(messages), v, t, p, out, str(tmp_path / "state"), max_files=1).awaitTermination()

    for n, pair in enumerate([(0, "10:00"), (1, "12:30"), (2, "09:00")]):
        (messages / f"{n}.json").write_text(requests(pair))
        run()
    (messages / "again.json").write_text(requests((0, "13:00"), (3, "13:01"), (4, "13:02")).replace(VERSIONS[0], VERSIONS[0].upper()))
    run()
    read = lambda name: commits.read(spark, f"{out}/{name}")
    assert sorted(r.policy_version_id for r in read("sections").collect()) == VERSIONS[:3]
    assert {r.policy_version_id: r.parse_status for r in read("status").collect()} == {**dict.fromkeys(VERSIONS[:3], "ready"), VERSIONS[3]: "failed"}
    assert [r.policy_version_id for r in read("unknown").collect()] == [VERSIONS[4]]
    assert [tuple(r) for r in ingest_stream.current_pointers(spark, out).collect()] == [("p", VERSIONS[0])]


@pytest.mark.parametrize("query", [registry.stream_progress, registry.stream_throughput])
def test_streams_read_folders_of_part_files(spark, sf, tmp_path, query):
    spark.read.parquet(f"{sf}/events.parquet").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    rows = lambda folder: sorted(map(str, query(spark, folder).collect()))
    assert rows(str(tmp_path)) == rows(sf) != []


def test_time_slices_hold_out_against_one_outlier(spark):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=i),) for i in range(1000)] + [(datetime(1970, 1, 2),)]
    events = spark.createDataFrame(rows, "ts timestamp")
    counts = [r["count"] for r in events.groupBy(status.time_slices(events, 100).alias("s")).count().collect()]
    assert len(counts) >= 9 and max(counts) <= 200


def test_item_results(spark):
    items = spark.createDataFrame([("b", 1, "v1", "queued"), ("b", 2, "v2", "queued"), ("b", 3, "v3", "queued")], "batch_id string, item_id int, policy_version_id string, status string")
    done = spark.createDataFrame([("v1", "ready"), ("v2", "failed")], "policy_version_id string, parse_status string")
    assert {r.item_id: r.status for r in status.item_results(items, done).collect()} == {1: "completed", 2: "failed", 3: "queued"}


def test_broken_values_become_nulls(spark):
    df = spark.createDataFrame([('{"a":',), ("[1]",), ("3",), (None,), ('{"url":"u"}',)], "m string")
    got = df.select(ids.canonical_json("m").alias("c"), ids.metadata_hash("m").alias("h")).collect()
    assert [r.c for r in got] == [None, "[1]", "3", "{}", '{"url":"u"}']
    assert [r.h is None for r in got] == [True, True, True, False, False]
    raw = [b"plain", b"\xff\xfe bad", "é".encode(), b"cut \xe2\x82", b""]
    read = spark.createDataFrame([(bytearray(b),) for b in raw], "b binary").select(files.decode_text("b").alias("t"))
    assert [r.t for r in read.collect()] == [b.decode("utf-8", "replace") for b in raw]


def test_bad_dates_do_not_end_the_run(spark):
    rows = spark.createDataFrame([("q", "s1", "p1", 0.5, 0.1, "vector", 0), ("q", "s2", "p2", 0.4, 0.1, "vector", 1)], "question_id string, section_id string, policy_id string, vector_score double, fts_score double, first_source string, merge_order int")
    facts = spark.createDataFrame([("q", "s1", 1, "no date"), ("q", "s2", 1, "2024-05-05")], "question_id string, section_id string, authority_level int, effective_date string")
    assert {r.section_id: r.recency_weight for r in fusion.fuse(rows, facts).collect()} == {"s1": 0.0, "s2": 1.0}


def test_vectors_below_zero_keep_their_order(spark):
    q = spark.createDataFrame([("q", "t", "x", [1.0, 0.0])], "question_id string, tenant_id string, question string, vector array<double>")
    v = spark.createDataFrame([("a", [-0.995, 0.1]), ("b", [-0.1, 0.995])], "section_id string, embedding array<double>")
    v = v.withColumns({"policy_version_id": F.lit("v"), "policy_id": F.lit("p"), "tenant_id": F.lit("t"), "is_current": F.lit(True), "policy_type": F.lit("g")})
    assert [(r.section_id, r.score) for r in vectors.vector_topk(q, v, 1).collect()] == [("b", 0.0)]
    found = spark.createDataFrame([("q", "see AC-2", "s1", "AC-1", 0.6, 1), ("q", "see AC-2", "s2", "AC-2", 0.5, 2)], "question_id string, question string, section_id string, section_path string, score double, rank int")
    assert {r.section_id: r["rank"] for r in vectors.boost_exact(found).collect()} == {"s1": 2, "s2": 1}
    numbers = [0.5, -1.0, 0.1, 1e-7, 1e20, 1e-9, 1e-13, -0.0, 0.0, 123456789012.4, 1234567890123.0, 0.0001, 0.00001234567890125, 0.1983642578125, 1 / 3, float("inf"), float("nan")]
    rows = spark.createDataFrame([(0, numbers), (1, None), (2, [])], "id int, v array<double>")
    got = {r.id: r.t for r in rows.select("id", vectors.vector_literal(F.col("v")).alias("t")).collect()}
    assert got == {0: "[" + ",".join(f"{x:.12g}" for x in numbers) + "]", 1: None, 2: "[]"}


def test_repeated_writes(spark, tmp_path):
    a = spark.createDataFrame([("a1", "t", "ask", None, "{}", datetime(2024, 1, 1))], "audit_id string, tenant_id string, event_type string, correlation_id string, payload string, created_at timestamp")
    for _ in range(2):
        audit.append_audit(a, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 1
    rows = spark.createDataFrame([(f"v{i}", i) for i in range(50)], "policy_version_id string, n int")
    path = str(tmp_path / "rows")
    sinks.replace_versions(rows, rows, path, 8)
    before = {f: os.path.getmtime(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    one = rows.where("policy_version_id = 'v7'")
    sinks.replace_versions(one.withColumn("n", F.lit(99)), one, path, 8)
    after = {f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    stored = {r.policy_version_id: r.n for r in sinks.read_table(spark, path, rows).collect()}
    assert len(before.keys() - after) == 1 and stored == {f"v{i}": 99 if i == 7 else i for i in range(50)}


def test_backfill_counts(spark):
    edges = spark.createDataFrame([("v1",), ("v1",), ("v2",)], "source_policy_version_id string")
    marks = spark.createDataFrame([("v1",), ("v2",), ("v3",)], "policy_version_id string")
    assert backfill_counts(edges, marks).select("scanned", "with_references", "inserted").first() == (3, 2, 3)


def test_indented_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('[\n  {\n    "source_url": "a"\n  },\n  {\n    "source_url": "b"\n  }\n]')
    assert [r.source_url for r in files.read_manifest(spark, str(tmp_path / "m.json"), "source_url string", indented=True).collect()] == ["a", "b"]


def test_workers_find_the_package_from_another_folder(tmp_path):
    code = (
        "from pyspark.sql import SparkSession; import importlib.util as u, sys\n"
        f"s = u.spec_from_file_location('__spark_entry__', {ROOT!r} + '/__spark_entry__.py'); e = u.module_from_spec(s); s.loader.exec_module(e)\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('ROWS', e.queries()['vector_topk'](spark, '/root/testdata/sf0.001').count())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 692" in done.stdout, done.stderr[-2000:]

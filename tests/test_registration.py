import random
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import rows
from lexgrove.operators import register, status, versions
from lexgrove.plans import corpus
from lexgrove.scale import bucketed_scan, dimension_join, salted_lookup

INC = (
    "arrival_seq long, tenant_id string, batch_id string, container_name string, blob_path string, policy_external_id string, policy_name string, "
    "version_label string, metadata_json string, effective_date date, title string, content string"
)


def incoming(spark, data):
    """data: (policy, label, metadata, content) in arrival order."""
    return spark.createDataFrame(
        [(i, "t", "b", "c", f"p{i}", p, f"Name {p}", label, meta, None, None, content) for i, (p, label, meta, content) in enumerate(data)], INC
    )


def run(spark, data, **kw):
    return register.register(incoming(spark, data), corpus.no_policies(spark), corpus.no_versions(spark), **kw)


def brute(data):
    """One-by-one registration."""
    seen, labels, numbers, out = {}, set(), {}, {}
    for i, (policy, label, meta, content) in enumerate(data):
        key = (policy, meta, content)
        if key in seen:
            out[i] = ("duplicate", seen[key])
        elif label is not None and (policy, label) in labels:
            out[i] = ("label_conflict" if label.strip() else "conflict", None)
        else:
            seen[key] = i
            labels.add((policy, label))
            numbers[policy] = numbers.get(policy, 0) + 1
            out[i] = ("ok", numbers[policy])
    return out


@pytest.mark.parametrize("seed,hot", [(1, 1_000_000), (2, 2)])
def test_outcome_equals_one_by_one(spark, seed, hot):
    rng = random.Random(seed)
    data = [("a" if rng.random() < 0.7 else "b", rng.choice([None, "v1", "v2", "v3", "v4", ""]), "{}", f"c{rng.randrange(8)}") for _ in range(60)]
    r = run(spark, data, hot_rows=hot, slice_rows=7)
    want = brute(data)
    new = {x.arrival_seq: x for x in r.versions.collect()}
    lost = {x.arrival_seq: x for x in r.rejects.collect()}
    assert {i: x.version_number for i, x in new.items()} == {i: n for i, (s, n) in want.items() if s == "ok"}
    assert {i: x.reason for i, x in lost.items()} == {i: s for i, (s, _) in want.items() if s != "ok"}
    for i, x in lost.items():
        first = want[i][1]
        assert x.existing_policy_version_id == (new[first].policy_version_id if first is not None else None)


def test_second_run_adds_nothing_and_numbering_continues(spark):
    data = [("a", None, "{}", "x"), ("a", None, "{}", "y")]
    first = run(spark, data)
    again = register.register(incoming(spark, data), first.policies, first.versions)
    assert again.versions.count() == 0 and {r.reason for r in again.rejects.collect()} == {"duplicate"}
    more = register.register(incoming(spark, [("a", None, "{}", "z")]), first.policies, first.versions)
    last = first.versions.orderBy(F.desc("version_number")).first().policy_version_id
    assert rows(more.versions, "version_number", "supersedes_policy_version_id") == [(3, last)]


def test_invalid_rows_and_changed_metadata(spark):
    r = run(spark, [(" ", None, "{}", "x"), ("a", None, "{}", "x"), ("a", None, '{"k":1}', "x")])
    assert rows(r.rejects, "arrival_seq", "reason") == [(0, "invalid")]
    assert rows(r.versions, "version_number") == [(1,), (2,)]
    assert rows(r.items, "status") == [("queued",), ("queued",)]


def test_first_write_rules(spark):
    metas = ['{"department":"all"}', '{"type":"guide","authority_level":0}', '{"department":"ops","policy_type":"x","authority_level":7}', '{"department":"hr","authority_level":9}']
    p = run(spark, [("a", None, m, f"c{i}") for i, m in enumerate(metas)]).policies.first()
    assert (p.policy_type, p.department_scope, p.authority_level, p.name, p.status) == ("guide", "ops", 7, "Name a", "draft")


def test_current_version_is_the_last_to_get_ready(spark):
    v = spark.createDataFrame([("p", "v1", 1, 30, "ready"), ("p", "v2", 2, 20, "ready"), ("p", "v3", 3, 40, "failed")], "policy_id string, policy_version_id string, version_number int, ready_at int, parse_status string")
    assert rows(versions.current_versions(v), "current_version_id") == [("v1",)]
    assert rows(versions.current_versions(v, "version_number"), "current_version_id") == [("v2",)]
    assert rows(versions.mark_current(v, versions.current_versions(v)).where("is_current"), "policy_version_id") == [("v1",)]


def test_partial_update_can_set_null(spark):
    p = spark.createDataFrame([("a", "n", "d"), ("b", "n", "d")], "policy_id string, name string, department_scope string")
    u = spark.createDataFrame([("a", ["department_scope"], "new", None)], "policy_id string, supplied array<string>, name string, department_scope string")
    assert rows(versions.partial_update(p, u, ["name", "department_scope"]), "policy_id", "name", "department_scope") == [("a", "n", None), ("b", "n", "d")]


def test_page_limits(spark):
    df = spark.range(300)
    assert versions.page(df, [F.col("id")], limit=999, offset=10).count() == 200
    assert versions.page(df, [F.col("id")], limit=0, offset=-5).first().id == 0


def test_bucketed_scan_equals_plain_windows(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", i, rng.randrange(-3, 4)) for i in range(400)]
    df = spark.createDataFrame(data, "k string, i int, x int").repartition(4)
    got = bucketed_scan(df, ["k"], [F.col("i")], F.floor(F.col("i") / 13), "n", (F.col("x"), "total"), (F.col("i"), "prev"))
    count, total, prev = {}, {}, {}
    want = []
    for k, i, x in data:
        count[k], total[k] = count.get(k, 0) + 1, total.get(k, 0) + x
        want.append((k, i, count[k], total[k], prev.get(k)))
        prev[k] = i
    assert sorted(map(str, map(tuple, got.select("k", "i", "n", "total", "prev").collect()))) == sorted(map(str, want))


def test_salted_lookup_and_dimension_join_equal_plain_join(spark, monkeypatch):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id")).alias("k"))
    agg = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    want = rows(df.join(agg, "k"), "id", "first")
    assert rows(salted_lookup(df, agg, ["k"], "id", "n", hot_rows=10, salts=5), "id", "first") == want
    holes = df.withColumn("k", F.when(F.col("id") % 5 > 0, F.col("k")))
    assert rows(salted_lookup(holes, agg, ["k"], "id", "n", hot_rows=10, salts=5), "id", "first") == rows(holes.join(agg, "k", "left"), "id", "first")
    monkeypatch.setattr("lexgrove.scale.MAX_DIM_ROWS", 3)
    assert rows(dimension_join(df, agg, ["k"], "id"), "id", "first") == want


def test_dimension_join_broadcasts_only_what_was_measured(spark, monkeypatch):
    df = spark.range(500).select("id", (F.col("id") % 50).cast("string").alias("k"))
    dim = spark.createDataFrame([(str(k), "é" * 100) for k in range(40)], "k string, text string")
    plan = lambda how="inner": dimension_join(df, dim, ["k"], "id", how)._jdf.queryExecution().executedPlan().toString()
    want = {how: rows(df.join(dim, "k", how), "id", "text") for how in ("inner", "left")}
    assert "BroadcastHashJoin" in plan()
    # Too many rows; few rows of long texts: 40 of 200 bytes and 70 of keys.
    for limit, most in (("MAX_DIM_ROWS", 39), ("MAX_DIM_BYTES", 8069)):
        with monkeypatch.context() as m:
            m.setattr(f"lexgrove.scale.{limit}", most)
            for how in want:
                assert "Broadcast" not in plan(how) and "SortMergeJoin" in plan(how)
                assert rows(dimension_join(df, dim, ["k"], "id", how), "id", "text") == want[how]
    monkeypatch.setattr("lexgrove.scale.MAX_DIM_BYTES", 8070)
    assert "BroadcastHashJoin" in plan()
    assert dimension_join(df, dim.limit(0), ["k"], "id").count() == 0


EVENTS = "batch_id string, item_id string, ts timestamp, seq long, status string"


def events(spark, data):
    raw = spark.createDataFrame([("b", i, n, s) for n, (i, s) in enumerate(data)], "batch_id string, item_id string, n int, status string")
    ts = F.timestamp_seconds(F.col("n") * 50_000)
    return raw.select("batch_id", "item_id", ts.alias("ts"), F.col("n").cast("long").alias("seq"), "status")


@pytest.mark.parametrize(
    "data,want",
    [
        ([("a", "received"), ("a", "processing"), ("a", "ready")], "completed"),
        ([("a", "received"), ("b", "received"), ("a", "processing"), ("a", "failed"), ("b", "processing"), ("b", "ready")], "completed"),
        ([("a", "received"), ("b", "received"), ("a", "processing"), ("a", "ready"), ("b", "processing"), ("b", "failed")], "failed"),
        ([("a", "received"), ("a", "processing"), ("a", "failed"), ("a", "processing"), ("a", "ready")], "completed"),
        ([("a", "received"), ("b", "queued"), ("a", "failed")], "received"),
    ],
)
def test_batch_status_cases(spark, data, want):
    assert rows(status.batch_status(events(spark, data)), "batch_status") == [(want,)]
    assert rows(status.batch_status(events(spark, data), F.date_trunc("day", "ts")), "batch_status") == [(want,)]


def test_progress_counts(spark):
    items = status.fold_status(events(spark, [("a", "received"), ("a", "ready"), ("b", "failed"), ("c", "queued")]), ["batch_id", "item_id"])
    assert rows(status.batch_progress(items), "registered", "processing", "ready", "failed", "active", "is_complete") == [(3, 1, 1, 1, 1, False)]
    shapes = spark.createDataFrame([('{"counts":{"ready":3},"summary":{"ready":1,"failed":2}}',)], "p string")
    assert tuple(shapes.select(status.counts_of_payload(F.col("p")).alias("c")).first().c) == (0, 0, 1, 2)  # the last shape wins


KEYS = "arrival_seq long, policy_id string, content_sha256 string, metadata_sha256 string, version_label string"


def one_by_one(rows, taken=()):
    contents, labels, out = {(r[1], r[2], r[3]) for r in taken}, {(r[1], r[4]) for r in taken if r[4] is not None}, []
    for r in sorted(rows):
        if (r[1], r[2], r[3]) in contents or (r[4] is not None and (r[1], r[4]) in labels):
            continue
        contents.add((r[1], r[2], r[3]))
        labels.add((r[1], r[4]))
        out.append(r[0])
    return out


def jobs_of(spark, run):
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "settle")
    try:
        got = run()
        return got, len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_a_long_chain_of_clashes_takes_few_jobs(spark):
    """Each row waits for the one before it: 10,000 deep."""
    chain = [(i, "p", f"c{(i + 1) // 2}", "m", f"l{i // 2}") for i in range(10_000)]
    frame = spark.createDataFrame(chain, KEYS)
    run = lambda n: jobs_of(spark, lambda: sorted(r.arrival_seq for r in register.settle(frame.limit(n), frame.limit(0)).collect()))
    few, jobs_of_few = run(1000)
    many, jobs_of_many = run(10_000)
    assert few == one_by_one(chain[:1000]) and many == one_by_one(chain)
    # A round for every link would take thousands.
    assert jobs_of_many <= jobs_of_few + 10 <= 100


@pytest.mark.parametrize("fold_rows", [5, 10**6])
def test_settling_equals_one_by_one(spark, fold_rows):
    rng = random.Random(fold_rows)
    rows = [(i, rng.choice("pq"), rng.choice("abcdefghij"), rng.choice("mn"), rng.choice([None, *"uvwxyz"])) for i in rng.sample(range(1000), 150)]
    taken = [(0, "p", "a", "m", "u"), (0, "q", "z", "m", None)]
    frame, used = spark.createDataFrame(rows, KEYS), spark.createDataFrame(taken, KEYS)
    assert sorted(r.arrival_seq for r in register.settle(frame, used, fold_rows=fold_rows).collect()) == one_by_one(rows, taken)
    assert register.settle(frame.limit(0), used, fold_rows=fold_rows).count() == 0

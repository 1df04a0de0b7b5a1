import pytest
from pyspark.sql import functions as F

from conftest import rows
from lexgrove.operators import references as R

SEC = "tenant_id string, policy_id string, policy_version_id string, section_id string, section_index int, section_path string, title string, text string"


def sec(spark, data):
    """data: (section, index, path, text) of one version of policy p0."""
    return spark.createDataFrame([("t", "p0", "v0", s, i, p, f"T {s}", x) for s, i, p, x in data], SEC)


def pol(spark, names):
    return spark.createDataFrame([("t", f"p{i}", n, i) for i, n in enumerate(names)], "tenant_id string, policy_id string, name string, policy_order int")


def found(spark, text):
    df = R.extract_refs(sec(spark, [("s", 0, "chunk-1", text)])).orderBy("match_offset", "reference_type")
    return [(r.reference_type[:3], r.matched_text, r.match_offset, r.parsed_section_path) for r in df.collect()]


def test_texts_go_to_python_in_small_batches(spark):
    plan = R.extract_refs(sec(spark, [("s", 0, "chunk-1", "Section 1")]))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert found(spark, None) == [] and found(spark, "") == []


def test_patterns(spark):
    assert found(spark, "see §3.2") == [("int", "§3.2", 4, "3.2")]
    assert found(spark, "Section 4.1.2 and Subsection 5") == [("int", "Section 4.1.2", 0, "4.1.2"), ("int", "Subsection 5", 18, "5")]
    assert found(spark, "Sub-section 5") == [("int", "Sub-section 5", 0, "5"), ("int", "section 5", 4, "5")]
    assert found(spark, "PURSUANT TO the HR Policy And Leave Policy.") == [("cro", "HR Policy And Leave Policy", 16, None)]
    assert found(spark, "45 CFR §164.502") == [("ext", "45 CFR §164.502", 0, None), ("int", "§164.502", 7, "164.502")]
    assert found(spark, "(https://a.b/c.) under HIPAA") == [("ext", "https://a.b/c", 1, None), ("ext", "HIPAA", 23, None)]
    assert found(spark, "") == found(spark, None) == found(spark, "nothing here") == []


@pytest.mark.parametrize(
    "paths,ref,want",
    [
        ([("a", 0, "3.2"), ("b", 1, "3.2 Other")], "3.2", "a"),
        ([("a", 0, "13.21"), ("b", 1, "3.2 Eligibility")], "3.2", "b"),
        ([("a", 0, "chunk-1"), ("b", 1, "chunk-2"), ("c", 2, "chunk-3")], "3", "c"),
        ([("a", 0, "x"), ("b", 7, "y")], "7", "b"),
        ([("a", 0, "x")], "9.9", None),
        ([("a", 0, "3.2."), ("b", 1, "part 3.2, rest")], "3.2", "b"),
    ],
)
def test_internal_tiers(spark, paths, ref, want):
    s = sec(spark, [(i, n, p, "") for i, n, p in paths])
    refs = spark.createDataFrame([("v0", ref)], "policy_version_id string, parsed_section_path string")
    assert rows(R.resolve_internal(refs, s), "target_section_id") == [(want,)]


def test_name_scores(spark):
    df = spark.createDataFrame([("HR Leave Policy", "Leave HR SOP"), ("Leave Policy", "Annual Leave Policy"), ("The Policy", "Leave")], "a string, b string")
    assert [r.x for r in df.select(R.name_score(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 0.5, 0.0]


def brute_names(names, policies):
    tok = lambda n: {w.lower() for w in n.replace("-", " ").split() if w.lower() not in R.NAME_STOP}
    out = {}
    for n in names:
        best, score = None, 0.0
        for i, p in enumerate(policies):
            a, b = tok(n), tok(p)
            s = len(a & b) / max(len(a), len(b)) if a and b else 0.0
            if s > score:
                best, score = f"p{i}", s
        out[n] = best if score >= 0.6 else None
    return out


def test_rare_word_join_loses_no_match(spark):
    words = ["src", "leave", "data", "travel", "code", "risk"]
    policies = [" ".join(words[(i + j * (i % 3 + 1)) % 6] for j in range(i % 5 + 1)) + " Policy" for i in range(30)]
    names = [" ".join(words[(i * 2 + j) % 6] for j in range(i % 4 + 1)) + " SOP" for i in range(24)]
    asked = spark.createDataFrame([("t", n) for n in names], "tenant_id string, matched_text string")
    got = {r.matched_text: r.target_policy_id for r in R.match_names(asked, pol(spark, policies)).collect()}
    assert {n: got.get(n) for n in names} == brute_names(names, policies)


def test_edges_drop_self_references(spark):
    s = sec(spark, [("a", 0, "chunk-1", "See Section 1, Section 2, Section 9. Per the Home Policy, per the Other Policy, per the Unknown Policy."), ("b", 1, "chunk-2", None)])
    e = R.reference_edges(s, pol(spark, ["Home Policy", "Other Policy"]))
    assert rows(e, "matched_text", "resolution_status", "target_section_id", "target_policy_id") == sorted(
        [("Section 2", "resolved", "b", "p0"), ("Section 9", "unresolved", None, None), ("Other Policy", "resolved", None, "p1"), ("Unknown Policy", "unresolved", None, None)]
    )
    h = R.hydrate_targets(e, s, pol(spark, ["Home Policy", "Other Policy"]))
    assert ("Home Policy · T b",) in rows(h, "target_text") and ("Section 9",) in rows(h, "target_text")
    assert rows(R.inbound(e, "t", "b"), "source_section_id") == [("a",)] and R.inbound(e, "other", "b").count() == 0
    assert R.listing(e, "t", "a").count() == 4 and R.for_version(e, "t", "v0", limit=2).count() == 2


def test_backfill_processes_each_version_once(spark):
    s = sec(spark, [("a", 0, "chunk-1", "no reference")]).withColumn("parse_status", F.lit("ready"))
    none = spark.createDataFrame([], "policy_version_id string")
    edges, marks = R.backfill_references(s, pol(spark, ["x"]), none)
    assert edges.count() == 0 and rows(marks, "policy_version_id") == [("v0",)]
    assert R.backfill_references(s, pol(spark, ["x"]), marks)[1].count() == 0

import datetime
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from lexgrove.operators import fulltext, ranking, vectors
from lexgrove.operators.answers import REFUSAL_PHRASE, answer, has_citation, prompts
from lexgrove.operators.fusion import HybridConfig, fuse, merge_sources
from lexgrove.plans import corpus, registry
from lexgrove.plans.ask import ask, retrieve
from lexgrove.scale import fine_parts

FOUND = "question_id string, section_id string, policy_version_id string, policy_id string, score double, rank int"
FACTS = "question_id string, section_id string, authority_level int, effective_date date, is_current boolean, department_scope string"


def found(spark, data):
    """data: (section, policy, score) in rank order."""
    return spark.createDataFrame([("q", s, f"v{s}", p, float(x), i + 1) for i, (s, p, x) in enumerate(data)], FOUND)


def facts(spark, data):
    return spark.createDataFrame([("q", s, a, d, True, "all") for s, a, d in data], FACTS)


DAY = datetime.date(2025, 1, 1)


def test_merge_counts_shared_sections_once(spark):
    m = merge_sources(found(spark, [("s1", "p1", 0.9)]), found(spark, [("s1", "p1", 0.5), ("s2", "p2", 0.4)]), HybridConfig())
    out = fuse(m, facts(spark, [("s1", 10, DAY), ("s2", 10, DAY)]))
    got = {r.section_id: r for r in out.collect()}
    assert set(got) == {"s1", "s2"} and got["s1"].source == "hybrid"
    assert got["s1"].vector_candidates == 1 and got["s1"].fts_candidates == 2 and got["s1"].merged_candidates == 2
    assert got["s1"].retriever_source == "vector" and got["s2"].retriever_source == "fts"


def test_floors_drop_weak_rows(spark):
    m = merge_sources(found(spark, [("a", "p", 0.9), ("b", "p", 0.64)]), found(spark, [("c", "p", 0.3), ("d", "p", 0.01)]), HybridConfig())
    assert rows(m, "section_id") == [("a",), ("c",)]


def test_fused_order_prefers_authority_and_recency(spark):
    m = merge_sources(found(spark, [("s1", "p1", 0.95), ("s2", "p2", 0.7)]), found(spark, [("s2", "p2", 0.95), ("s1", "p1", 0.1)]), HybridConfig())
    out = fuse(m, facts(spark, [("s1", 20, datetime.date(2025, 1, 1)), ("s2", 100, datetime.date(2026, 1, 1))])).orderBy("rank").collect()
    assert [r.section_id for r in out] == ["s2", "s1"]
    assert out[0].score == pytest.approx(0.45 * 0.7 / 0.95 + 0.35 + 0.15 + 0.05, abs=1e-8)


def test_cap_of_two_per_policy_and_more_than_fifteen(spark):
    none = found(spark, [])
    five = merge_sources(found(spark, [(f"s{i}", "p", 0.9 - i / 100) for i in range(5)]), none, HybridConfig())
    assert fuse(five, facts(spark, [(f"s{i}", 1, DAY) for i in range(5)])).count() == 2
    many = merge_sources(found(spark, [(f"s{i}", f"p{i}", 0.9) for i in range(20)]), none, HybridConfig())
    assert fuse(many, facts(spark, [(f"s{i}", 1, DAY) for i in range(20)])).count() == 20


def test_weights_are_scaled_and_fall_back():
    assert sum(HybridConfig(vector_weight=9).weights()) == pytest.approx(1)
    assert HybridConfig(vector_weight=0, fts_weight=0, authority_weight=0, recency_weight=0).weights() == (0.45, 0.35, 0.15, 0.05)


CAND = (
    "question_id string, section_id string, policy_version_id string, policy_id string, score double, department_scope string, department string, "
    "user_department string, authority_level int, effective_date date, is_current boolean, policy_name string, title string, section_path string, "
    "public_url string, text string, source string, rank int"
)


def cands(spark, data, dept="operations"):
    """data: (section, score, scope, current)."""
    return spark.createDataFrame(
        [("q", s, f"v-{s}", f"p-{s}", float(x), scope, dept, dept, 50, DAY, cur, "Name", "Title", "chunk-1", None, f"text {s}", "hybrid", i + 1) for i, (s, x, scope, cur) in enumerate(data)], CAND
    )


def order_of(spark, data, **kw):
    return [r.section_id for r in ranking.rank_candidates(cands(spark, data, **kw)).orderBy("evidence_rank").collect()]


def test_currency_discount_only_orders(spark):
    assert order_of(spark, [("old", 0.4, "all", False), ("new", 0.3, "all", True)]) == ["new", "old"]
    assert order_of(spark, [("old", 0.95, "all", False), ("new", 0.2, "all", True)]) == ["old", "new"]


def test_department_bucket_wins_over_score(spark):
    data = [("all", 0.9, "all", True), ("ops", 0.2, " Operations ", True)]
    assert order_of(spark, data) == ["ops"]
    assert order_of(spark, data, dept="compliance") == ["all"]


def answered(spark, data, **kw):
    q = spark.createDataFrame([("q", "t", "Why?", "operations")], "question_id string, tenant_id string, question string, department string")
    return answer(q, ranking.rank_evidence(ranking.assign_buckets(cands(spark, data)), kw.pop("mode", "first_bucket")), **kw)


def test_rich_answer_with_secondary_evidence(spark):
    a = answered(spark, [("d", 0.91, "operations", True), ("o", 0.88, "all", True)]).first()
    assert a.refusal_reason is None and a.confidence == 0.91 and a.decision.selected_bucket == "department_specific"
    assert (a.decision.primary_candidates, a.decision.secondary_candidates) == (1, 1)
    assert a.answer == "text d [policy_version_id=v-d section_id=d]" and [s.section_id for s in a.secondary_evidence] == ["o"]
    assert len(a.citations) == 1 and a.citation_items[0].snippet == "text d"


def test_secondary_modes(spark):
    data = [("d", 0.91, "operations", True), ("o", 0.87, "all", True), ("c", 0.88, "jfs", True)]
    assert [s.section_id for s in answered(spark, data).first().secondary_evidence] == ["o"]
    assert [s.section_id for s in answered(spark, data, mode="all").first().secondary_evidence] == ["c", "o"]


def test_refusals(spark):
    weak = answered(spark, [("d", 0.42, "operations", True)]).first()
    assert weak.answer == REFUSAL_PHRASE and weak.confidence == 0 and len(weak.evidence) == 1 and weak.citations == [] and weak.decision is None
    assert weak.retrieval_log.primary_score == 0.42
    none = answered(spark, []).first()
    assert none.refusal_reason == "insufficient_evidence" and none.evidence == [] and none.citation_items == [] and none.retrieval_log.merged == 0
    assert answered(spark, []).select(has_citation(F.col("answer"))).first()[0] is False


def test_prompt_lines(spark):
    p = prompts(answered(spark, [("d", 0.91, "operations", True)])).first().prompt
    assert p == "Question: Why?\n\nEvidence:\n[1] [policy_version_id=v-d section_id=d] text d\n\nAnswer (cite using the format [policy_version_id=... section_id=...]):"


VEC = "section_id string, policy_version_id string, policy_id string, tenant_id string, is_current boolean, policy_type string, embedding array<float>"
ASK = "question_id string, tenant_id string, question string, only_current boolean, policy_types array<string>, vector array<float>"


@pytest.fixture(scope="module")
def vector_set(spark):
    rng = np.random.default_rng(1)
    emb = rng.normal(size=(300, 8)).astype("float32")
    emb[50] = emb[51]
    data = [(f"s{i:03d}", f"v{i}", f"p{i % 7}", f"t{i % 2}", i % 3 != 0, "ab"[i % 2 == 1], emb[i].tolist()) for i in range(300)]
    q = rng.normal(size=(25, 8)).astype("float32")
    q[0] = emb[51]
    asks = [(f"q{i}", f"t{i % 2}", "text", i % 2 == 0, ["a"] if i % 5 == 0 else None, q[i].tolist()) for i in range(25)]
    return spark.createDataFrame(data, VEC).repartition(5), spark.createDataFrame(asks, ASK), data, asks


def brute_vectors(data, asks, k):
    out = []
    for qid, tenant, _, current, kinds, qv in asks:
        hits = []
        for sid, _, _, t, cur, kind, ev in data:
            if t == tenant and (cur or not current) and (kinds is None or kind in kinds):
                a, b = np.array(qv, dtype=float), np.array(ev, dtype=float)
                hits.append((-round(min(1, max(0, float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)))), 9), sid))
        out += [(qid, sid, i + 1) for i, (_, sid) in enumerate(sorted(hits)[:k])]
    return sorted(out)


def test_vector_topk_is_exact_in_both_plans(spark, vector_set):
    emb, asks, data, raw = vector_set
    want = brute_vectors(data, raw, 5)
    one_block = vectors.vector_topk(asks, emb, 5)
    blocks = vectors.vector_topk(asks, emb, 5, block=4, fragment_rows=70)
    assert sorted(map(tuple, one_block.select("question_id", "section_id", "rank").collect())) == want
    assert sorted(map(tuple, blocks.select("question_id", "section_id", "rank").collect())) == want


def test_cosine_expression(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r.x, 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [0.707107, 0.0]


def test_identifier_boost(spark):
    df = spark.createDataFrame(
        [("about ac-002 and IA-5(1)", "AC-2", 0.7), ("about ac-002", "ac-2", 0.3), ("about ac-002", "AC-20", 0.3), ("none", "AC-2", 0.3)], "question string, section_path string, score double"
    )
    assert [round(r.score, 6) for r in vectors.boost_exact(df).collect()] == [0.99, 0.7, 0.3, 0.3]
    assert df.select(vectors.control_ids(F.col("question"))).first()[0] == ["AC-2", "IA-5(1)"]


SEC = "section_id string, policy_version_id string, policy_id string, tenant_id string, is_current boolean, fts_policy_type string, text string"


def sections(spark, texts):
    return spark.createDataFrame([(f"s{i}", f"v{i}", f"p{i}", "t", True, "general", t) for i, t in enumerate(texts)], SEC)


def ask_df(spark, *texts):
    return spark.createDataFrame([(f"q{i}", "t", t) for i, t in enumerate(texts)], "question_id string, tenant_id string, question string")


def test_rank_constants(spark):
    got = {r.question_id: round(r.score, 7) for r in fulltext.fts_topk(ask_df(spark, "leave", "annual leave"), sections(spark, ["annual leave"])).collect()}
    assert got == {"q0": 0.0607927, "q1": 0.0991032}


def test_or_only_where_and_finds_nothing(spark):
    s = sections(spark, ["appeal deadline", "appeal appeal", "other"])
    got = rows(fulltext.fts_topk(ask_df(spark, "appeal deadline", "appeal missing", "missing", "the of"), s), "question_id", "section_id")
    assert got == [("q0", "s0"), ("q1", "s0"), ("q1", "s1")]
    two = {r.section_id: r.score for r in fulltext.fts_topk(ask_df(spark, "appeal missing"), s).collect()}
    assert two["s0"] == pytest.approx(0.0303964, abs=1e-6) and two["s1"] > two["s0"]


def brute_and(words, text):
    pos = {w: [i + 1 for i, t in enumerate(text.split()) if t == w] for w in words}
    miss = 1.0
    for a, b in itertools.combinations(sorted(words), 2):
        for x in pos[a]:
            for y in pos[b]:
                d = abs(x - y)
                near = 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)) if d <= 100 else 1e-30
                miss *= 1 - math.sqrt(0.01 * near)
    return 1 - miss


def test_and_rank_from_positions(spark):
    text = "cat x dog cat x x bird dog " + "y " * 120 + "bird"
    r = fulltext.fts_topk(ask_df(spark, "dog bird cat"), sections(spark, [text])).first()
    assert r.score == pytest.approx(brute_and(["bird", "cat", "dog"], text), abs=1e-8)


def test_stored_postings_and_salted_terms_give_the_same(spark, monkeypatch):
    s = sections(spark, ["appeal deadline appeal", "appeal", "deadline x appeal", "x"])
    q = ask_df(spark, "appeal deadline", "appeal missing", "x")
    want = rows(fulltext.fts_topk(q, s), "question_id", "section_id", "score")
    stored = fulltext.build_postings(fulltext.section_tokens(s))
    assert rows(fulltext.fts_topk(q, s, postings=stored), "question_id", "section_id", "score") == want
    monkeypatch.setattr(fulltext, "MAX_BROADCAST_TERMS", 1)
    monkeypatch.setattr(fulltext, "MAX_BROADCAST_PAIRS", 0)
    assert rows(fulltext.fts_topk(q, s), "question_id", "section_id", "score") == want


def test_postings_are_built_inside_one_row_per_section(spark):
    s = sections(spark, ["Cat x cat, the dog", "the", "", "dog"])
    twice = s.unionByName(s.where("section_id = 's3'"))
    words = fulltext.section_tokens(twice)
    assert words.count() == s.count()
    got = [(r.section_id, r.token, list(r.positions)) for r in fulltext.build_postings(words).orderBy("section_id", "token").collect()]
    first, last = sorted(r.section_id for r in s.collect())[:4:3]
    assert got == [(first, "cat", [1, 3]), (first, "dog", [5]), (first, "x", [2]), (last, "dog", [1, 1])]


def test_a_search_task_gets_a_bounded_share_of_the_sections(spark, sf, monkeypatch):
    docs = corpus.table(spark, sf, "documents")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert fine_parts(docs, "doc_id", size // 40).rdd.getNumPartitions() >= 40
    made = spark.createDataFrame([(1,), (2,)], "doc_id long").repartition(3)
    assert fine_parts(made, "doc_id").rdd.getNumPartitions() == 3
    asked = []
    monkeypatch.setattr(fulltext, "fine_parts", lambda df, key: asked.append(key) or fine_parts(df, key, size // 40))
    s = corpus.sections(spark, sf).where(F.col("parse_status") == "ready")
    fulltext.fts_topk(corpus.questions(spark, sf).limit(1), s)
    assert asked == ["policy_version_id"]


def test_replay_cuts_the_sections_once_for_both_runs(spark, sf, monkeypatch):
    class Searched(Exception):
        pass

    def searched(questions, sections, vectors, **_):
        assert "Generate" not in sections._jdf.queryExecution().optimizedPlan().toString()
        raise Searched

    monkeypatch.setattr(registry.ask, "ask", searched)
    with pytest.raises(Searched):
        registry.audit_replay(spark, sf)


def test_ask_modes_and_blank_question(spark, sf):
    s, e = corpus.sections(spark, sf).where(F.col("parse_status") == "ready"), corpus.embeddings(spark, sf)
    q = corpus.questions(spark, sf).limit(3)
    blank = q.limit(1).withColumn("question_id", F.lit("blank")).withColumn("question", F.lit("  "))
    a = ask(q.unionByName(blank), s, None, min_score=0.0)
    got = {r.question_id: r.refusal_reason for r in a.collect()}
    assert len(got) == 4 and got["blank"] == "insufficient_evidence"


def test_plans_keep_pushdown_and_have_no_cross_join(spark, sf):
    f = fulltext.fts_topk(corpus.questions(spark, sf), corpus.sections(spark, sf).where(F.col("parse_status") == "ready"))
    plan = f._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "WindowGroupLimit" in plan


def test_store_mode_raises_named_sections_and_keeps_the_order_of_others(spark):
    sections = spark.createDataFrame(
        [(f"s{i}", "p", "t", f"AC-{i}", i, None, None if i == 3 else f"text {i}", "all", 1, None, i != 1, "general") for i in range(5)],
        "section_id string, policy_name string, title string, section_path string, section_index int, public_url string, text string, department_scope string, "
        "authority_level int, effective_date date, is_current boolean, policy_type string",
    )
    vectors_ = spark.createDataFrame(
        [(f"s{i}", f"v{i}", "p0", "a", i != 1, "general", [1.0, i / 10]) for i in range(5)] + [("s9", "v9", "p0", "b", True, "general", [1.0, 0.0])],
        "section_id string, policy_version_id string, policy_id string, tenant_id string, is_current boolean, policy_type string, embedding array<float>",
    )
    questions = spark.createDataFrame(
        [("named", "a", "what says ac-04?", "claims_ops", True, [1.0, 0.0]), ("plain", "a", "what is it?", "claims_ops", True, [1.0, 0.0]), ("blank", "a", "  ", None, True, [1.0, 0.0])],
        "question_id string, tenant_id string, question string, department string, only_current boolean, vector array<double>",
    )
    found = retrieve(questions, sections, vectors_, "store")
    order = {q: [r.section_id for r in found.where(F.col("question_id") == q).orderBy("rank").collect()] for q in ("named", "plain", "blank")}
    # The section without a text goes; the one that is not current stays, as does its place.
    assert order == {"named": ["s0", "s1", "s4", "s2"], "plain": ["s0", "s1", "s2", "s4"], "blank": []}
    scores = {r.section_id: r.score for r in found.where("question_id = 'named'").collect()}
    assert scores["s4"] == pytest.approx(0.99) and scores["s0"] == pytest.approx(1.0)
    assert retrieve(questions, sections, None, "store").count() == 0
    answer = {r.question_id: r for r in ask(questions, sections, vectors_, "store").collect()}
    assert answer["plain"].answer.startswith("text 0") and answer["blank"].refusal_reason == "insufficient_evidence"

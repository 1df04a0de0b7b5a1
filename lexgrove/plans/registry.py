"""Named queries over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions import ids, text, urls
from lexgrove.operators import (
    answers, audit, catalog, downloads, embedding, evaluation, fulltext, pages, ranking, references, register, status, vectors,
    versions,
)
from lexgrove.operators.fusion import HybridConfig
from lexgrove.operators.observed import Counts
from lexgrove.plans import ask, corpus, ingest
from lexgrove.scale import dimension_join, spread
from lexgrove.session import cut_lineage, shared_dir, stored
from lexgrove.sources import commits, sinks
from lexgrove.streaming import ingest_stream, keyed, progress

# No two vectors of the given table reach the default floor of 0.65 unless they are the same.
HYBRID = HybridConfig(vector_floor=0.2)
MIN_SCORE = 0.5
RULES = pages.LinkRules(agency="DEMO", hosts=(".example.",), suffixes=(".html", ".pdf"), path_parts=("the", "policy"))
MAX_PAGE_BYTES = 12_000


def ready_sections(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.sections(spark, sf).where(F.col("parse_status") == "ready")


def r6(c: str) -> Column:
    return F.round(F.col(c), 6).alias(c)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one for the output of one streaming run."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- versions, registration, listings -------------------------------------------------------


def version_lineage(spark, sf):
    v = versions.number_versions(corpus.version_facts(spark, sf))
    return v.select("policy_id", "policy_version_id", "version_number", "supersedes_policy_version_id")


def current_versions(spark, sf):
    return versions.current_versions(corpus.version_facts(spark, sf))


def policy_catalog(spark, sf):
    v = versions.number_versions(corpus.version_facts(spark, sf))
    current = versions.current_versions(v)
    latest = versions.latest_versions(v).select("policy_id", F.col("version_number").alias("latest_number"), F.col("policy_version_id").alias("latest_version_id"))
    p = versions.set_policy_pointer(corpus.policies(spark, sf), current).join(latest, "policy_id")
    return p.select(
        "policy_id", "tenant_id", "name", F.col("authority_level").cast("long").alias("authority_level"), "department_scope",
        "policy_type", "current_version_id", "latest_number", "latest_version_id",
    ).orderBy("tenant_id", "policy_id")


def _registered(spark, sf, label: Column | None = None) -> register.RegisterResult:
    rows = corpus.incoming(spark, sf)
    if label is not None:
        rows = rows.withColumn("version_label", label)
    return register.register(rows, corpus.no_policies(spark), corpus.no_versions(spark))


def duplicate_rejects(spark, sf):
    return _registered(spark, sf).rejects.select("arrival_seq", "policy_id", "reason", "existing_policy_version_id")


def label_conflicts(spark, sf):
    """Labels by text length: equal texts have equal labels, other texts may clash."""
    return _registered(spark, sf, F.length("content").cast("string")).rejects.select("arrival_seq", "version_label", "reason", "existing_policy_version_id")


def registered_versions(spark, sf):
    v = _registered(spark, sf).versions
    return v.select("arrival_seq", "policy_id", "policy_version_id", "version_number", "supersedes_policy_version_id", "content_sha256", "metadata_sha256", "parse_status")


def registered_items(spark, sf):
    items = _registered(spark, sf).items
    return items.groupBy("batch_id", "status").agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("policy_id").alias("n_policies"))


def policy_first_write(spark, sf):
    """First-write rules over metadata that differs by document."""
    doc = F.col("arrival_seq")
    meta = F.concat(
        F.lit('{"type":"'), F.when(F.length("content") % 3 == 0, "").otherwise(F.concat(F.lit("kind"), (F.length("content") % 4).cast("string"))),
        F.lit('","department":"'), F.when(F.length("content") % 2 == 0, "all").otherwise(F.concat(F.lit("dept"), (doc % 3).cast("string"))),
        F.lit('","authority_level":'), (F.length("content") % 5).cast("string"), F.lit("}"),
    )
    rows = corpus.incoming(spark, sf).withColumn("metadata_json", meta).withColumn("policy_external_id", F.col("batch_id"))
    p = register.register(rows, corpus.no_policies(spark), corpus.no_versions(spark)).policies
    return p.select("external_id", "policy_id", "policy_type", "department_scope", F.col("authority_level").cast("long").alias("authority_level"), "status")


def section_chunks(spark, sf):
    s = corpus.raw_sections(spark, sf)
    return s.select(
        "section_id", "policy_version_id", F.col("section_index").cast("long").alias("section_index"), "section_path", "title",
        F.col("start_offset").cast("long").alias("start_offset"), F.col("end_offset").cast("long").alias("end_offset"), ids.sha256_hex(F.col("text")).alias("content_sha256"),
    )


def section_page(spark, sf):
    s = corpus.raw_sections(spark, sf).select("policy_version_id", F.col("section_index").cast("long").alias("section_index"), "section_path", "title")
    return versions.page(s, [F.col("policy_version_id"), F.col("section_index")], limit=200, offset=200)


def section_detail(spark, sf):
    v = versions.mark_current(versions.number_versions(corpus.version_facts(spark, sf)), current_versions(spark, sf))
    p = corpus.policies(spark, sf)
    s = corpus.raw_sections(spark, sf).select("section_id", "policy_version_id", "section_path", "title", F.length("text").cast("long").alias("n_chars"))
    d = versions.section_detail(s, v, p)
    return d.select("section_id", "policy_id", "section_path", "title", "n_chars", "version_number", "effective_date", "parse_status", "is_current", "public_url", "policy_name", "department_scope")


def dirty_text() -> Column:
    """Document text with page markers, headers and footers around it."""
    mark = F.concat(F.lit("Confidential - "), "source")
    return F.concat(
        F.lit("  "), mark, F.lit("\r\nPage "), F.col("doc_id").cast("string"), F.lit(" of 9\rPDF  page x\n"), "text",
        F.lit("\n\n\n\n"), F.upper(mark), F.lit("\n\tSame line\t here\n\nSame line\t here\nAll rights reserved "), F.lit("x" * 80), F.lit("\n"),
        F.lit("All rights reserved "), F.lit("x" * 80), F.lit("\nEnd  \n"), mark, F.lit("\npaged 3\n  "),
    )


def clean_lines(spark, sf):
    d = spread(corpus.table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    c = d.select("doc_id", text.clean_text(dirty_text()).alias("t"))
    return c.select("doc_id", F.length("t").cast("long").alias("n_chars"), ids.sha256_hex(F.col("t")).alias("sha256"))


def extracted_documents(spark, sf):
    s = corpus.raw_sections(spark, sf).withColumn("tenant_id", corpus.tenant_of(F.regexp_extract("policy_id", r"(\d+)$", 1).cast("int")))
    d = sinks.extracted_documents(s, F.lit("2024-01-01T00:00:00Z"))
    whole = F.from_json("document", "struct<sections:array<struct<text:string,end_offset:long>>>")["sections"]
    d = d.withColumn("s", whole)
    return d.select(
        "policy_version_id", F.col("n_sections").cast("long").alias("n_sections"), "extracted_blob_name",
        ids.sha256_hex(F.array_join(F.transform("s", lambda x: x["text"]), "")).alias("text_sha256"), F.array_max(F.transform("s", lambda x: x["end_offset"])).alias("end_offset"),
    )


# --- status and progress ---------------------------------------------------------------------


def item_status(spark, sf):
    return status.fold_status(corpus.status_events(spark, sf), ["batch_id", "item_id"])


def batch_progress(spark, sf):
    return status.batch_progress(status.fold_status(corpus.status_events(spark, sf), ["batch_id", "item_id"]))


def batch_status(spark, sf):
    return status.batch_status(corpus.status_events(spark, sf))


def status_report(spark, sf):
    return status.status_report(item_status(spark, sf), ["received", "queued", "processing", "ready", "failed"])


def tenant_counts(spark, sf):
    s = corpus.raw_sections(spark, sf).withColumn("tenant_id", corpus.tenant_of(F.regexp_extract("policy_id", r"(\d+)$", 1).cast("int")))
    return status.tenant_counts(s.select("tenant_id"), corpus.embeddings(spark, sf).select("tenant_id"))


# --- embedding --------------------------------------------------------------------------------


def embed_backlog(spark, sf):
    b = embedding.backlog(ready_sections(spark, sf), corpus.stored_embeddings(spark, sf), corpus.MODEL, only_current=False)
    return b.select("section_id", "policy_version_id", "policy_id")


def embedding_text(spark, sf):
    s = ready_sections(spark, sf)
    t = embedding.embedding_text(*(F.col(c) for c in ("policy_type", "department_scope", "authority_level", "title", "text")))
    return s.select("section_id", F.length(t).cast("long").alias("n_chars"), ids.sha256_hex(t).alias("sha256"))


def embed_backfill(spark, sf):
    """Vectors of all sections without one: count and unit norm per policy."""
    new = embedding.embed_missing(ready_sections(spark, sf), corpus.stored_embeddings(spark, sf), embedding.hashing_embedder(), corpus.MODEL, only_current=False)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return new.groupBy("policy_id").agg(F.count(F.lit(1)).alias("inserted"), F.round(F.avg(norm), 3).alias("avg_norm"))


def backfill_counts(spark, sf):
    """What both backfills counted while their rows were written."""
    home = run_folder(spark, "backfill")
    vectors_, refs = Counts(), Counts()
    s = ready_sections(spark, sf)
    new = embedding.embed_missing(s, corpus.stored_embeddings(spark, sf), embedding.hashing_embedder(), corpus.MODEL, False, vectors_)
    new.write.parquet(f"{home}/embeddings")
    p = corpus.policies(spark, sf)
    r = _referring(spark, sf).join(corpus.version_facts(spark, sf).select("policy_version_id", "parse_status"), "policy_version_id")
    r = r.withColumn("section_index", F.lit(0)).withColumn("section_path", F.lit("chunk-1"))
    edges, marks = references.backfill_references(r, p, r.limit(0).select("policy_version_id"), refs)
    edges.write.parquet(f"{home}/edges")
    marks.write.parquet(f"{home}/marks")
    found = [(job, name, n) for job, c in (("embeddings", vectors_), ("references", refs)) for name, n in c.get().items() if name in ("scanned", "inserted")]
    return spark.createDataFrame(found, "job string, name string, n long")


# --- retrieval, ranking, answers --------------------------------------------------------------


def vector_topk(spark, sf):
    v = vectors.vector_topk(corpus.questions(spark, sf), corpus.embeddings(spark, sf))
    return v.select("question_id", "section_id", r6("score"), F.col("rank").cast("long").alias("rank"))


def vector_topk_unscoped(spark, sf):
    """Tenant filter only, 40 per question."""
    v = vectors.vector_topk(corpus.questions(spark, sf), corpus.embeddings(spark, sf), k=40, scoped=False)
    return v.select("question_id", "section_id", r6("score"), F.col("rank").cast("long").alias("rank"))


def _naming(spark, sf):
    """Questions that name identifiers, and the identifier of each section with a vector."""
    n = F.pmod(F.regexp_extract("question_id", r"\d+", 0).cast("int"), F.lit(10)).cast("string")
    q = corpus.questions(spark, sf).withColumn("question", F.concat("question", F.lit(" see ac-0"), n, F.lit(" and IA-5(1)")))
    paths = corpus.table(spark, sf, "embeddings").select(
        corpus.section_id(corpus.version_id(F.col("vec_id")), F.lit(0)).alias("section_id"), F.concat(F.lit("AC-"), F.col("label").cast("string")).alias("section_path")
    )
    return q, paths


def id_boost(spark, sf):
    q, paths = _naming(spark, sf)
    v = vectors.vector_topk(q, corpus.embeddings(spark, sf)).join(paths, "section_id").join(q.select("question_id", "question"), "question_id")
    return vectors.boost_exact(v).select("question_id", "section_id", r6("score"), F.array_join(vectors.control_ids(F.col("question")), ",").alias("named"))


def answers_by_id(spark, sf):
    """Answers out of the document store: tenant scope only, sections raised that the question names."""
    q, paths = _naming(spark, sf)
    s = ready_sections(spark, sf).drop("section_path").join(paths, "section_id")
    return _answer_columns(ask.ask(q, s, corpus.embeddings(spark, sf), "store", HYBRID, MIN_SCORE))


def vector_literals(spark, sf):
    """Text form of stored vectors, of their components to small and large powers of ten."""
    e = corpus.table(spark, sf, "embeddings")
    power = lambda i, n: F.pow(F.lit(10.0), F.pmod(i, F.lit(n)).cast("double"))
    large = F.transform("embedding", lambda v, i: v.cast("double") * power(i, 20))
    small = F.transform("embedding", lambda v, i: v.cast("double") / power(i, 14))
    return e.select("vec_id", *(vectors.vector_literal(x).alias(name) for name, x in (("literal", F.col("embedding")), ("large", large), ("small", small))))


def fts_rank(spark, sf):
    f = fulltext.fts_topk(corpus.questions(spark, sf), ready_sections(spark, sf))
    return f.select("question_id", "section_id", r6("score"), F.col("rank").cast("long").alias("rank"))


def postings(spark, sf):
    """Posting table statistics per section."""
    p = fulltext.build_postings(fulltext.section_tokens(ready_sections(spark, sf)))
    return p.groupBy("section_id").agg(
        F.count(F.lit(1)).alias("n_words"), F.sum(F.size("positions")).alias("n_positions"), F.max(F.array_max("positions")).cast("long").alias("last_position")
    )


def _retrieved(spark, sf, mode="hybrid"):
    return ask.retrieve(corpus.questions(spark, sf), ready_sections(spark, sf), corpus.embeddings(spark, sf), mode, HYBRID)


def hybrid_fusion(spark, sf):
    h = _retrieved(spark, sf)
    return h.select(
        "question_id", "section_id", "policy_id", r6("score"), r6("vector_score"), r6("fts_score"), r6("authority_weight"), r6("recency_weight"),
        "retriever_source", "vector_candidates", "fts_candidates", "merged_candidates", "filtered_candidates", F.col("rank").cast("long").alias("rank"),
    )


def _ranked(spark, sf, mode="first_bucket"):
    return ranking.rank_evidence(ranking.assign_buckets(_retrieved(spark, sf)), mode)


def dept_ranked(spark, sf):
    return _ranked(spark, sf).select(
        "question_id", "section_id", "selected_bucket", "is_primary", F.col("bucket").cast("long").alias("bucket"), F.col("evidence_rank").cast("long").alias("evidence_rank"),
        "primary_candidates", "secondary_candidates",
    )


def secondary_all(spark, sf):
    """Ranked secondary pool with org-wide and cross-department rows together."""
    r = _ranked(spark, sf, "all").where(~F.col("is_primary"))
    return r.select("question_id", "section_id", F.col("bucket").cast("long").alias("bucket"), F.col("evidence_rank").cast("long").alias("evidence_rank"))


def _answers(spark, sf, **kw):
    return ask.ask(corpus.questions(spark, sf), ready_sections(spark, sf), corpus.embeddings(spark, sf), cfg=HYBRID, min_score=MIN_SCORE, **kw)


def answers_query(spark, sf):
    return _answer_columns(_answers(spark, sf))


def _answer_columns(a: DataFrame) -> DataFrame:
    return a.select(
        "question_id", "answer", "refusal_reason", r6("confidence"), F.size("evidence").cast("long").alias("n_evidence"),
        F.array_join("citations", "|").alias("citations"), F.array_join(F.transform("citation_items", lambda i: i["snippet"]), "|").alias("snippets"),
        F.col("decision.selected_bucket").alias("decision_bucket"), F.col("decision.user_department").alias("user_department"),
        F.col("retrieval_log.merged").alias("merged"), F.col("retrieval_log.filtered").alias("filtered"), F.round("retrieval_log.primary_score", 6).alias("primary_score"),
    )


def secondary_evidence(spark, sf):
    a = _answers(spark, sf, secondary_ratio=0.5)
    e = a.select("question_id", F.posexplode("secondary_evidence").alias("pos", "e"))
    return e.select("question_id", F.col("pos").cast("long").alias("pos"), F.col("e.section_id").alias("section_id"), F.round("e.score", 6).alias("score"), F.col("e.department_scope").alias("department_scope"))


def prompts(spark, sf):
    p = answers.prompts(_answers(spark, sf))
    return p.select("question_id", F.length("prompt").cast("long").alias("n_chars"), ids.sha256_hex(F.col("prompt")).alias("sha256"))


def answer_card(spark, sf):
    return answers.answer_card(_answers(spark, sf))


def evidence_packet(spark, sf):
    p = answers.evidence_packet(_answers(spark, sf))
    got = F.from_json("packet", "struct<evidence:array<struct<section_id:string>>>")["evidence"]
    return p.select("question_id", F.array_join(F.transform(got, lambda e: e["section_id"]), ",").alias("sections"))


def model_answers(spark, sf):
    """Answers of an outside model, some of which decline with the refusal phrase."""
    declined = F.concat(F.lit("Sorry: "), F.upper(F.lit(answers.REFUSAL_PHRASE)))
    q = corpus.questions(spark, sf).withColumn("model_answer", F.when(F.length("question") % 2 == 0, declined).otherwise("Yes. [policy_version_id=x]"))
    a = ask.ask(q, ready_sections(spark, sf), corpus.embeddings(spark, sf), cfg=HYBRID, min_score=0.3, supplied="model_answer")
    return a.select("question_id", "answer", "refusal_reason", r6("confidence"), answers.has_citation(F.col("answer")).alias("cited"), F.size("citations").cast("long").alias("n_citations"))


def audit_append(spark, sf):
    """Conversation pairs as recorded requests and responses."""
    rows = _conversation_audit(spark, sf)
    return rows.select(
        "tenant_id", "event_type", F.get_json_object("payload", "$.request.question_id").alias("question_id"),
        ids.sha256_hex(F.get_json_object("payload", "$.request.question")).alias("question_sha256"),
        ids.sha256_hex(F.get_json_object("payload", "$.response.answer")).alias("answer_sha256"),
    )


def _conversation_audit(spark, sf):
    c = corpus.table(spark, sf, "conversations")
    asked = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    replied = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = asked.join(replied, ["conv_id", "turn"])
    rows = pairs.select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"), corpus.tenant_of(F.col("conv_id")).alias("tenant_id"),
        "question", "answer", F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("department"),
    )
    return audit.audit_rows(rows, "conversations", F.lit("2024-01-01").cast("timestamp"))


def audit_replay(spark, sf):
    """Ask all recorded questions again from their audit rows and compare."""
    # Both runs search the same sections, cleaned and cut once.
    s, e = stored(ready_sections(spark, sf), "sections"), corpus.embeddings(spark, sf)
    vector = corpus.questions(spark, sf).select("question_id", "vector")
    ask_all = lambda q: ask.ask(q, s, e, cfg=HYBRID, min_score=MIN_SCORE)
    run = lambda q: ask_all(q.join(vector, "question_id", "left"))
    first = cut_lineage(audit.audit_rows(ask_all(corpus.questions(spark, sf)), "first"))
    d = audit.replay_diff(first, audit.replay(first, run, "again"))
    return d.select("question_id", "same", F.round("old_confidence", 6).alias("old_confidence"), F.round("new_confidence", 6).alias("new_confidence"))


def _evaluated(spark, sf):
    q = corpus.table(spark, sf, "benchmark").join(corpus.table(spark, sf, "labels"), F.col("item_id") == F.col("doc_id"), "left")
    expected = q.select(
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question_id"),
        F.when(F.col("quality") == 1, "labelled good").when(F.col("quality") == 0, "labelled bad").otherwise("unlabelled").alias("category"),
        F.when(F.coalesce("quality", F.lit(1)) == 1, "ground").otherwise("refuse").alias("expectation"),
    )
    return evaluation.evaluate(_answers(spark, sf), expected)


def eval_report(spark, sf):
    return evaluation.pass_report(_evaluated(spark, sf))


def eval_outcomes(spark, sf):
    return _evaluated(spark, sf).select("question_id", "category", "expectation", "status", "ok", F.array_join("cites", ",").alias("cites"))


# --- references --------------------------------------------------------------------------------


def _referring(spark, sf):
    """Documents with references in their text: one section per document, whole text."""
    n = F.col("doc_id")
    p = corpus.policies(spark, sf).select("policy_id", "tenant_id", F.col("idx").alias("p_idx"))
    other = F.pmod(n * 7 + F.length("text"), F.lit(40)).cast("string")
    suffix = F.concat(
        F.lit(" See Section "), (n % 7 + 1).cast("string"), F.lit(" and pursuant to the Src S"), other, F.lit(" Policy; 45 CFR §164."), (n % 600).cast("string"),
        F.lit(". HIPAA applies, https://x.example.org/"), n.cast("string"), F.lit("."),
    )
    d = spread(corpus.table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("policy_id")), "doc_id")
    return dimension_join(d, p, ["policy_id"], "doc_id").select(
        "tenant_id", "policy_id", corpus.version_id(n).alias("policy_version_id"), corpus.section_id(corpus.version_id(n), F.lit(0)).alias("section_id"),
        F.concat("text", suffix).alias("text"),
    )


def refs_extracted(spark, sf):
    r = references.extract_refs(_referring(spark, sf))
    return r.select("section_id", "reference_type", "matched_text", F.col("match_offset").cast("long").alias("match_offset"), "parsed_section_path", "external_uri", "external_label", "confidence")


def _edges(spark, sf):
    """Edges of the referring texts; internal targets are looked up among the chunks of the version."""
    refs = references.extract_refs(_referring(spark, sf))
    return references.reference_edges(corpus.raw_sections(spark, sf).drop("text"), corpus.policies(spark, sf).withColumn("policy_order", F.col("idx")), refs)


def refs_resolved(spark, sf):
    return _edges(spark, sf).select(
        "source_section_id", "reference_type", "resolution_status", "matched_text", F.col("match_offset").cast("long").alias("match_offset"),
        "target_section_id", "target_policy_id", "target_external_label",
    )


def refs_inbound(spark, sf):
    """Inbound references per target section and policy, with the names of the targets."""
    h = references.hydrate_targets(_edges(spark, sf), corpus.raw_sections(spark, sf), corpus.policies(spark, sf))
    return h.where(F.col("target_policy_id").isNotNull()).groupBy("target_policy_id", "target_section_id", "target_text").agg(F.count(F.lit(1)).alias("inbound"))


def name_similarity(spark, sf):
    """Word overlap between each user turn and the reply to it."""
    c = corpus.table(spark, sf, "conversations")
    a = c.select("conv_id", "turn", F.col("text").alias("a"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(references.name_score(F.col("a"), F.col("b")), 6).alias("score"))


def reference_backfill(spark, sf):
    """Two runs: the first has half of the versions, the second all of them and leaves out what the first has marked."""
    s = _referring(spark, sf).join(corpus.version_facts(spark, sf).select("policy_version_id", "parse_status"), "policy_version_id")
    s = s.withColumn("section_index", F.lit(0)).withColumn("section_path", F.lit("chunk-1"))
    p = corpus.policies(spark, sf)
    edges, marks = references.backfill_references(s.where(F.length("text") % 2 == 0), p, s.limit(0).select("policy_version_id"))
    marks = cut_lineage(marks)
    more_edges, more_marks = references.backfill_references(s, p, marks)
    edges, marks = edges.unionByName(more_edges), marks.unionByName(more_marks)
    n = edges.groupBy(F.col("source_policy_version_id").alias("policy_version_id")).agg(F.count(F.lit(1)).alias("n_edges"))
    return marks.join(n, "policy_version_id", "left").na.fill(0, ["n_edges"])


# --- pages, downloads, files -------------------------------------------------------------------


def page_text(spark, sf):
    t = urls.html_to_text(F.col("html"))
    p = corpus.table(spark, sf, "pages").select("page_id", t.alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("n_chars"), ids.sha256_hex(F.col("t")).alias("sha256"))


def page_links(spark, sf):
    p = pages.page_links(corpus.table(spark, sf, "pages"))
    return p.select("page_id", F.col("pos").cast("long").alias("pos"), "href", "anchor_text", "link")


def link_manifest(spark, sf):
    m = pages.link_manifest(corpus.table(spark, sf, "pages"), RULES)
    return m.select("source_url", "title", "doc_type", "external_id", "agency")


def link_expansion(spark, sf):
    """Links of all pages, then the links of those pages that the first links point to."""
    p = corpus.table(spark, sf, "pages")
    first = pages.link_manifest(p, RULES)
    home = p.withColumn("url", F.concat(F.lit("https://"), urls.url_host(F.col("url")), F.lit("/the")))
    hops = pages.expand_links(first, home, RULES, F.col("source_url").endswith("/the"))
    return hops.select("source_url", "external_id", F.col("hop").cast("long").alias("hop"))


def page_documents(spark, sf):
    d = pages.page_documents(corpus.table(spark, sf, "pages"))
    return d.select("page_id", "title", F.col("n_links").cast("long").alias("n_links"), F.length("content").cast("long").alias("n_chars"))


def _manifest_of_pages(spark, sf):
    url = urls.drop_query(F.col("url"))
    wanted = F.when(F.length("html") % 5 == 0, "pdf").otherwise("html")
    m = corpus.table(spark, sf, "pages").select(
        "page_id", url.alias("source_url"), wanted.alias("doc_type"), ids.external_id(url, F.lit("Page")).alias("external_id"), F.lit("DEMO").alias("agency"), "html"
    )
    # The first page of each address counts.
    first = m.groupBy("source_url").agg(F.min(F.struct("page_id", "doc_type", "external_id", "agency", "html")).alias("t"))
    return first.select("source_url", "t.*")


def _downloads(spark, sf):
    m = _manifest_of_pages(spark, sf)
    files = m.select("source_url", F.encode("html", "UTF-8").alias("content"), F.lit("text/plain").alias("content_type"))
    fetched = files.where(F.length("content") % 7 != 0)
    index = m.where(F.length("html") % 4 == 0).select(
        "source_url", F.sha2(F.lit("old").cast("binary"), 256).alias("current_sha256"), F.lit("old.html").alias("current_path"), F.create_map(F.lit("s0"), F.lit("p0")).alias("sha_to_path")
    )
    return downloads.classify_downloads(m.drop("html"), fetched, index, MAX_PAGE_BYTES), index


def download_status(spark, sf):
    d, _ = _downloads(spark, sf)
    return d.select("page_id", "source_url", "doc_type", "status", "skipped", "content_length", "sha256")


def download_index(spark, sf):
    d, index = _downloads(spark, sf)
    i = downloads.merge_index(index, d)
    return i.select("source_url", "current_sha256", "current_path", F.size("sha_to_path").cast("long").alias("n_paths"))


def resume_report(spark, sf):
    """Downloads against an earlier run that registered some of them."""
    d, _ = _downloads(spark, sf)
    prior = d.where(~F.col("skipped")).select(
        F.concat_ws(":", "external_id", "sha256").alias("state_key"),
        F.element_at(F.array(F.lit("registered"), F.lit("conflict"), F.lit("failed")), (F.pmod("page_id", F.lit(3)) + 1).cast("int")).alias("prior_status"),
        F.lit("b").alias("blob_path"), F.lit("v").alias("policy_version_id"),
    )
    r = downloads.resume_state(d, prior)
    return r.groupBy("resume", "detail").agg(F.count(F.lit(1)).alias("n"))


def slug_join(spark, sf):
    """Page titles as file names against page addresses with the same or a containing tail."""
    p = corpus.table(spark, sf, "pages")
    words = F.split(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "[^A-Za-z ]", ""), " +")
    tail = F.concat_ws("-", F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.col("page_id").cast("string"))
    links = p.select(F.col("page_id").alias("pos"), F.concat(F.lit("https://x.example.org/p/"), tail).alias("url"))
    name = F.when(F.pmod("page_id", F.lit(3)) == 0, tail).when(F.pmod("page_id", F.lit(3)) == 1, F.concat(F.lit("old_"), tail)).otherwise(F.get(words, F.lit(0)))
    files = p.select("page_id", F.concat(F.lit("/in/"), name, F.lit("__0a.txt")).alias("path"))
    return downloads.match_slugs(files, links).select("page_id", "file_slug", "source_url")


def url_checks(spark, sf):
    """Which addresses may be fetched: page addresses, and the same pages on literal hosts."""
    p = corpus.table(spark, sf, "pages")
    n = F.col("page_id")
    host = F.concat_ws(".", F.pmod(n * 37, F.lit(256)).cast("string"), F.pmod(n * 11, F.lit(256)).cast("string"), F.pmod(n, F.lit(256)).cast("string"), F.lit("7"))
    scheme = F.when(F.pmod(n, F.lit(9)) == 0, "ftp").otherwise("http")
    both = p.select("page_id", F.lit("page").alias("kind"), "url").unionByName(p.select("page_id", F.lit("literal").alias("kind"), F.concat(scheme, F.lit("://"), host, F.lit(":80/a?b#c")).alias("url")))
    return both.select("page_id", "kind", urls.url_host(F.col("url")).alias("host"), urls.url_rejection(F.col("url")).alias("rejection"))


def metadata_hash(spark, sf):
    e = corpus.table(spark, sf, "events")
    return e.select("event_id", ids.metadata_hash(F.col("props")).alias("sha256"))


def message_guard(spark, sf):
    """Events as queue messages: envelopes, flat payloads, wrong types and bad ids."""
    e = corpus.table(spark, sf, "events")
    vid = ids.uuid5(register.ID_SPACE, F.col("event_id").cast("string"))
    data = F.concat(F.lit('{"policy_version_id":"'), F.when(F.col("event_type") == "error", "nope").otherwise(vid), F.lit('"}'))
    kind = F.when(F.col("event_type") == "click", "policy.other").otherwise(ingest.REQUESTED)
    value = F.when(F.col("event_type") == "view", data).when(F.col("event_type") == "signup", F.lit("[1")).otherwise(
        F.concat(F.lit('{"type":"'), kind, F.lit('","data":'), data, F.lit("}"))
    )
    good, bad = ingest.parse_messages(e.select("event_id", value.alias("value")))
    both = good.select("event_id", "policy_version_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("event_id", F.lit(None).cast("string").alias("policy_version_id"), "error"))
    return both


# --- control catalog ---------------------------------------------------------------------------


def _catalog(spark, sf):
    """Each document as a control with a parameter, nested parts and an enhancement."""
    d = spread(corpus.table(spark, sf, "documents"), "doc_id")
    n = F.col("doc_id").cast("string")
    prop = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    part = lambda name, prose, *more: F.struct(F.lit(name).alias("name"), prose.alias("prose"), *more)
    item = part("item", F.concat(F.lit("item of "), "lang"), F.array(prop("label", F.lit("a."))).alias("props"))
    parts = F.array(
        F.to_json(part("statement", F.concat(F.lit("Keep {{ insert: param, p-1 }} or {{ insert: param, none }}: "), "text"), F.array(item).alias("parts"))),
        F.to_json(part("assessment-method", F.lit("not shown"))), F.to_json(part("guidance", F.concat(F.lit("Source "), "source"))),
    )
    raw = F.concat(
        F.lit('{"id":"d-'), n, F.lit('","title":"Document '), n, F.lit('","props":[{"name":"label","value":"D-'), n, F.lit('"},{"name":"status","value":"'),
        F.when(F.length("text") % 3 == 0, "withdrawn").otherwise("live"), F.lit('"}],"params":[{"id":"p-1","label":"'), F.col("lang"), F.lit('"}],"parts":['),
        F.array_join(parts, ","), F.lit('],"controls":[{"id":"d-'), n, F.lit('.1","title":"More","parts":[]}]}'),
    )
    return d.select(F.upper("source").alias("family"), F.concat(F.lit("Family "), "source").alias("family_title"), F.array("doc_id").alias("at"), raw.alias("raw"))


PROFILE = {"category": "Catalog", "authority_level": 5, "policy_type": "security_control_catalog", "effective_date": "2023-10-12", "model": corpus.MODEL}


def catalog_sections(spark, sf):
    s = catalog.flatten_catalog(_catalog(spark, sf), "tenant-0", "Catalog", PROFILE)["sections"]
    return s.select("section_id", "policy_version_id", "section_index", "section_path", "title", F.col("end_offset").cast("long").alias("end_offset"), "content_sha256")


def catalog_policies(spark, sf):
    p = catalog.flatten_catalog(_catalog(spark, sf), "tenant-0", "Catalog", PROFILE)["policies"]
    return p.select("policy_id", "external_id", "name", "current_version_id")


def nested_versions(spark, sf):
    """Each policy's newest versions as a nested array, flattened again with the parent lookup."""
    v = versions.number_versions(corpus.version_facts(spark, sf))
    nested = v.select(F.col("policy_version_id").alias("root"), "policy_id", F.struct(F.col("policy_version_id").alias("id"), "version_number", "parse_status").alias("v"))
    docs = nested.groupBy(F.col("policy_id").alias("id"), F.floor(F.col("v.version_number") / 100).alias("page")).agg(F.collect_list("v").alias("versions"))
    docs = docs.withColumn("tenant_id", F.lit("tenant-0"))
    return catalog.explode_versions(docs).select("policy_id", "policy_version_id", "version_number", "parse_status")


def sink_commits(spark, sf):
    """Sections in batches: one dies before its commit and runs again, twice; a third of the versions is replaced, some by nothing; then a new base."""
    path = run_folder(spark, "commits")
    s = corpus.raw_sections(spark, sf).select("policy_version_id", "section_id", F.length("text").cast("long").alias("n_chars"))
    s = s.withColumn("n", F.substring("policy_version_id", 2, 20).cast("long"))
    even, third = F.col("n") % 2 == 0, F.col("n") % 3 == 0
    commits.replace(s.where(even), s.where(even), path, "even")
    commits.write_batch(s.where(~even), s.where(~even), path)  # and no record
    for _ in range(2):
        commits.replace(s.where(~even), s.where(~even), path, "odd")
    longer = s.where(third & (F.col("n") % 5 != 0)).withColumn("n_chars", F.col("n_chars") * 2)
    commits.replace(longer, s.where(third), path, "again")
    before = commits.read(spark, path).count()
    commits.compact(spark, path)
    out = commits.read(spark, path).groupBy("policy_version_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum("n_chars").alias("n_chars"))
    return out.withColumn("before", F.lit(before).cast("long")).withColumn("left_over", F.lit(len(commits.obsolete(spark, path))).cast("long"))


# --- streams -----------------------------------------------------------------------------------


def stream_progress(spark, sf):
    """Item status kept by a stream over the events table, then counted per batch."""
    mapped = F.create_map(*(F.lit(x) for pair in corpus.STATUS_OF_EVENT.items() for x in pair))
    raw = progress.read_events(spark, sf)
    events = raw.select(
        F.col("user_id").alias("batch_id"), F.get_json_object("props", "$.k").cast("long").alias("item_id"), "ts", F.col("event_id").alias("seq"),
        F.element_at(mapped, F.col("event_type")).alias("status"),
    )
    home = run_folder(spark, "progress")
    keys = ["batch_id", "item_id"]
    progress.start_item_status(events, keys, f"{home}/changes", f"{home}/state").awaitTermination()
    return status.batch_progress(progress.latest_items(spark.read.parquet(f"{home}/changes"), keys))


def stream_throughput(spark, sf):
    """Daily counts by event type from a stream with a watermark."""
    raw = progress.read_events(spark, sf).withColumnRenamed("event_type", "status")
    home = run_folder(spark, "throughput")

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.withColumn("micro_batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("micro_batch").parquet(f"{home}/out")

    q = progress.throughput(raw).writeStream.outputMode("update").foreachBatch(write)
    q.option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{home}/out").groupBy("window_start", "status").agg(F.max_by("n", "micro_batch").alias("n"))
    return last.select("window_start", "status", "n")


def stream_sliding(spark, sf):
    """Counts by event type in windows of two days that begin every twelve hours, from a stream."""
    raw = progress.read_events(spark, sf).withColumnRenamed("event_type", "status")
    home = run_folder(spark, "sliding")
    progress.start_throughput(raw, f"{home}/out", f"{home}/state", "2 days", "12 hours").awaitTermination()
    return progress.latest_windows(spark.read.parquet(f"{home}/out"))


def stream_batch_status(spark, sf):
    """Final batch status kept by a stream whose files bring the events in shuffled order."""
    home = run_folder(spark, "batches")
    events = corpus.status_events(spark, sf)
    events.repartition(8, F.xxhash64("seq")).write.parquet(f"{home}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(f"{home}/events")
    keyed.start_batch_status(stream, f"{home}/out", f"{home}/state", delay="60 days").awaitTermination()
    return keyed.latest_batches(spark.read.parquet(f"{home}/out")).select("batch_id", "batch_status", F.col("active").cast("long").alias("active"))


def stream_sessions(spark, sf):
    """Sessions of each user and the rows that came too late: events in two stretches of time, then every 97th of them."""
    home = run_folder(spark, "sessions")
    events = corpus.table(spark, sf, "events").select("user_id", "ts", F.col("event_id").alias("seq"))
    held = F.col("seq") % 97 == 0
    middle = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    for part in (~held & middle, ~held & ~middle, held):
        events.where(part).repartition(4, "user_id").write.mode("append").parquet(f"{home}/events")
        stream = spark.readStream.schema(events.schema).parquet(f"{home}/events")
        keyed.start_sessions(stream, "user_id", f"{home}/out", f"{home}/state", gap="6 hours", delay="3 days").awaitTermination()
    rows = spark.read.parquet(f"{home}/out")
    found = keyed.sessions(rows, "user_id").withColumn("kind", F.lit("session"))
    late = keyed.late_rows(rows, "user_id").select("user_id", F.col("ts").alias("session_start"), F.col("ts").alias("session_end"), F.lit(1).cast("long").alias("n"), F.lit("late").alias("kind"))
    return found.union(late)


def stream_ingest(spark, sf):
    """All documents requested as messages (twice), processed by the stream, counted per version."""
    home = run_folder(spark, "ingest")
    d = corpus.table(spark, sf, "documents")
    vid = ids.uuid5(register.ID_SPACE, F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    p = corpus.policies(spark, sf)
    v = d.select(vid.alias("policy_version_id"), F.col("source").alias("policy_id"), F.lit("pending").alias("parse_status")).join(p.select("policy_id", "tenant_id"), "policy_id")
    t = d.select(vid.alias("policy_version_id"), F.col("text"), F.lit(None).cast("string").alias("error"))
    message = F.concat(F.lit('{"type":"policy.process.requested","data":{"policy_version_id":"'), vid, F.lit('"},"created_at":"2024-01-01T00:00:00Z"}'))
    d.select(message.alias("value")).union(d.select(message.alias("value"))).write.text(f"{home}/messages")
    ingest_stream.start_ingest_stream(spark, f"{home}/messages", v, t, p, f"{home}/out", f"{home}/state", max_files=1000).awaitTermination()
    s = commits.read(spark, f"{home}/out/sections")
    return s.groupBy("policy_version_id").agg(F.count(F.lit(1)).alias("n_sections"), F.max("end_offset").cast("long").alias("n_chars"))


def _redelivered(spark, sf) -> str:
    """All documents requested in shuffled order over many files, a third of them again after they were ready: the folder of the run."""
    home = run_folder(spark, "redelivery")
    d = corpus.table(spark, sf, "documents")
    vid = ids.uuid5(register.ID_SPACE, F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
    p = corpus.policies(spark, sf)
    v = d.select(vid.alias("policy_version_id"), F.col("source").alias("policy_id"), F.lit("pending").alias("parse_status")).join(p.select("policy_id", "tenant_id"), "policy_id")
    t = d.select(vid.alias("policy_version_id"), F.col("text"), F.lit(None).cast("string").alias("error"))

    def send(rows: DataFrame, day: str) -> None:
        second = F.pmod(F.col("doc_id") * 7919, F.lit(100_003)).cast("int")
        created = F.date_format(F.timestamp_add("SECOND", second, F.lit(day).cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss")
        # Upper-case ids, as some senders write them.
        message = F.concat(F.lit('{"type":"policy.process.requested","data":{"policy_version_id":"'), F.upper(vid), F.lit('"},"created_at":"'), created, F.lit('Z"}'))
        rows.select(message.alias("value"), F.xxhash64("doc_id").alias("h")).repartition(6, "h").select("value").write.mode("append").text(f"{home}/messages")
        ingest_stream.start_ingest_stream(spark, f"{home}/messages", v, t, p, f"{home}/out", f"{home}/state", max_files=3).awaitTermination()

    send(d, "2024-01-01")
    send(d.where(F.col("doc_id") % 3 == 0), "2024-02-01")
    return home


def stream_counts(spark, sf):
    """What the ingest stream counted while it ran."""
    counts = spark.read.parquet(f"{_redelivered(spark, sf)}/out/counts")
    return counts.agg(*(F.sum(c).alias(c) for c in ("scanned", "skipped", "inserted", "sections", "failed")))


def stream_redelivery(spark, sf):
    """The state after requests came again."""
    home = _redelivered(spark, sf)
    s = commits.read(spark, f"{home}/out/sections")
    s = s.groupBy("policy_version_id").agg(F.count(F.lit(1)).alias("n_sections"), F.max("end_offset").cast("long").alias("n_chars"))
    done = commits.read(spark, f"{home}/out/status").select("policy_version_id", "parse_status")
    current = ingest_stream.current_pointers(spark, f"{home}/out").select(F.col("current_version_id").alias("policy_version_id"), F.lit(True).alias("is_current"))
    out = done.join(s, "policy_version_id", "left").join(current, "policy_version_id", "left")
    return out.select("policy_version_id", F.coalesce("n_sections", F.lit(0).cast("long")).alias("n_sections"), "n_chars", "parse_status", F.coalesce("is_current", F.lit(False)).alias("is_current"))


def _processed(spark, sf):
    """All versions processed in bulk; texts of failed versions could not be read."""
    f = corpus.version_facts(spark, sf)
    order = F.timestamp_add("SECOND", F.pmod(F.col("doc_id") * 7919, F.lit(100_003)).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    p = corpus.policies(spark, sf)
    v = f.select("policy_id", "policy_version_id", F.lit("pending").alias("parse_status"), order.alias("requested_at")).join(p.select("policy_id", "tenant_id"), "policy_id")
    d = corpus.table(spark, sf, "documents").select(corpus.version_id(F.col("doc_id")).alias("policy_version_id"), "text")
    broken = f.where(F.col("parse_status") == "failed").select("policy_version_id", F.lit("unreadable").alias("error"))
    return ingest.process_versions(v, d.join(broken, "policy_version_id", "left"), p)


def process_current(spark, sf):
    """Current version per policy after a bulk run: the last requested one that became ready."""
    return _processed(spark, sf)["current"].select("policy_id", "current_version_id")


def process_items(spark, sf):
    """Items of each batch after the run, from the versions they led to."""
    f = corpus.version_facts(spark, sf)
    items = f.select(F.col("policy_id").alias("batch_id"), F.col("doc_id").alias("item_id"), "policy_version_id", F.lit("processing").alias("status"))
    r = status.item_results(items, _processed(spark, sf)["status"])
    return r.groupBy("batch_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))


def registration_rejects(spark, sf):
    """Registrations with broken values: each is rejected with its reason, none ends the run."""
    rows = corpus.incoming(spark, sf)
    kind = F.pmod("arrival_seq", F.lit(6))
    rows = rows.withColumns({
        "metadata_json": F.when(kind == 0, '{"a":').when(kind == 1, "[1]").otherwise(F.col("metadata_json")),
        "policy_name": F.when(kind == 2, F.lit("x" * 513)).otherwise(F.col("policy_name")),
        "authority_level": F.when(kind == 3, -1).otherwise(1),
        "extracted_text": F.when(kind == 4, " \n").otherwise("text"),
    })
    r = register.register(rows, corpus.no_policies(spark), corpus.no_versions(spark)).rejects
    return r.where(F.col("reason") == "invalid").select("arrival_seq", F.col("error").alias("reason"))


def file_plan(spark, sf):
    """Documents as text files of a local folder: the registration plan per file."""
    d = corpus.table(spark, sf, "documents")
    path = F.concat(F.lit("/in/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("-2024-01-05.txt"))
    files = d.select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))
    p = downloads.plan_files(files, "/in", "docs", "DEMO", "S1", {"policy_type": "external_policy"})
    return p.select("source_file", "policy_external_id", "policy_name", "effective_date", "content_type", "file_sha256", "version_label", "blob_path")


def request_fields(spark, sf):
    """Conversation turns as request payloads in both spellings, read back to fields."""
    c = corpus.table(spark, sf, "conversations")
    camel = F.to_json(F.struct(corpus.tenant_of(F.col("conv_id")).alias("tenantId"), F.col("text").alias("question"), F.struct(F.lit(False).alias("onlyCurrent")).alias("scope")))
    snake = F.to_json(F.struct(F.col("text").alias("query"), F.struct(F.col("role").alias("department")).alias("user")))
    r = c.select("conv_id", "turn", audit.normalize_request(F.when(F.pmod("turn", F.lit(2)) == 0, camel).otherwise(snake)).alias("r"))
    return r.select("conv_id", "turn", "r.tenant_id", "r.question", "r.department", "r.only_current")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        version_lineage, current_versions, policy_catalog, duplicate_rejects, label_conflicts, registered_versions, registered_items, policy_first_write,
        section_chunks, section_page, section_detail, clean_lines, extracted_documents, item_status, batch_progress, batch_status, status_report,
        tenant_counts, embed_backlog, embedding_text, embed_backfill, backfill_counts, vector_topk, vector_topk_unscoped, id_boost, answers_by_id, vector_literals, fts_rank, postings, hybrid_fusion,
        dept_ranked, secondary_all, secondary_evidence, prompts, answer_card, evidence_packet, model_answers, audit_append, audit_replay, eval_report,
        eval_outcomes, refs_extracted, refs_resolved, refs_inbound, name_similarity, reference_backfill, page_text, page_links, link_manifest,
        link_expansion, page_documents, download_status, download_index, resume_report, slug_join, url_checks, metadata_hash, message_guard,
        catalog_sections, catalog_policies, nested_versions, sink_commits, stream_progress, stream_throughput, stream_sliding,
        stream_batch_status, stream_sessions, stream_ingest, stream_redelivery, stream_counts, process_current, process_items, registration_rejects,
        file_plan, request_fields,
    )
}
QUERIES["answers"] = answers_query

"""Questions x corpus: retrieve, fuse, rank, answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.text import blank
from lexgrove.operators.answers import MIN_SCORE, SECONDARY_RATIO, answer
from lexgrove.operators.fulltext import fts_topk, of_versions
from lexgrove.operators.fusion import HybridConfig, fuse, merge_sources
from lexgrove.operators.ranking import assign_buckets, rank_evidence
from lexgrove.operators.vectors import BLOCK_QUESTIONS, FOUND, boost_exact, vector_topk
from lexgrove.scale import fits
from lexgrove.session import cut_lineage

# Most candidates per question that the document store returns.
STORE_TOP_K = 40
# Candidate ids that may be sent to the corpus scan.
SENT_ROWS = 400_000
FACTS = [
    "section_id", "policy_name", "title", "section_path", "section_index", "public_url", "text", "department_scope",
    "authority_level", "effective_date", "is_current", "policy_type",
]


def hydrate(found: DataFrame, sections: DataFrame, bounded: bool) -> DataFrame:
    """Section columns for found candidates.

    A bounded question set has at most ``SENT_ROWS`` candidates (questions x 2 x per-source), so those few ids are
    sent to the corpus scan; otherwise both sides are shuffled.
    """
    ids = found.select("question_id", "section_id")
    ids = F.broadcast(ids) if bounded else ids
    return of_versions(sections, found, bounded).select(*FACTS).join(ids, "section_id")


def retrieve(
    questions: DataFrame, sections: DataFrame, vectors: DataFrame | None, mode: str = "hybrid",
    cfg: HybridConfig = HybridConfig(), postings: DataFrame | None = None,
) -> DataFrame:
    """Candidates per question in rank order. Without vectors the hybrid mode degrades to full text.

    ``sections``: ready corpus with text and scope columns; ``vectors``: ready embedding rows. Mode ``store`` is the
    document store: similarity within the tenant alone, without currency or policy scope, candidates without a text
    left out, and sections whose identifier the question names raised. Without vectors it finds nothing.
    """
    if mode == "hybrid" and vectors is None:
        mode = "fts"
    k = cfg.per_source if mode == "hybrid" else min(cfg.top_k, STORE_TOP_K) if mode == "store" else cfg.top_k
    bounded = fits(questions, min(BLOCK_QUESTIONS, SENT_ROWS // (2 * max(1, k))))
    vec = vector_topk(questions, vectors, k, scoped=mode != "store") if mode in ("hybrid", "vector") or mode == "store" and vectors is not None else None
    fts = fts_topk(questions, sections, k, postings) if mode in ("hybrid", "fts") else None
    if mode == "hybrid":
        # From here on a few rows per question: keep them instead of replaying the searches.
        merged = cut_lineage(merge_sources(vec, fts, cfg))
        found = fuse(merged, hydrate(merged, sections, bounded), cfg)
    else:
        one = vec if vec is not None else fts if fts is not None else questions.sparkSession.createDataFrame([], f"{FOUND}, rank int")
        found = one.withColumn("source", F.lit(mode)).join(hydrate(one, sections, bounded), ["question_id", "section_id"])
    if mode == "store":
        found = found.where(~blank(F.col("text"))).join(questions.select("question_id", "question"), "question_id")
        found = boost_exact(found).drop("question")
    asked = questions.select("question_id", "department", F.col("department").alias("user_department"))
    return cut_lineage(found.join(asked, "question_id"))


def ask(
    questions: DataFrame, sections: DataFrame, vectors: DataFrame | None, mode: str = "hybrid", cfg: HybridConfig = HybridConfig(),
    min_score: float = MIN_SCORE, secondary_ratio: float = SECONDARY_RATIO, secondary_mode: str = "first_bucket",
    supplied: str | None = None, postings: DataFrame | None = None,
) -> DataFrame:
    """One answer per question; blank questions are refused without a search."""
    found = retrieve(questions.where(~blank(F.col("question"))), sections, vectors, mode, cfg, postings)
    ranked = rank_evidence(assign_buckets(found), secondary_mode)
    keep = [c for c in questions.columns if c != "vector"]
    return answer(questions.select(*keep), ranked, min_score, secondary_ratio, supplied)

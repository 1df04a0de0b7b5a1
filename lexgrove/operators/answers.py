"""Answers with citations, refusals, secondary evidence, decision and retrieval log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.text import excerpt, snippet

# Fixed values of the answer contract.
REFUSAL_PHRASE = "Insufficient evidence in available policy sections."
REFUSAL_REASON = "insufficient_evidence"
MIN_SCORE = 0.5
SECONDARY_RATIO = 0.8
MAX_SECONDARY = 3
MAX_CITATIONS = 3
MAX_ITEMS = 5

EVIDENCE = [
    "source", "policy_id", "policy_version_id", "section_id", "score", "department_scope", "authority_level",
    "effective_date", "is_current", "policy_name", "title", "section_path", "public_url", "text",
]


def citation(version: Column, section: Column) -> Column:
    return F.concat(F.lit("[policy_version_id="), version, F.lit(" section_id="), section, F.lit("]"))


def has_citation(answer: Column) -> Column:
    return F.coalesce(answer.contains("[policy_version_id="), F.lit(False))


def _pool(primary: bool) -> Column:
    """Ranked evidence of one pool as an ordered array; at most top-k rows per question."""
    row = F.struct("evidence_rank", "scope_dept", *EVIDENCE)
    kept = F.collect_list(F.when(F.col("is_primary") if primary else ~F.col("is_primary"), row))
    return F.array_sort(kept)


def prompt_text(question: Column, evidence: Column) -> Column:
    """Numbered evidence lines for an external model."""
    lines = F.transform(
        F.slice(evidence, 1, MAX_ITEMS),
        lambda e, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] "), citation(e["policy_version_id"], e["section_id"]),
            F.lit(" "), excerpt(e["text"]),
        ),
    )
    return F.concat(
        F.lit("Question: "), question, F.lit("\n\nEvidence:\n"),
        F.array_join(F.concat(lines, F.array(F.lit(""))), "\n"),
        F.lit("\nAnswer (cite using the format [policy_version_id=... section_id=...]):"),
    )


def answer(
    questions: DataFrame,
    ranked: DataFrame,
    min_score: float = MIN_SCORE,
    secondary_ratio: float = SECONDARY_RATIO,
    supplied: str | None = None,
) -> DataFrame:
    """One answer row per question from ranked evidence (see ``ranking.rank_evidence``).

    ``supplied`` names a question column with an external model's answer, if there is one.
    """
    once = [
        "user_dept", "selected_bucket", "bucket_reason", "primary_candidates", "secondary_candidates",
        "vector_candidates", "fts_candidates", "merged_candidates", "filtered_candidates",
    ]
    have = ranked.columns
    pools = ranked.groupBy("question_id").agg(
        _pool(True).alias("evidence"),
        _pool(False).alias("secondary"),
        *(F.first(c).alias(c) if c in have else F.first(F.lit(None).cast("long")).alias(c) for c in once),
    )
    a = questions.join(pools, "question_id", "left")
    a = a.withColumn("evidence", F.coalesce("evidence", F.slice(F.array(F.lit(None).cast(_type(pools, "evidence"))), 1, 0)))
    best = F.get("evidence", F.lit(0))
    a = a.withColumn("top_score", F.coalesce(best["score"], F.lit(0.0)))
    no_rows, weak = F.size("evidence") == 0, F.col("top_score") < min_score
    model = F.col(supplied) if supplied else F.lit(None).cast("string")
    declined = F.coalesce(F.lower(model).contains(REFUSAL_PHRASE.lower()), F.lit(False))
    a = a.withColumn("outcome", F.when(no_rows | weak, "refused").when(declined, "declined").otherwise("answered"))
    answered = F.col("outcome") == "answered"
    own = F.concat(excerpt(best["text"]), F.lit(" "), citation(best["policy_version_id"], best["section_id"]))
    none = lambda c: F.slice(c, 1, 0)
    strings = F.transform("evidence", lambda e: citation(e["policy_version_id"], e["section_id"]))
    items = F.transform(
        F.slice("evidence", 1, MAX_ITEMS),
        lambda e: F.struct(
            e["policy_id"].alias("policy_id"), e["policy_version_id"].alias("policy_version_id"),
            e["section_id"].alias("section_id"), e["policy_name"].alias("policy_name"),
            e["title"].alias("section_title"), e["section_path"].alias("section_path"),
            snippet(e["text"]).alias("snippet"), e["score"].alias("score"), e["public_url"].alias("public_url"),
        ),
    )
    n = F.size("evidence").cast("long")
    logged = lambda c: F.coalesce(F.nullif(F.col(c).cast("long"), F.lit(0).cast("long")), n)
    others = F.filter(
        F.coalesce("secondary", none(F.col("evidence"))),
        lambda e: (e["scope_dept"] != best["scope_dept"]) & (e["score"] >= F.col("top_score") * secondary_ratio),
    )
    second = F.transform(
        F.slice(others, 1, MAX_SECONDARY),
        lambda e: F.struct(
            e["policy_version_id"].alias("policy_version_id"), e["section_id"].alias("section_id"),
            e["policy_name"].alias("policy_name"), e["title"].alias("section_title"), e["score"].alias("score"),
            e["department_scope"].alias("department_scope"), e["public_url"].alias("public_url"),
        ),
    )
    bucket = F.coalesce("selected_bucket", F.lit("other"))
    return a.select(
        *questions.columns,
        F.when(F.col("outcome") == "refused", REFUSAL_PHRASE).when(model.isNotNull() & (model != ""), model).otherwise(own).alias("answer"),
        F.when(~answered, REFUSAL_REASON).alias("refusal_reason"),
        F.when(F.col("outcome") == "refused", 0.0).otherwise(F.col("top_score")).alias("confidence"),
        "evidence",
        F.when(answered, F.slice(strings, 1, MAX_CITATIONS)).otherwise(none(strings)).alias("citations"),
        F.when(answered, items).otherwise(none(items)).alias("citation_items"),
        F.when(answered, second).otherwise(none(second)).alias("secondary_evidence"),
        F.when(
            answered,
            F.struct(
                bucket.alias("selected_bucket"), F.col("bucket_reason").alias("reason"), F.col("user_dept").alias("user_department"),
                F.col("primary_candidates"), F.col("secondary_candidates"),
            ),
        ).alias("decision"),
        F.struct(
            F.coalesce(F.col("fts_candidates").cast("long"), F.lit(0).cast("long")).alias("fts_candidates"),
            F.coalesce(F.col("vector_candidates").cast("long"), F.lit(0).cast("long")).alias("vector_candidates"),
            logged("merged_candidates").alias("merged"), logged("filtered_candidates").alias("filtered"),
            bucket.alias("selected_bucket"), F.col("top_score").alias("primary_score"),
        ).alias("retrieval_log"),
    )


def _type(df: DataFrame, column: str):
    return df.schema[column].dataType.elementType


def prompts(answers: DataFrame) -> DataFrame:
    """Input table for an external model: answered questions with their evidence text."""
    return answers.where(F.col("refusal_reason").isNull()).select(
        "question_id", prompt_text(F.col("question"), F.col("evidence")).alias("prompt")
    )


def evidence_packet(answers: DataFrame) -> DataFrame:
    """Evidence rows of each answer as one JSON document."""
    return answers.select("question_id", F.to_json(F.struct("evidence")).alias("packet"))


def answer_card(answers: DataFrame) -> DataFrame:
    """Top authority, bucket label and the single best evidence row per answer."""
    levels = F.transform("evidence", lambda e: F.coalesce(e["authority_level"], F.lit(0)))
    top = F.coalesce(F.array_max(levels), F.lit(0))
    own = F.exists("evidence", lambda e: F.coalesce(e["department_scope"] == F.col("department"), F.lit(False)))
    best = F.array_max(F.transform("evidence", lambda e: F.struct(e["score"].alias("score"), (-e["evidence_rank"]).alias("r"), e["section_id"].alias("section_id"))))
    return answers.select(
        "question_id",
        F.when(top > 0, F.concat(F.lit("A"), top.cast("string"))).otherwise("N/A").alias("top_authority"),
        F.when(own, "Dept-specific").otherwise("Org-wide").alias("bucket_label"),
        best["section_id"].alias("best_section_id"),
    )



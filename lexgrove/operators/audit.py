"""Audit rows of answered questions, lookups and replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.ids import sha256_hex
from lexgrove.operators.versions import for_tenant
from lexgrove.sources.sinks import append_new

REQUEST = ["question_id", "tenant_id", "question", "department", "only_current", "policy_ids", "policy_types"]
REQUEST_SCHEMA = (
    "question_id string, tenant_id string, question string, department string, only_current boolean, "
    "policy_ids array<string>, policy_types array<string>"
)
RESPONSE = ["answer", "refusal_reason", "confidence", "citations", "citation_items", "secondary_evidence", "decision", "retrieval_log", "evidence"]


def audit_rows(answers: DataFrame, run_id: str, created_at: Column | None = None) -> DataFrame:
    """One append-only row per answer; the id depends on run and request, so a retry repeats it."""
    request = F.to_json(F.struct(*(c for c in REQUEST if c in answers.columns)))
    payload = F.concat(
        F.lit('{"request":'), request, F.lit(',"response":'),
        F.to_json(F.struct(*(c for c in RESPONSE if c in answers.columns))), F.lit("}"),
    )
    return answers.select(
        sha256_hex(F.concat_ws("|", F.lit(run_id), request)).alias("audit_id"),
        "tenant_id",
        F.lit("ask").alias("event_type"),
        (F.col("correlation_id") if "correlation_id" in answers.columns else F.lit(None).cast("string")).alias("correlation_id"),
        payload.alias("payload"),
        (created_at if created_at is not None else F.current_timestamp()).alias("created_at"),
    )


def append_audit(audit: DataFrame, path: str) -> DataFrame:
    """Append the rows whose id is not stored yet, so that a retry adds nothing; returns what was added."""
    return append_new(audit, path, ["audit_id"])


def get_audit(audit: DataFrame, tenant_id: str, audit_id: str) -> DataFrame:
    """The row of one tenant; another tenant's row looks the same as a missing one."""
    row = for_tenant(audit, tenant_id).where(F.col("audit_id") == audit_id)
    return row.select(
        "*", F.get_json_object("payload", "$.request").alias("request"), F.get_json_object("payload", "$.response").alias("response")
    )


def list_audit(audit: DataFrame, tenant_id: str, limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    mine = for_tenant(audit, tenant_id)
    return mine.orderBy(F.col("created_at").desc(), "audit_id").offset(max(0, offset)).limit(max(1, min(limit, most)))


def requests_of(audit: DataFrame) -> DataFrame:
    """Questions read back from the payload; rows without an ask request are left out."""
    request = F.from_json(F.get_json_object("payload", "$.request"), REQUEST_SCHEMA)
    return audit.withColumn("r", request).where(F.col("r.question").isNotNull()).select("audit_id", "r.*")


def replay(audit: DataFrame, ask: Callable[[DataFrame], DataFrame], run_id: str) -> DataFrame:
    """Ask the recorded questions again; returns the new audit rows."""
    return audit_rows(ask(requests_of(audit).drop("audit_id")), run_id)


def replay_diff(audit: DataFrame, again: DataFrame) -> DataFrame:
    """Old and new answer side by side per question."""

    def side(df: DataFrame, name: str) -> DataFrame:
        get = lambda p: F.get_json_object("payload", p)
        return df.select(
            get("$.request.question_id").alias("question_id"), get("$.response.answer").alias(f"{name}_answer"),
            get("$.response.confidence").cast("double").alias(f"{name}_confidence"),
        )

    both = side(audit, "old").join(side(again, "new"), "question_id", "full_outer")
    return both.withColumn("same", F.col("old_answer").eqNullSafe(F.col("new_answer")))


def normalize_request(payload: Column, default_tenant: str = "local") -> Column:
    """Request fields from snake-case or camel-case payloads."""

    def pick(*names: str) -> Column:
        return F.coalesce(*(F.get_json_object(payload, f"$.{n}") for n in names))

    return F.struct(
        F.coalesce(pick("tenant_id", "tenantId"), F.lit(default_tenant)).alias("tenant_id"),
        pick("question", "query").alias("question"),
        pick("mode").alias("mode"),
        pick("user.department", "department").alias("department"),
        F.coalesce(pick("scope.only_current", "scope.onlyCurrent", "onlyCurrent").cast("boolean"), F.lit(True)).alias("only_current"),
    )


def tenant_override(questions: DataFrame) -> DataFrame:
    """The request tenant wins over a differing user tenant."""
    return questions.withColumn("user_tenant_id", F.col("tenant_id"))

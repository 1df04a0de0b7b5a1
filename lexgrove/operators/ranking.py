"""Department buckets and evidence order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions.ids import department
from lexgrove.functions.text import non_blank

CURRENCY_DISCOUNT = 0.70
# Bucket names and the reasons recorded with them.
BUCKETS = ["department_specific", "org_wide", "other"]
REASONS = [
    "department bucket had direct matches",
    "no department matches; fell back to org-wide bucket",
    "no department or org-wide matches; using cross-department evidence",
]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index)


def evidence_order(discount: float = CURRENCY_DISCOUNT) -> list[Column]:
    """All keys descending; a section that is not current counts for less."""
    score = F.coalesce(F.col("score"), F.lit(0.0))
    day = F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.col("effective_date").cast("string"))), F.lit(0))
    return [
        F.when(F.col("is_current"), score).otherwise(score * discount).desc(),
        score.desc(),
        F.coalesce(F.col("authority_level"), F.lit(0)).desc(),
        day.desc(),
        F.coalesce(F.col("policy_version_id"), F.lit("")).desc(),
        F.coalesce(F.col("section_id"), F.lit("")).desc(),
    ]


def assign_buckets(candidates: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Add user_dept, bucket (1 own department, 2 org-wide, 3 other), primary bucket and pool sizes.

    The user's department is the one asked with, else the first one found on the candidates.
    """
    per_question = Window.partitionBy("question_id")
    order = order or [F.col("rank")]
    carried = F.lower(non_blank(F.col("user_department")))
    c = candidates.withColumn(
        "user_dept",
        F.first(carried, ignorenulls=True).over(
            per_question.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ),
    )
    if "department" in c.columns:
        c = c.withColumn("user_dept", F.coalesce(F.lower(non_blank(F.col("department"))), "user_dept"))
    scope = department(F.col("department_scope"))
    own = F.coalesce(scope == F.col("user_dept"), F.lit(False))
    c = c.withColumn("scope_dept", scope)
    c = c.withColumn("bucket", F.when(own, 1).when(scope == "all", 2).otherwise(3))
    c = c.withColumn("primary_bucket", F.min("bucket").over(per_question))
    # Without own-department rows the secondary pool is what lies behind the primary bucket.
    c = c.withColumn("is_primary", F.col("bucket") == F.col("primary_bucket"))
    return (
        c.withColumn("primary_candidates", F.count_if("is_primary").over(per_question))
        .withColumn("secondary_candidates", F.count_if(~F.col("is_primary")).over(per_question))
        .withColumn("selected_bucket", _pick(BUCKETS, F.col("primary_bucket")))
        .withColumn("bucket_reason", _pick(REASONS, F.col("primary_bucket")))
    )


def rank_evidence(bucketed: DataFrame, secondary_mode: str = "first_bucket", discount: float = CURRENCY_DISCOUNT) -> DataFrame:
    """Number primary and secondary evidence per question.

    ``first_bucket`` keeps only the first non-empty bucket of the secondary pool; ``all`` keeps
    org-wide and cross-department rows together.
    """
    pool = Window.partitionBy("question_id", "is_primary")
    c = bucketed.withColumn("_first", F.min("bucket").over(pool))
    if secondary_mode == "first_bucket":
        c = c.where(F.col("bucket") == F.col("_first"))
    ordered = pool.orderBy(*evidence_order(discount))
    return c.drop("_first").withColumn("evidence_rank", F.row_number().over(ordered))


def rank_candidates(candidates: DataFrame, discount: float = CURRENCY_DISCOUNT) -> DataFrame:
    """First non-empty bucket only, in evidence order."""
    return rank_evidence(assign_buckets(candidates), discount=discount).where("is_primary")

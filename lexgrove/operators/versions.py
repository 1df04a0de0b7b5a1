"""Version numbering, lineage, current version, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.ids import public_url
from lexgrove.scale import bucketed_scan

# Versions of one policy are numbered in slices of this many arrivals, so a policy that holds a
# third of all documents is still spread over many tasks.
ARRIVALS_PER_SLICE = 200_000


def number_versions(
    versions: DataFrame,
    existing: DataFrame | None = None,
    order: str = "arrival_seq",
    slice_rows: int = ARRIVALS_PER_SLICE,
) -> DataFrame:
    """Add ``version_number`` and ``supersedes_policy_version_id``.

    ``existing`` (policy_id, version_number, policy_version_id) continues earlier numbering.
    """
    out = bucketed_scan(
        versions,
        ["policy_id"],
        [F.col(order), F.col("policy_version_id")],
        F.floor(F.col(order) / slice_rows),
        number="version_number",
        previous=(F.col("policy_version_id"), "supersedes_policy_version_id"),
    )
    if existing is None:
        return out
    last = latest_versions(existing).select(
        "policy_id", F.col("version_number").alias("_last"), F.col("policy_version_id").alias("_last_id")
    )
    return (
        out.join(last, "policy_id", "left")
        .withColumn("version_number", F.col("version_number") + F.coalesce("_last", F.lit(0)))
        .withColumn("supersedes_policy_version_id", F.coalesce("supersedes_policy_version_id", "_last_id"))
        .drop("_last", "_last_id")
    )


def latest_versions(versions: DataFrame) -> DataFrame:
    """Highest version number and its id, one row per policy."""
    top = F.max(F.struct("version_number", "policy_version_id"))
    return versions.groupBy("policy_id").agg(top.alias("t")).select("policy_id", "t.*")


def current_versions(versions: DataFrame, current_by: str = "ready_at") -> DataFrame:
    """The one current version per policy: the last to reach ready, or the highest number."""
    top = F.max(F.struct(F.col(current_by), F.col("policy_version_id"))).alias("t")
    return (
        versions.where(F.col("parse_status") == "ready")
        .groupBy("policy_id")
        .agg(top)
        .select("policy_id", F.col("t.policy_version_id").alias("current_version_id"))
    )


def mark_current(versions: DataFrame, current: DataFrame) -> DataFrame:
    """Set ``is_current`` on every version from the policy pointers."""
    ids = current.select(F.col("current_version_id").alias("policy_version_id"), F.lit(True).alias("_cur"))
    return (
        versions.drop("is_current")
        .join(ids, "policy_version_id", "left")
        .withColumn("is_current", F.coalesce("_cur", F.lit(False)))
        .drop("_cur")
    )


def set_policy_pointer(policies: DataFrame, current: DataFrame) -> DataFrame:
    return policies.drop("current_version_id").join(current, "policy_id", "left")


def set_extracted_artifact(versions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Fill the three artifact columns where an artifact was written."""
    cols = ["extracted_blob_container", "extracted_blob_name", "extracted_blob_uri"]
    new = artifacts.select("policy_version_id", *(F.col(c).alias(f"_{c}") for c in cols))
    out = versions.join(new, "policy_version_id", "left")
    for c in cols:
        old = F.col(c) if c in versions.columns else F.lit(None).cast("string")
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), old))
    return out.drop(*(f"_{c}" for c in cols))


def partial_update(policies: DataFrame, updates: DataFrame, fields: Sequence[str], key: str = "policy_id") -> DataFrame:
    """Overwrite only supplied fields; ``supplied`` is an array of field names, so null can be set."""
    new = updates.select(key, "supplied", *(F.col(f).alias(f"_{f}") for f in fields))
    out = policies.join(new, key, "left")
    for f in fields:
        given = F.coalesce(F.array_contains("supplied", f), F.lit(False))
        out = out.withColumn(f, F.when(given, F.col(f"_{f}")).otherwise(F.col(f)))
    return out.select(*policies.columns)


def add_missing(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` whose key is not there yet (tenant get-or-create)."""
    return wanted.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def for_tenant(df: DataFrame, tenant_id: str) -> DataFrame:
    return df.where(F.col("tenant_id") == tenant_id)


def list_policies(policies: DataFrame, tenant_id: str) -> DataFrame:
    return for_tenant(policies, tenant_id).orderBy(F.col("created_at").desc(), "policy_id")


def list_versions(versions: DataFrame, tenant_id: str, policy_id: str) -> DataFrame:
    mine = for_tenant(versions, tenant_id).where(F.col("policy_id") == policy_id)
    return mine.orderBy(F.col("version_number").desc())


def page(df: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    """One page of a listing; the limit is held within 1..``most``."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def list_sections(sections: DataFrame, tenant_id: str, version_id: str, limit: int = 50, offset: int = 0) -> DataFrame:
    mine = for_tenant(sections, tenant_id).where(F.col("policy_version_id") == version_id)
    return page(mine, [F.col("section_index")], limit, offset)


def section_detail(sections: DataFrame, versions: DataFrame, policies: DataFrame) -> DataFrame:
    """Section with the version and policy columns shown next to it."""
    v = versions.select(
        "policy_version_id", "policy_id", "version_number", "version_label", "effective_date", "parse_status",
        "is_current", public_url(F.col("metadata_json")).alias("public_url"),
    )
    p = policies.select(
        "policy_id", F.col("name").alias("policy_name"), "department_scope", "authority_level", "policy_type"
    )
    return sections.drop("policy_id").join(v, "policy_version_id").join(p, "policy_id")


def existing_only(ids: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``ids`` that exist in ``table``."""
    return ids.join(table.select(*keys), list(keys), "left_semi")

"""Bulk registration of incoming documents, with the outcome of one-by-one arrival order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.ids import metadata_hash, sha256_hex, source_url, uuid5
from lexgrove.functions.text import blank
from lexgrove.operators.versions import ARRIVALS_PER_SLICE, number_versions
from lexgrove.scale import HOT_ROWS, salted_lookup
from lexgrove.session import cut_lineage

ID_SPACE = "6f1c3c0e-58a3-5b0d-9c43-0f6a3f1d2b7e"
CONTENT_KEY = ["policy_id", "content_sha256", "metadata_sha256"]
LABEL_KEY = ["policy_id", "version_label"]
# Rows of one policy that are settled in one task, of some 200 bytes each.
FOLD_ROWS = 500_000


@dataclass(frozen=True)
class RegisterResult:
    policies: DataFrame
    versions: DataFrame
    items: DataFrame
    rejects: DataFrame


def validation_error(c: dict[str, Column]) -> Column:
    """First broken length or presence rule; null when the row may be registered."""
    too_long = [
        ("policy_external_id", 128), ("policy_name", 512), ("version_label", 128), ("blob_path", 1024), ("title", 512), ("jurisdiction", 128), ("category", 256),
    ]
    error = F.when(blank(c["policy_external_id"]), "policy_external_id must be non-empty")
    error = error.when(blank(c["policy_name"]), "policy_name must be non-empty")
    for name, size in too_long:
        if name in c:
            error = error.when(F.length(c[name]) > size, f"{name} longer than {size}")
    if "content_sha256" in c:
        error = error.when(F.length(c["content_sha256"]) != 64, "content_sha256 must have 64 characters")
    if "authority_level" in c:
        error = error.when(c["authority_level"] < 0, "authority_level must not be negative")
    if "extracted_text" in c:
        error = error.when(blank(c["extracted_text"]), "document has no readable text")
    return error


def prepare(incoming: DataFrame) -> DataFrame:
    """Ids and hashes per incoming row; columns beyond the keys stay behind for later joins."""
    cols = {name: F.col(name) for name in incoming.columns}
    content = cols["content_sha256"] if "content_sha256" in cols else sha256_hex(F.col("content"))
    meta = cols["metadata_sha256"] if "metadata_sha256" in cols else metadata_hash(F.col("metadata_json"))
    policy = uuid5(ID_SPACE, F.concat_ws("/", F.lit("policy"), F.col("tenant_id"), F.col("policy_external_id")))
    out = (
        incoming.withColumn("content_sha256", content)
        .withColumn("metadata_sha256", meta)
        .withColumn("policy_id", policy)
        .withColumn("error", F.coalesce(validation_error(cols), F.when(F.col("metadata_sha256").isNull(), "metadata_json must be a JSON object")))
    )
    version = F.concat_ws("/", F.lit("version"), "policy_id", "content_sha256", "metadata_sha256")
    return out.withColumn("policy_version_id", uuid5(ID_SPACE, version))


def _first(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.min("arrival_seq").alias(name), F.count(F.lit(1)).alias("n"))


def _claimed(rows: DataFrame, taken: DataFrame, key: list[str], flag: str, hot_rows: int) -> DataFrame:
    """Flag rows whose key is among ``taken``; heavy keys are spread by ``salted_lookup``."""
    weight = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    marks = weight.join(taken.select(*key).distinct(), key, "left_semi").withColumn(flag, F.lit(True))
    return salted_lookup(rows, marks, key, "arrival_seq", "n", hot_rows).drop("n")


def _drop_claimed(rows: DataFrame, used: DataFrame, labelled: bool, hot_rows: int) -> DataFrame:
    """Rows whose content key and label are both still free."""
    rows = _claimed(rows, used, CONTENT_KEY, "dup", hot_rows).where(F.col("dup").isNull()).drop("dup")
    if labelled:
        labels = used.where(F.col("version_label").isNotNull())
        rows = _claimed(rows, labels, LABEL_KEY, "clash", hot_rows).where(F.col("clash").isNull()).drop("clash")
    return rows


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one policy in arrival order: each one whose keys are still free is accepted and takes them."""
    rows = rows.sort_values("arrival_seq", kind="stable")
    contents, labels, keep = set(), set(), []
    for content, meta, label in zip(rows["content_sha256"], rows["metadata_sha256"], rows["version_label"]):
        wins = (content, meta) not in contents and (label is None or label not in labels)
        if wins:
            contents.add((content, meta))
            labels.add(label)
        keep.append(wins)
    return rows[np.array(keep, dtype=bool)]


def _first_stretch(open_rows: DataFrame, fold_rows: int, hot_rows: int) -> DataFrame:
    """``open_rows`` with ``now``: whether a row belongs to the first (some ``fold_rows``) rows of its policy."""
    halves = [1 / 2**k for k in range(41)]
    edges = F.percentile_approx("arrival_seq", halves, 10_000).alias("edges")
    sizes = open_rows.groupBy("policy_id").agg(F.count(F.lit(1)).alias("n"), F.max("arrival_seq").alias("last"), edges)
    halvings = F.least(F.lit(40), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / fold_rows))).cast("int"))
    sizes = sizes.select("policy_id", "n", F.when(F.col("n") <= fold_rows, F.col("last")).otherwise(F.get("edges", halvings)).alias("edge"))
    return salted_lookup(open_rows, sizes, ["policy_id"], "arrival_seq", "n", hot_rows).withColumn("now", F.col("arrival_seq") <= F.col("edge")).drop("n", "edge")


def settle(keys: DataFrame, taken: DataFrame, hot_rows: int = HOT_ROWS, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Accept rows in arrival order so that no content key and no label is used twice per policy.

    ``keys``: arrival_seq, policy_id, content_sha256, metadata_sha256, version_label.
    ``taken``: the same keys of existing versions.
    Without labels the first row of every free content key wins. With labels, rows that come first for both of their keys
    are accepted at once, and the rows they block are refused. What is left hangs together in chains, where each row
    waits for the one before: the first ``fold_rows`` of each policy are settled one after the other in one task, keys
    they took are dropped from the rest, and so on. So the number of jobs follows from the size of the largest policy's
    rest over ``fold_rows``, not from the length of a chain.
    """
    open_rows = keys
    labelled = not keys.where(F.col("version_label").isNotNull()).isEmpty()
    used = taken.select(*CONTENT_KEY, "version_label")
    if not used.isEmpty():
        open_rows = _drop_claimed(open_rows, used, labelled, hot_rows)
    if not labelled:
        first = F.min("arrival_seq").alias("arrival_seq")
        none = F.lit(None).cast("string").alias("version_label")
        return cut_lineage(open_rows.groupBy(*CONTENT_KEY).agg(first).select("arrival_seq", *CONTENT_KEY, none))
    accepted = []
    while True:
        content = _first(open_rows, CONTENT_KEY, "first_content")
        label = _first(open_rows.where(F.col("version_label").isNotNull()), LABEL_KEY, "first_label")
        ranked = salted_lookup(open_rows, content, CONTENT_KEY, "arrival_seq", "n", hot_rows).drop("n")
        ranked = salted_lookup(ranked, label, LABEL_KEY, "arrival_seq", "n", hot_rows).drop("n")
        wins = (F.col("arrival_seq") == F.col("first_content")) & (
            F.col("version_label").isNull() | (F.col("arrival_seq") == F.col("first_label"))
        )
        ranked = cut_lineage(ranked.select(*keys.columns, wins.alias("wins")))
        new = ranked.where("wins").select(*keys.columns)
        accepted.append(new)
        waiting = _drop_claimed(ranked.where(~F.col("wins")).select(*keys.columns), new, labelled, hot_rows)
        waiting = cut_lineage(_first_stretch(waiting, fold_rows, hot_rows))
        if waiting.isEmpty():
            break
        now = waiting.where("now").select(*keys.columns)
        # At most some ``fold_rows`` rows of a policy meet in a task.
        settled = cut_lineage(now.groupBy("policy_id").applyInPandas(_fold, now.schema))
        accepted.append(settled)
        later = waiting.where(~F.col("now")).select(*keys.columns)
        if later.isEmpty():
            break
        open_rows = cut_lineage(_drop_claimed(later, settled, labelled, hot_rows))
    return reduce(DataFrame.unionByName, accepted)


def register(
    incoming: DataFrame,
    policies: DataFrame,
    versions: DataFrame,
    hot_rows: int = HOT_ROWS,
    slice_rows: int = ARRIVALS_PER_SLICE,
) -> RegisterResult:
    """Register ``incoming`` against existing ``policies`` and ``versions``.

    Returns all policies after the run, the new versions, one item per new version, and one row per
    refused document with its reason (invalid, duplicate, label_conflict, conflict).
    """
    # Contents are hashed once; everything after works on the slim rows.
    rows = cut_lineage(prepare(incoming).drop("content"))
    keys = rows.where(F.col("error").isNull()).select("arrival_seq", *CONTENT_KEY, "version_label")
    accepted = settle(keys, versions.select(*CONTENT_KEY, "version_label"), hot_rows)

    won = rows.drop("error").join(accepted.select("arrival_seq"), "arrival_seq", "left_semi")
    new_versions = number_versions(
        won.select(
            "arrival_seq", "tenant_id", "policy_id", "policy_version_id", "version_label", "title", "effective_date",
            "content_sha256", "metadata_sha256", "metadata_json", F.col("container_name").alias("blob_container"),
            F.col("blob_path").alias("blob_name"), F.col("batch_id").alias("ingest_batch_id"),
        ),
        versions.select("policy_id", "version_number", "policy_version_id"),
        slice_rows=slice_rows,
    ).withColumn("parse_status", F.lit("pending"))
    items = new_versions.select(
        "tenant_id", F.col("ingest_batch_id").alias("batch_id"),
        uuid5(ID_SPACE, F.concat_ws("/", F.lit("item"), "ingest_batch_id", "policy_version_id")).alias("item_id"),
        "policy_id", "blob_container", "blob_name", "content_sha256", "metadata_sha256",
        F.col("policy_version_id").alias("result_policy_version_id"), F.lit("queued").alias("status"),
    )
    return RegisterResult(
        policies=policies_after(policies, won),
        versions=new_versions,
        items=items,
        rejects=rejected(rows, accepted, versions, hot_rows),
    )


def rejected(rows: DataFrame, accepted: DataFrame, versions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Reason per refused row; a duplicate names the version it repeats."""
    slim = rows.select("arrival_seq", *CONTENT_KEY, "version_label", "error")
    lost = slim.join(accepted.select("arrival_seq"), "arrival_seq", "left_anti")
    invalid = lost.where(F.col("error").isNotNull())
    valid = lost.where(F.col("error").isNull())
    version = F.concat_ws("/", F.lit("version"), *CONTENT_KEY)
    winners = accepted.select(*CONTENT_KEY, F.col("arrival_seq").alias("won_at"), uuid5(ID_SPACE, version).alias("existing_id"))
    known = versions.select(*CONTENT_KEY, F.lit(None).cast("long").alias("won_at"), F.col("policy_version_id").alias("existing_id"))
    weight = valid.groupBy(*CONTENT_KEY).agg(F.count(F.lit(1)).alias("n"))
    per_key = weight.join(winners.unionByName(known), CONTENT_KEY)
    judged = salted_lookup(valid, per_key, CONTENT_KEY, "arrival_seq", "n", hot_rows)
    repeats = F.col("existing_id").isNotNull() & (F.col("won_at").isNull() | (F.col("won_at") < F.col("arrival_seq")))
    reason = F.when(repeats, "duplicate").when(blank(F.col("version_label")), "conflict").otherwise("label_conflict")
    out = judged.select(
        "arrival_seq", "policy_id", "version_label", reason.alias("reason"),
        F.when(repeats, F.col("existing_id")).alias("existing_policy_version_id"),
        F.lit(None).cast("string").alias("error"),
    )
    bad = invalid.select(
        "arrival_seq", "policy_id", "version_label", F.lit("invalid").alias("reason"),
        F.lit(None).cast("string").alias("existing_policy_version_id"), "error",
    )
    return out.unionByName(bad)


def policies_after(policies: DataFrame, won: DataFrame) -> DataFrame:
    """Get-or-create policies and apply the first-write rules of their metadata.

    The type is set once; a department only replaces null, empty or ``all``; the authority only
    replaces zero. Each rule is the first fitting value in arrival order, so one aggregate does it.
    """
    m = F.col("metadata_json")

    def filled(*names: str) -> Column:
        return F.coalesce(*(F.nullif(F.get_json_object(m, f"$.{n}"), F.lit("")) for n in names))

    kind, dept = filled("policy_type", "type"), filled("department_scope", "department")
    level = F.get_json_object(m, "$.authority_level").try_cast("int")

    def first(value: Column, when: Column) -> Column:
        return F.min(F.when(when, F.struct(F.col("arrival_seq"), value.alias("v"))))["v"]

    seen = won.groupBy("policy_id").agg(
        F.min_by("tenant_id", "arrival_seq").alias("_tenant"),
        F.min_by("policy_external_id", "arrival_seq").alias("_external"),
        F.min_by("policy_name", "arrival_seq").alias("_name"),
        first(kind, kind.isNotNull()).alias("_kind"),
        first(dept, dept.isNotNull() & (dept != "all")).alias("_dept"),
        first(dept, dept.isNotNull()).alias("_any_dept"),
        first(level, level > 0).alias("_level"),
    )
    both = policies.join(seen, "policy_id", "full_outer")
    scope = F.col("department_scope")
    open_scope = scope.isNull() | scope.isin("", "all")
    out = {
        "tenant_id": F.coalesce("tenant_id", "_tenant"),
        "external_id": F.coalesce("external_id", "_external"),
        "name": F.coalesce("name", "_name"),
        "status": F.coalesce("status", F.lit("draft")),
        "policy_type": F.coalesce(F.nullif("policy_type", F.lit("")), "_kind", "policy_type"),
        "department_scope": F.when(open_scope, F.coalesce("_dept", F.when(scope.isNull() | (scope == ""), F.col("_any_dept")), scope)).otherwise(scope),
        "authority_level": F.when(
            F.coalesce("authority_level", F.lit(0)) == 0, F.coalesce("_level", F.lit(0))
        ).otherwise(F.col("authority_level")),
    }
    rest = [c for c in policies.columns if c not in out and c != "policy_id"]
    return both.select("policy_id", *(expr.alias(name) for name, expr in out.items()), *rest)


def normalized_metadata(metadata: Column) -> Column:
    """``source_url`` as it is stored after the URL keys were folded together."""
    return source_url(metadata)

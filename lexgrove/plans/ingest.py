"""Version processing: texts in, sections, references, embeddings and current flags out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.ids import extracted_path, is_uuid, sha256_hex
from lexgrove.functions.text import chunks, clean_text, strip_nul
from lexgrove.operators.embedding import Embedder, embed
from lexgrove.operators.references import reference_edges
from lexgrove.scale import fits
from lexgrove.session import stored

REQUESTED = "policy.process.requested"
# Up to this many requested ids are sent to the scan of the texts; more are shuffled together with them.
SENT_IDS = 100_000


def parse_messages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queue payloads (column ``value``) to requests and dead letters.

    An envelope needs the right type; a flat payload is taken as it is. Ids must be UUIDs.
    """
    v = F.try_parse_json("value")
    obj = F.col("value").rlike(r"(?s)^\s*\{")
    kind = F.get_json_object("value", "$.type")
    wrapped = F.get_json_object("value", "$.data").rlike(r"(?s)^\s*\{")
    body = F.when(kind.isNotNull() & F.coalesce(wrapped, F.lit(False)), F.get_json_object("value", "$.data")).otherwise(F.col("value"))
    m = raw.withColumn("_body", body).withColumn("policy_version_id", F.lower(F.get_json_object("_body", "$.policy_version_id")))
    m = m.withColumn("correlation_id", F.get_json_object("_body", "$.correlation_id"))
    error = (
        F.when(v.isNull() | ~obj, "Invalid JSON payload")
        .when(F.coalesce(wrapped, F.lit(False)) & (kind != "") & (kind != REQUESTED), F.concat(F.lit("Unexpected message type: "), kind))
        .when(~is_uuid(F.col("policy_version_id")), "Invalid UUID for policy_version_id")
    )
    m = m.withColumn("error", error).drop("_body")
    good = m.where(F.col("error").isNull()).withColumn("request_id", F.concat(F.lit("policy_version:"), "policy_version_id"))
    return good.drop("error"), m.where(F.col("error").isNotNull())


def to_sections(texts: DataFrame, size: int = 4000) -> DataFrame:
    """Cleaned and chunked sections; ``texts``: tenant_id, policy_id, policy_version_id, text."""
    s = texts.select(
        "tenant_id", "policy_id", "policy_version_id", F.posexplode(chunks(clean_text(strip_nul(F.col("text"))), size)).alias("section_index", "c")
    ).select("tenant_id", "policy_id", "policy_version_id", "section_index", "c.*")
    sid = F.concat_ws(":", "policy_version_id", F.col("section_index").cast("string"))
    return s.withColumn("section_id", sid).withColumn("content_sha256", sha256_hex(F.col("text")))


def process_versions(
    versions: DataFrame, texts: DataFrame, policies: DataFrame, embedder: Embedder | None = None, model: str = "default"
) -> dict[str, DataFrame]:
    """Process requested versions in bulk.

    ``versions``: tenant_id, policy_id, policy_version_id, parse_status, and the order in which they were asked for
    in ``requested_at``, if there is one. ``texts``: policy_version_id, text, error. A ready version is not parsed
    again; a version without a readable text fails. Returns sections, status (with the place of the extracted
    document), references, embeddings (None without embedder) and ``current``: of each policy the last version that is ready now.
    """
    todo = versions.where(F.col("parse_status") != "ready")
    asked = todo.select("policy_version_id").distinct()
    if fits(asked, SENT_IDS):
        texts = texts.join(F.broadcast(asked), "policy_version_id", "left_semi")
    # Whether a text is there is found out before the join, so that only the sections shuffle texts. The slim side is hashed, so they need no sort.
    t = todo.join(texts.select("policy_version_id", F.col("text").isNull().alias("_no_text"), "error"), "policy_version_id", "left")
    failed = F.col("error").isNotNull() | F.coalesce("_no_text", F.lit(True))
    status = t.select(
        "policy_version_id", "policy_id", F.when(failed, "failed").otherwise("ready").alias("parse_status"),
        F.when(failed, "extraction_failed").alias("error_code"), F.when(failed, F.coalesce("error", F.lit("source not found"))).alias("error_message"),
        F.when(~failed, extracted_path(F.col("tenant_id"), F.col("policy_id"), F.col("policy_version_id"))).alias("extracted_blob_name"),
    )
    again = versions.where(F.col("parse_status") == "ready").select("policy_version_id", "policy_id", "parse_status")
    status = status.unionByName(again, allowMissingColumns=True)
    order = F.col("requested_at") if "requested_at" in versions.columns else F.lit(None).cast("timestamp")
    times = versions.select("policy_version_id", order.alias("requested_at"))
    last = F.max(F.struct("requested_at", F.col("policy_version_id").alias("current_version_id"))).alias("t")
    current = status.where(F.col("parse_status") == "ready").join(times, "policy_version_id").groupBy("policy_id").agg(last).select("policy_id", "t.*")
    readable = texts.where(F.col("error").isNull() & F.col("text").isNotNull()).select("policy_version_id", "text")
    # Texts are joined, cleaned and cut once for all outputs.
    sections = stored(to_sections(readable.join(todo.hint("shuffle_hash"), "policy_version_id")), "sections")
    vectors = None
    if embedder is not None:
        facts = policies.select("tenant_id", "policy_id", "policy_type", "department_scope", "authority_level")
        vectors = embed(sections.join(facts, ["tenant_id", "policy_id"]), embedder, model)
    return {"sections": sections, "status": status, "references": reference_edges(sections, policies), "embeddings": vectors, "current": current}

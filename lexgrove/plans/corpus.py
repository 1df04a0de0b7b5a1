"""Policy corpus derived from the given tables.

A policy is a ``source`` of ``documents``, a version is a document, sections are its chunks.
``labels.toxic`` marks versions whose parsing failed, ``embeddings`` gives the vectors of the
documents' first sections, ``benchmark`` texts are the questions, ``events`` are item status events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions.text import chunks, clean_text, strip_nul
from lexgrove.operators.versions import current_versions, mark_current, number_versions
from lexgrove.scale import dimension_join, spread

DEPARTMENTS = ["all", "operations", "claims_ops", "compliance"]
KINDS = ["general", "reference", "guide"]
MODEL = "vectors-64"
STATUS_OF_EVENT = {"signup": "received", "view": "queued", "click": "processing", "purchase": "ready", "error": "failed"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cycle(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    p = table(spark, sf_dir, "documents").select("source").distinct().withColumn("idx", idx)
    return p.select(
        F.col("source").alias("policy_id"), "idx", tenant_of(F.col("idx")).alias("tenant_id"), F.col("source").alias("external_id"),
        F.concat(F.lit("Src S"), F.col("idx").cast("string"), F.lit(" Policy")).alias("name"), F.lit("active").alias("status"),
        (F.col("idx") * 5).alias("authority_level"), _cycle(DEPARTMENTS, F.col("idx")).alias("department_scope"),
        _cycle(KINDS, F.col("idx")).alias("policy_type"),
        F.timestamp_add("DAY", F.col("idx"), F.lit("2024-01-01").cast("timestamp")).alias("created_at"),
    )


def tenant_of(idx: Column) -> Column:
    return F.concat(F.lit("tenant-"), F.pmod(idx, F.lit(2)).cast("string"))


def version_id(doc_id: Column) -> Column:
    return F.concat(F.lit("v"), doc_id.cast("string"))


def section_id(version: Column, index: Column) -> Column:
    return F.concat(version, F.lit(":"), index.cast("string"))


def version_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slim version rows (no text): status, dates, arrival."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    toxic = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    url = F.concat(F.lit('{"lang":"'), F.col("lang"), F.lit('","url":"https://docs.example.org/'), F.col("doc_id").cast("string"), F.lit('"}'))
    return d.join(toxic, "doc_id", "left").select(
        F.col("source").alias("policy_id"), version_id(F.col("doc_id")).alias("policy_version_id"), "doc_id",
        F.col("doc_id").alias("arrival_seq"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("version_label"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(365)).cast("int")).alias("effective_date"),
        F.when(F.coalesce("toxic", F.lit(0)) == 1, "failed").otherwise("ready").alias("parse_status"),
        F.timestamp_add("MINUTE", F.col("n_chars").cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("ready_at"),
        url.alias("metadata_json"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered versions with lineage and the current flag."""
    facts = number_versions(version_facts(spark, sf_dir))
    return mark_current(facts, current_versions(facts))


def current_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions with their current flag, without numbering."""
    facts = version_facts(spark, sf_dir)
    return mark_current(facts, current_versions(facts))


def raw_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections of all documents: ids, offsets, text."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    s = d.select(
        version_id(F.col("doc_id")).alias("policy_version_id"), F.col("source").alias("policy_id"),
        F.posexplode(chunks(clean_text(strip_nul(F.col("text"))))).alias("section_index", "c"),
    )
    return s.select(section_id(F.col("policy_version_id"), F.col("section_index")).alias("section_id"), "policy_version_id", "policy_id", "section_index", "c.*")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections joined to their version and policy (the searchable corpus)."""
    v = current_flags(spark, sf_dir).select(
        "policy_version_id", "policy_id", "parse_status", "is_current", "effective_date", "metadata_json"
    )
    p = policies(spark, sf_dir).select(
        "policy_id", "tenant_id", F.col("name").alias("policy_name"), "department_scope", "authority_level", "policy_type"
    )
    # Facts are put together per version, so that texts are shuffled once, by version.
    v = dimension_join(v, p, ["policy_id"], "policy_version_id")
    # The slim side is hashed, so texts need no sort.
    s = raw_sections(spark, sf_dir).drop("policy_id").join(v.hint("shuffle_hash"), "policy_version_id")
    meta = lambda key: F.get_json_object("metadata_json", f"$.{key}")
    return s.withColumn("fts_policy_type", F.coalesce("policy_type", meta("policy_type"), meta("type"))).withColumn(
        "public_url", F.coalesce(meta("source_url"), meta("public_url"), meta("url"))
    )


def section_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version and policy columns by version, for joins that need no text."""
    v = current_flags(spark, sf_dir).select("policy_version_id", "policy_id", "parse_status", "is_current", "effective_date")
    p = policies(spark, sf_dir).select("policy_id", "tenant_id", "department_scope", "authority_level", "policy_type")
    return dimension_join(v, p, ["policy_id"], "policy_version_id")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of first sections with the columns a search filters on (ready versions only)."""
    version = version_id(F.col("vec_id"))
    e = table(spark, sf_dir, "embeddings").select(
        version.alias("policy_version_id"), section_id(version, F.lit(0)).alias("section_id"), "embedding", F.lit(MODEL).alias("embedding_model")
    )
    return e.join(section_facts(spark, sf_dir), "policy_version_id").where(F.col("parse_status") == "ready")


def stored_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = version_id(F.col("vec_id"))
    return table(spark, sf_dir, "embeddings").select(section_id(version, F.lit(0)).alias("section_id"), F.lit(MODEL).alias("embedding_model"), "embedding")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a question, with the vector of the same number."""
    b = table(spark, sf_dir, "benchmark")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    n = F.col("item_id")
    return b.join(e, "item_id", "left").select(
        F.concat(F.lit("q"), n.cast("string")).alias("question_id"), tenant_of(n).alias("tenant_id"), F.col("text").alias("question"),
        _cycle(DEPARTMENTS, n + 1).alias("department"), (F.pmod(n, F.lit(4)) == 3).alias("only_current"),
        F.lit(None).cast("array<string>").alias("policy_ids"),
        F.when(F.pmod(n, F.lit(5)) == 4, F.array(F.lit("general"), F.lit("guide"))).alias("policy_types"), "vector",
    )


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as item status changes: the user is the batch, the number in ``props`` the item."""
    mapped = F.create_map(*(F.lit(x) for pair in STATUS_OF_EVENT.items() for x in pair))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("batch_id"), F.get_json_object("props", "$.k").cast("long").alias("item_id"), "ts",
        F.col("event_id").alias("seq"), F.element_at(mapped, F.col("event_type")).alias("status"),
    )


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as registrations: the language is the policy, so copies from several sources meet."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("arrival_seq"), F.lit("tenant-0").alias("tenant_id"), F.col("source").alias("batch_id"),
        F.lit("policies").alias("container_name"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("blob_path"),
        F.col("lang").alias("policy_external_id"), F.concat(F.lit("Corpus "), "lang").alias("policy_name"),
        F.lit(None).cast("string").alias("version_label"), F.lit("{}").alias("metadata_json"),
        F.lit(None).cast("date").alias("effective_date"), F.lit(None).cast("string").alias("title"), F.col("text").alias("content"),
    )


def no_policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [], "policy_id string, tenant_id string, external_id string, name string, status string, policy_type string, department_scope string, authority_level int"
    )


def no_versions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [], "policy_id string, policy_version_id string, version_number long, version_label string, content_sha256 string, metadata_sha256 string"
    )



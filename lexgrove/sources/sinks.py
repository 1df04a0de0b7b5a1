"""Idempotent writers: a repeated run leaves the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions.ids import extracted_path

BUCKETS = 256


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("x int").parquet(path)
    except AnalysisException:
        return False
    return True


def read_table(spark: SparkSession, path: str, like: DataFrame, key: str = "policy_version_id") -> DataFrame:
    """Stored rows, or none of the same shape when nothing was written yet."""
    if not exists(spark, path):
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(path).where(F.col(key).isNotNull())


def replace_versions(rows: DataFrame, versions: DataFrame, path: str, buckets: int = BUCKETS, key: str = "policy_version_id") -> None:
    """Delete-then-insert by version.

    Rows lie in partitions by a hash of the version. Partitions that ``versions`` (all versions of
    this run, also those without rows) touch are rebuilt from their other versions plus ``rows``
    in a staging folder and then put in place; the others are not read. Every touched partition
    gets a marker row without key, so that one whose versions end up without rows is emptied too.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = rows.withColumn("bucket", bucket)
    touched = versions.select(key).distinct().withColumn("bucket", bucket)
    marks = touched.select("bucket").distinct()
    shape = new.schema
    if exists(spark, path):
        # At most ``buckets`` numbers, as literals, so that the scan skips the other partitions.
        numbers = sorted(r.bucket for r in marks.collect())
        old = spark.read.schema(shape).parquet(path).where(F.col("bucket").isin(numbers) & F.col(key).isNotNull())
        old = old.join(touched.select(key), key, "left_anti")
        new = new.unionByName(old.select(*new.columns))
    new = new.unionByName(marks, allowMissingColumns=True)
    staging = f"{path.rstrip('/')}_staging"
    new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(staging)
    staged = spark.read.schema(shape).parquet(staging).repartition("bucket")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def append_new(rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Insert, ignore conflict: append rows whose key is not stored yet; returns what was added."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates(list(keys))
    if exists(spark, path):
        stored = spark.read.schema(rows.schema).parquet(path)
        fresh = fresh.join(stored.select(*keys), list(keys), "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def extracted_documents(sections: DataFrame, created_at: Column) -> DataFrame:
    """One JSON document per version with its sections in order, and where it is stored."""
    section = F.struct(
        "section_index", F.col("section_path").alias("section_key"), "title", "start_offset", "end_offset", "text"
    )
    ids = ["tenant_id", "policy_id", "policy_version_id"]
    docs = sections.groupBy(*ids).agg(F.array_sort(F.collect_list(section)).alias("sections"))
    docs = docs.withColumn("created_at", created_at)
    return docs.select(
        *ids, F.size("sections").alias("n_sections"),
        F.to_json(F.struct("policy_version_id", "policy_id", "tenant_id", "created_at", "sections")).alias("document"),
        extracted_path(*(F.col(c) for c in ids)).alias("extracted_blob_name"),
    )


def write_extracted(docs: DataFrame, path: str) -> None:
    """Overwrite only the versions written now; one row per document, not one folder."""
    replace_versions(docs, docs, path)


def write_report(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Run report: one JSON folder for the documents, one for the summary."""
    rows.write.mode("overwrite").json(f"{path}/documents")
    summary.write.mode("overwrite").json(f"{path}/summary")

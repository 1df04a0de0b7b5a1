"""Hybrid fusion of vector and full-text candidates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.scale import top_per_group


@dataclass(frozen=True)
class HybridConfig:
    """Defaults are the fixed values of the retrieval contract."""

    per_source: int = 20
    vector_floor: float = 0.65
    fts_floor: float = 0.05
    vector_weight: float = 0.45
    fts_weight: float = 0.35
    authority_weight: float = 0.15
    recency_weight: float = 0.05
    per_policy: int = 2
    top_k: int = 40

    def weights(self) -> tuple[float, float, float, float]:
        """Weights scaled to sum one; a sum of zero or less falls back to the defaults."""
        given = (self.vector_weight, self.fts_weight, self.authority_weight, self.recency_weight)
        total = sum(given)
        if total <= 0:
            d = HybridConfig
            return (d.vector_weight, d.fts_weight, d.authority_weight, d.recency_weight)
        return tuple(w / total for w in given)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def max_normalize(df: DataFrame, by: Sequence[str], score: str = "score", out: str = "norm") -> DataFrame:
    """Score divided by the best of its group; zero when the best is not positive."""
    best = F.max(score).over(Window.partitionBy(*by))
    return df.withColumn(out, F.when(best > 0, F.col(score) / best).otherwise(0.0))


def cap_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 2) -> DataFrame:
    return df if n < 1 else top_per_group(df, by, order, n, "_pos").drop("_pos")


def merge_sources(vector: DataFrame, fts: DataFrame, cfg: HybridConfig) -> DataFrame:
    """Keyed merge of both candidate lists per question; the vector row comes first.

    Both inputs: question_id, section_id, policy_version_id, policy_id, score, rank.
    """
    v = vector.where(F.col("score") >= cfg.vector_floor).withColumn("source", F.lit("vector"))
    t = fts.where(F.col("score") >= cfg.fts_floor).withColumn("source", F.lit("fts"))
    # Partitioned by question once; every window below keeps this partitioning.
    both = v.unionByName(t).repartition("question_id")
    both = max_normalize(both, ["question_id", "source"])
    norm = lambda s: F.coalesce(F.max(F.when(F.col("source") == s, F.col("norm"))), F.lit(0.0))
    count = lambda s: F.count_if(F.col("source") == s)
    place = F.when(F.col("source") == "vector", F.col("rank")).otherwise(F.col("rank") + 1_000_000)
    merged = both.groupBy("question_id", "section_id", "policy_version_id").agg(
        F.min_by("policy_id", place).alias("policy_id"),
        F.min_by("source", place).alias("first_source"),
        F.min(place).alias("merge_order"),
        clamp01(norm("vector")).alias("vector_score"),
        clamp01(norm("fts")).alias("fts_score"),
        count("vector").alias("_v"),
        count("fts").alias("_t"),
    )
    per_question = Window.partitionBy("question_id")
    return (
        merged.withColumn("vector_candidates", F.sum("_v").over(per_question))
        .withColumn("fts_candidates", F.sum("_t").over(per_question))
        .withColumn("merged_candidates", F.count(F.lit(1)).over(per_question))
        .drop("_v", "_t")
    )


def fuse(merged: DataFrame, facts: DataFrame, cfg: HybridConfig = HybridConfig(), digits: int = 9) -> DataFrame:
    """Weighted score, per-policy cap and top-k.

    ``facts`` adds authority_level and effective_date per (question_id, section_id); it may carry
    any further section columns.
    """
    wv, wt, wa, wr = cfg.weights()
    per_question = Window.partitionBy("question_id")
    c = merged.join(facts, ["question_id", "section_id"]) if facts is not None else merged
    level = F.coalesce(F.col("authority_level").cast("double"), F.lit(0.0))
    ts = F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.col("effective_date").cast("string"))).cast("double"), F.lit(0.0))
    c = c.withColumn("_level", level).withColumn("_ts", ts)
    low, high = F.min("_ts").over(per_question), F.max("_ts").over(per_question)
    top_level = F.greatest(F.lit(1.0), F.max("_level").over(per_question))
    c = c.withColumn("authority_weight", clamp01(F.col("_level") / top_level))
    c = c.withColumn("recency_weight", F.when(high > low, clamp01((F.col("_ts") - low) / (high - low))).otherwise(0.0))
    score = (
        F.lit(wv) * F.col("vector_score") + F.lit(wt) * F.col("fts_score")
        + F.lit(wa) * F.col("authority_weight") + F.lit(wr) * F.col("recency_weight")
    )
    v, t = F.col("vector_score"), F.col("fts_score")
    c = c.withColumn("score", F.round(score, digits)).drop("_level", "_ts")
    c = c.withColumn("source", F.lit("hybrid")).withColumn(
        "retriever_source", F.when((v >= t) & (v > 0), "vector").when(t > 0, "fts").otherwise(F.col("first_source"))
    )
    order = [F.col("score").desc(), F.col("merge_order"), F.col("section_id")]
    c = c.withColumn("filtered_candidates", F.count(F.lit(1)).over(per_question))
    c = cap_per_group(c, ["question_id", "policy_id"], order, cfg.per_policy)
    return top_per_group(c, ["question_id"], order, max(1, cfg.top_k))

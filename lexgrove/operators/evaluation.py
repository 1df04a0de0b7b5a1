"""Outcome of answered question sets against expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.operators.answers import REFUSAL_PHRASE


def evaluate(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per expected question: ANSWERED, REFUSED or ERROR (no answer), cited paths, ok."""
    refused = F.lower(F.coalesce("answer", F.lit(""))).contains(REFUSAL_PHRASE.lower())
    paths = F.filter(F.transform("citation_items", lambda i: i["section_path"]), lambda p: F.coalesce(F.length(p), F.lit(0)) > 0)
    a = answers.select("question_id", "answer", "confidence", F.slice(paths, 1, 4).alias("cites"))
    e = expected.join(a, "question_id", "left")
    status = F.when(F.col("answer").isNull(), "ERROR").when(refused, "REFUSED").otherwise("ANSWERED")
    e = e.withColumn("status", status)
    ok = ((F.col("status") == "REFUSED") & (F.col("expectation") == "refuse")) | (
        (F.col("status") == "ANSWERED") & (F.col("expectation") == "ground")
    )
    return e.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def pass_report(evaluated: DataFrame) -> DataFrame:
    """Passed and total per category, and over all (category null)."""
    return evaluated.rollup("category").agg(
        F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "REFUSED").alias("refused"), F.count_if(F.col("status") == "ERROR").alias("errors"),
    )


def samples(evaluated: DataFrame, categories: list[str], n: int = 6, order: str = "question_id") -> DataFrame:
    """First answered rows of some categories, for the report."""
    shown = evaluated.where((F.col("status") == "ANSWERED") & F.col("category").isin(categories))
    return shown.orderBy(order).limit(n)

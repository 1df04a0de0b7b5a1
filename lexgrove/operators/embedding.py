"""Embedding input text, backlog and idempotent filling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.operators.observed import Counts, rows

Embedder = Callable[[list[str]], list[list[float]]]
BATCH = 16


def embedding_text(policy_type: Column, department_scope: Column, authority_level: Column, title: Column, text: Column) -> Column:
    """Four header lines, an empty line, the section text."""

    def either(c: Column, default: str) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))

    return F.concat(
        F.lit("Policy Type: "), either(policy_type, "unknown"),
        F.lit("\nDepartment Scope: "), either(department_scope, "all"),
        F.lit("\nAuthority Level: "), F.coalesce(authority_level, F.lit(0)).cast("int").cast("string"),
        F.lit("\nSection Title: "), either(title, "Untitled"),
        F.lit("\n\n"), F.coalesce(text, F.lit("")),
    )


def backlog(sections: DataFrame, embeddings: DataFrame, model: str, only_current: bool = True, counts: Counts | None = None) -> DataFrame:
    """Ready sections that have no vector of ``model`` yet."""
    ready = sections.where(F.col("parse_status") == "ready")
    if only_current:
        ready = ready.where("is_current")
    if counts:
        ready = counts.at(ready, scanned=rows())
    done = embeddings.where(F.col("embedding_model") == model).select("section_id")
    return ready.join(done, "section_id", "left_anti")


def hashing_embedder(dim: int = 64) -> Embedder:
    """Deterministic bag-of-words vectors, so that tests need no service."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            hashed = pd.util.hash_array(np.array(text.lower().split() or [""], dtype=object))
            v = np.bincount(hashed % dim, minlength=dim).astype(float)
            out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
        return out

    return embed


def embed(sections: DataFrame, embedder: Embedder, model: str, batch: int = BATCH) -> DataFrame:
    """Vectors for sections, ``batch`` texts per call; a short reply of the embedder is an error."""
    text = embedding_text(*(F.col(c) for c in ("policy_type", "department_scope", "authority_level", "title", "text")))
    todo = sections.select("section_id", "policy_version_id", "policy_id", "tenant_id", text.alias("_input"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list[list[float]] = []
            texts = frame["_input"].tolist()
            for start in range(0, len(texts), batch):
                part = texts[start : start + batch]
                got = embedder(part)
                if len(got) != len(part):
                    raise ValueError(f"embedder returned {len(got)} vectors for {len(part)} texts")
                vectors.extend(got)
            out = frame.drop(columns="_input")
            out["embedding"] = vectors
            yield out

    schema = "section_id string, policy_version_id string, policy_id string, tenant_id string, embedding array<float>"
    return todo.mapInPandas(run, schema).withColumn("embedding_model", F.lit(model))


def embed_missing(
    sections: DataFrame, embeddings: DataFrame, embedder: Embedder, model: str, only_current: bool = True, counts: Counts | None = None
) -> DataFrame:
    """New embedding rows only; appending them and running again adds nothing.

    ``counts`` learns, while the rows are written, how many sections were ``scanned`` and how many rows ``inserted``;
    the others had a vector or came twice.
    """
    new = embed(backlog(sections, embeddings, model, only_current, counts).dropDuplicates(["section_id"]), embedder, model)
    return counts.at(new, inserted=rows()) if counts else new


def fallback_text(embeddings: DataFrame, sections: DataFrame) -> DataFrame:
    """Fill missing text of denormalised embedding rows, drop rows without ids or text."""
    known = sections.select("section_id", "tenant_id", F.col("text").alias("_text"))
    out = embeddings.dropna(subset=["section_id", "policy_id", "policy_version_id"]).join(known, ["section_id", "tenant_id"], "left")
    out = out.withColumn("text", F.coalesce(F.nullif(F.col("text"), F.lit("")), "_text")).drop("_text")
    return out.where(F.coalesce(F.length("text"), F.lit(0)) > 0)


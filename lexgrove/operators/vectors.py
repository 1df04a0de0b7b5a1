"""Exact vector search in blocks, identifier boost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions.text import blank
from lexgrove.scale import fits, top_per_group

CONTROL_ID = r"\b([A-Za-z]{2})-(\d+)(\(\d+\))?(?!\w)"
FOUND = "question_id string, section_id string, policy_version_id string, policy_id string, score double"
# A question block is at most this many vectors; one block is sent to every task.
BLOCK_QUESTIONS = 4096
# Vectors scored at a time, so that a full block needs some 70 MB of scores.
SLICE_ROWS = 2048
# Rows of the vector table per fragment once the questions no longer fit into one block.
FRAGMENT_ROWS = 100_000
VECTOR_COLUMNS = ["section_id", "policy_version_id", "policy_id", "tenant_id", "is_current", "policy_type", "embedding"]
ASK_COLUMNS = ["question_id", "tenant_id", "only_current", "policy_ids", "policy_types", "vector"]


def _matrix(column: pd.Series) -> np.ndarray:
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def _allowed(asks: pd.DataFrame, rows: pd.DataFrame, scoped: bool) -> np.ndarray:
    """Question by row: tenant, current-only, policy and type scope."""
    ok = asks["tenant_id"].to_numpy()[:, None] == rows["tenant_id"].to_numpy()[None, :]
    if not scoped:
        return ok
    everything = ~asks["only_current"].to_numpy(dtype=bool)
    ok &= everything[:, None] | rows["is_current"].to_numpy(dtype=bool)[None, :]
    for i, (ids, kinds) in enumerate(zip(asks["policy_ids"], asks["policy_types"])):
        if ids is not None and len(ids):
            ok[i] &= rows["policy_id"].isin(list(ids)).to_numpy()
        if kinds is not None and len(kinds):
            ok[i] &= rows["policy_type"].isin(list(kinds)).to_numpy()
    return ok


def _best(asks: pd.DataFrame, rows: pd.DataFrame, k: int, scoped: bool, digits: int) -> pd.DataFrame:
    """Best ``k`` rows per question within one slice of vectors; equal scores go by section id."""
    rows = rows.sort_values("section_id", kind="stable")
    scores = _matrix(asks["vector"]) @ _matrix(rows["embedding"]).T
    scores = np.round(scores, digits)
    scores[~_allowed(asks, rows, scoped)] = -np.inf
    n = scores.shape[1]
    # Everything from the k-th best score on, then cut to k by (score, section id).
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(asks), -np.inf)
    q, at = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
    order = np.lexsort((at, -scores[q, at], q))
    q, at = q[order], at[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    q, at = q[place < k], at[place < k]
    found = rows[["section_id", "policy_version_id", "policy_id"]].iloc[at].reset_index(drop=True)
    found.insert(0, "question_id", asks["question_id"].to_numpy()[q])
    found["score"] = scores[q, at]
    return found


def _keep(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.sort_values(["question_id", "score", "section_id"], ascending=[True, False, True], kind="stable")
    return found.groupby("question_id", sort=False).head(k)


def _asks(questions: DataFrame) -> DataFrame:
    q = questions.where(~blank(F.col("question")) & F.col("vector").isNotNull())
    optional = {
        "only_current": F.lit(True),
        "policy_ids": F.lit(None).cast("array<string>"),
        "policy_types": F.lit(None).cast("array<string>"),
    }
    for name, default in optional.items():
        q = q.withColumn(name, F.coalesce(F.col(name), default) if name in q.columns else default)
    return q.select(*ASK_COLUMNS)


def vector_topk(
    questions: DataFrame, vectors: DataFrame, k: int = 20, scoped: bool = True, digits: int = 9,
    block: int = BLOCK_QUESTIONS, fragment_rows: int = FRAGMENT_ROWS,
) -> DataFrame:
    """Cosine similarity, best ``k`` per question, exact. Rows are ordered by the raw value; the score shown is held within 0..1.

    Up to ``block`` questions travel to every task and each task returns its own best rows, so the
    vector table is read once and never shuffled. More questions are cut into blocks and the vector
    table into fragments; every (block, fragment) pair is one bounded group. ``scoped=False`` keeps
    only the tenant test, as the document-store backend does.
    """
    asks = _asks(questions)
    rows = vectors.select(*VECTOR_COLUMNS).where(F.col("embedding").isNotNull())
    if fits(asks, block):
        sent = asks.toPandas()

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for batch in batches:
                for start in range(0, len(batch) if len(sent) else 0, SLICE_ROWS):
                    found = _best(sent, batch.iloc[start : start + SLICE_ROWS], k, scoped, digits)
                    best = found if best is None else _keep(pd.concat([best, found], ignore_index=True), k)
            if best is not None:
                yield best

        found = rows.mapInPandas(scan, FOUND)
    else:
        n_blocks = max(1, -(-asks.count() // block))
        n_fragments = max(1, -(-rows.count() // fragment_rows))
        left = asks.withColumn("block", F.pmod(F.xxhash64("question_id"), F.lit(n_blocks))).withColumn(
            "fragment", F.explode(F.sequence(F.lit(0), F.lit(n_fragments - 1)).cast("array<long>"))
        )
        right = rows.withColumn("fragment", F.pmod(F.xxhash64("section_id"), F.lit(n_fragments))).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>"))
        )

        def pair(some: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            if some.empty or part.empty:
                return pd.DataFrame({c: [] for c in ("question_id", "section_id", "policy_version_id", "policy_id", "score")})
            slices = (part.iloc[i : i + SLICE_ROWS] for i in range(0, len(part), SLICE_ROWS))
            return _keep(pd.concat([_best(some, x, k, scoped, digits) for x in slices], ignore_index=True), k)

        keys = ["block", "fragment"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, FOUND)
    best = top_per_group(found, ["question_id"], [F.col("score").desc(), F.col("section_id")], k)
    return best.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))))


def vector_literal(vector: Column, digits: int = 12) -> Column:
    """Text form of a vector, as vector columns of databases take it: ``digits`` significant digits, 1e-09 for small and large numbers.

    The JVM's formatter rounds halves of the shortest decimal form, databases those of the exact binary value; so this is Arrow-batched Python.
    """

    @F.pandas_udf("string")
    def text(vectors: pd.Series) -> pd.Series:
        lengths = vectors.map(lambda v: -1 if v is None else len(v)).to_numpy(dtype=np.int64)
        numbers = np.concatenate([np.asarray(v, dtype=np.float64) for v in vectors if v is not None] or [np.empty(0)])
        shown = np.char.mod(f"%.{digits}g", numbers).tolist()
        ends = np.cumsum(np.maximum(lengths, 0))
        return pd.Series([None if n < 0 else f"[{','.join(shown[e - n : e])}]" for n, e in zip(lengths.tolist(), ends.tolist())])

    return text(vector.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays as a plain expression, for row-wise use."""

    def dot(x: Column, y: Column) -> Column:
        pairs = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)

    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def control_ids(question: Column) -> Column:
    """Identifiers such as AC-2 or IA-5(1) named in a question, upper-case, without leading zeros."""

    def group(i: int) -> Column:
        return F.regexp_extract_all(question, F.lit(CONTROL_ID), F.lit(i))

    head = F.zip_with(group(1), group(2), lambda a, n: F.concat(F.upper(a), F.lit("-"), F.regexp_replace(n, "^0+(?=.)", "")))
    return F.array_distinct(F.zip_with(head, group(3), lambda h, t: F.concat(h, F.coalesce(t, F.lit("")))))


def boost_exact(found: DataFrame, boost: float = 0.4, most: float = 0.99) -> DataFrame:
    """Raise sections whose path is named in the question; needs question_id, question, section_id, section_path, score.

    Questions that name an identifier are ranked again by the new score, equal ones in the order they had; the others keep theirs.
    """
    ids = control_ids(F.col("question"))
    named = F.array_contains(ids, F.upper("section_path"))
    raised = found.withColumn(
        "score", F.when(F.coalesce(named, F.lit(False)), F.least(F.lit(most), F.col("score") + boost)).otherwise(F.col("score"))
    )
    if "question_id" not in found.columns:
        return raised
    had = [F.col("rank")] if "rank" in found.columns else [F.col("score").desc(), F.col("section_id")]
    order = Window.partitionBy("question_id").orderBy(F.when(F.size(ids) > 0, F.col("score")).desc(), *had)
    return raised.withColumn("rank", F.row_number().over(order))

"""Exact top-k inner products by vector-approximation files.

Vectors are cut into slices of bounded size. Each slice is scanned as a vector-approximation file: every component is
replaced by a cell of ``2**BITS`` equal cells, one matrix product over cell centres gives each score up to a bound that
follows from the cell width and the query, and exact vectors are read in the order of their bounds until no bound can
reach the kth exact score, which is carried from stretch to stretch of the slice. Queries travel in blocks to every slice; the k best of each slice meet in one ranking by query,
limited before the shuffle. So no row meets another twice, and the answer is exact.

Components are ``floor(256 * x)``, scores integers (64 bit). Vectors that are null, empty, or hold null or non-finite
components take no part; vectors of different lengths are never compared. Ties go to the smaller vec_id; a null vec_id is
neither query nor candidate. Repeated rows are candidates of their own: they are scanned once, with their number, and take
as many ranks. A repeated query row asks once; none is compared with rows of its own vec_id.
A finite component beyond 64 bits, or such a score among the k best, ends the query with an error, as in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.llm.common import stored

SCALE = 256
BITS = 6
# A task holds one slice and one block: about 64 MB and 16 MB at 64 components.
SLICE_ROWS = 131_072
BLOCK_ROWS = 32_768
# Approximate scores held at once: QUERIES x STRETCH.
QUERIES = 512
STRETCH = 8_192
# Sums of products below this are exact in 64 bits; larger ones are taken in Python integers.
SAFE = 2.0**62
# Below this many vectors a slice is not worth a task of its own.
LEAST_ROWS = 2_048


def scaled(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v, d): integer components of the vectors that take part."""
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    whole = F.when(F.forall(F.col(vector), lambda x: F.abs(x.cast("double")) < F.lit(2.0**63 / SCALE)), whole).otherwise(F.raise_error(F.lit("a vector component is beyond 64 bits")))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.cast("array<long>").alias("v"), F.size(vector).alias("d"))


def _products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact products, or an object array where 64 bits may not hold them."""
    if float(np.abs(vectors.astype(np.float64)).max(initial=0)) * float(np.abs(query.astype(np.float64)).sum()) < SAFE:
        return vectors @ query
    return vectors.astype(object) @ query.astype(object)


def _long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and any(not -(2**63) <= x < 2**63 for x in scores):
        raise OverflowError("a score among the k best is beyond 64 bits")
    return scores.astype(np.int64)


def scan_slice(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, bits: int = BITS, reads: list[int] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place among ``vectors``, score) of the k best of each query; ``reads`` takes the number of exact vectors read."""
    low = vectors.min(axis=0).astype(np.float64)
    width = np.maximum(1.0, (vectors.max(axis=0).astype(np.float64) - low + 1) / (1 << bits))
    cells = np.minimum((vectors - low) / width, (1 << bits) - 1).astype(np.uint8)
    q = queries.astype(np.float64)
    slack = np.abs(q) @ (width / 2) + 1e-6 * (1 + np.abs(q).sum(axis=1) * float(np.abs(vectors.astype(np.float64)).max(initial=0)))
    from_low, by_cell = q @ (low + width / 2), q * width
    best_s, best_i = [np.empty(0, np.int64)] * len(q), [np.empty(0, np.int64)] * len(q)
    kth = np.full(len(q), -np.inf)
    read = 0
    for a in range(0, len(ids), STRETCH):
        rough = from_low[:, None] + by_cell @ cells[a : a + STRETCH].T
        own = ids[a : a + STRETCH]
        rough[query_ids[:, None] == own[None, :]] = -np.inf
        here = min(k, len(own))
        floor = np.partition(rough, len(own) - here, axis=1)[:, len(own) - here] - slack if here == k else -np.inf
        near = (rough + slack[:, None] >= np.maximum(floor, kth)[:, None]) & (rough > -np.inf)
        for r in np.flatnonzero(near.any(axis=1)):
            cand = np.flatnonzero(near[r])
            cand = cand[np.argsort(-rough[r][cand], kind="stable")]
            for c in range(0, len(cand), 256):
                part = cand[c : c + 256]
                if rough[r][part[0]] + slack[r] < kth[r]:
                    break
                read += len(part)
                s = np.concatenate([best_s[r], _products(vectors[a + part], queries[r])])
                i = np.concatenate([best_i[r], a + part])
                top = np.lexsort((ids[i], -s))[:k]
                best_s[r], best_i[r] = s[top], i[top]
                if len(top) == k:
                    kth[r] = float(best_s[r][-1])
    if reads is not None:
        reads.append(read)
    return np.repeat(np.arange(len(q)), [len(i) for i in best_i]), np.concatenate(best_i), np.concatenate([_long(s) for s in best_s])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, slice_rows: int = SLICE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score). ``vectors`` and ``queries`` as from ``scaled``; a query never meets its own vec_id."""
    base = stored(vectors.groupBy("vec_id", "v", "d").agg(F.count(F.lit(1)).alias("n")), "vectors")
    asked = stored(queries.select("vec_id", "v", "d").distinct(), "queries")
    n = base.count()
    slices = max(1, -(-n // slice_rows), min(base.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS))
    blocks = max(1, -(-asked.count() // block_rows))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda seed, count: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(count)).cast("int")
    mine = base.select("d", dealt(1, slices).alias("slice"), each(blocks).alias("block"), "vec_id", "v", "n")
    theirs = asked.select("d", each(slices).alias("slice"), dealt(2, blocks).alias("block"), "vec_id", "v")

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        got: list[pd.DataFrame] = []
        if len(left) and len(right):
            ids, vecs = left["vec_id"].to_numpy(np.int64), np.stack(left["v"].to_numpy()).astype(np.int64)
            asks, q = right["vec_id"].to_numpy(np.int64), np.stack(right["v"].to_numpy()).astype(np.int64)
            copies = left["n"].to_numpy(np.int64)
            for i in range(0, len(asks), QUERIES):
                r, at, s = scan_slice(ids, vecs, asks[i : i + QUERIES], q[i : i + QUERIES], k)
                got.append(pd.DataFrame({"query_id": asks[i + r], "vec_id": ids[at], "score": s, "n": copies[at]}))
        return pd.concat(got) if got else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "n": []}, dtype="int64")

    keys = ["d", "slice", "block"]
    partial = mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(both, "query_id long, vec_id long, score long, n long")
    rows = partial.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

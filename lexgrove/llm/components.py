"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations by node over the edge list; the number of rounds grows with the
logarithm of the longest chain. Rounds are cut by ``checkpoint()`` in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.session import cut_lineage

MAX_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    around = _both(edges)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select("b", "m").union(least.select(F.col("a").alias("b"), "m")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs -> (node, root): root is the smallest node reachable; nodes without an edge are not returned.

    Repeated edges and loops do no harm; no edges give an empty result.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        now = cut_lineage(_small_star(_large_star(now)).distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())

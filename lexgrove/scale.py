"""Building blocks that keep hot keys and unbounded sides out of single tasks.

``fits``           size check in front of every explicit broadcast
``fine_parts``     parts of bounded size for work that holds its rows in memory
``spread``         all cores for heavy per-row work on few input splits
``dimension_join`` small side by broadcast when its size was checked, by salt otherwise
``salted_lookup``  join back to a per-key aggregate when one key may hold a third of the rows
``bucketed_scan``  running number / running sum / previous value per group, split inside a group
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hot keys are looked up from the heaviest MAX_HOT_KEYS keys, so the broadcast side is bounded
# by construction; every other key holds less than 1/MAX_HOT_KEYS of the rows.
MAX_HOT_KEYS = 10_000
HOT_ROWS = 1_000_000
SALTS = 64
# Dimensions up to this many rows with this many bytes of text are broadcast.
MAX_DIM_ROWS = 100_000
MAX_DIM_BYTES = 32_000_000
DIM_SALTS = 16
# Stored bytes per task of work whose memory grows with the rows of a task.
TASK_BYTES = 4_000_000
UNKNOWN_BYTES = 2**60


def fits(df: DataFrame, max_rows: int, max_bytes: int | None = None) -> bool:
    """True when ``df`` has at most ``max_rows`` rows, and ``max_bytes`` in its texts if given; reads no further than one row beyond."""
    if max_bytes is None:
        return df.limit(max_rows + 1).count() <= max_rows
    texts = (F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary"))
    size = reduce(lambda a, b: a + b, texts, F.lit(0).cast("long"))
    n, held = df.select(size.alias("size")).limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum("size")).first()
    return n <= max_rows and (held or 0) <= max_bytes


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give heavy per-row work all cores when the input has fewer splits than that.

    Large inputs have more splits than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def fine_parts(df: DataFrame, key: str, size: int = TASK_BYTES) -> DataFrame:
    """Shuffle by ``key`` into parts that do not grow with the input: one for every ``size`` bytes of the largest table below.

    Where Spark has no size of the input, it stays as it is.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    largest = max(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if largest >= UNKNOWN_BYTES:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-largest // size)), key)


def dimension_join(rows: DataFrame, dim: DataFrame, keys: Sequence[str], row_id: str, how: str = "inner") -> DataFrame:
    """Join a dimension whose keys may be very uneven on the row side.

    A dimension of checked size is broadcast; a larger one is repeated over ``DIM_SALTS`` so that
    the rows of one key are spread over as many tasks.
    """
    keys = list(keys)
    if fits(dim, MAX_DIM_ROWS, MAX_DIM_BYTES):
        return rows.join(F.broadcast(dim), keys, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(DIM_SALTS)).cast("int"))
    each = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(DIM_SALTS - 1))))
    # Spark sizes all copies like the stored, compressed dimension alone, and would broadcast them.
    return salted.join(each.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def salted_lookup(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    row_id: str,
    count_col: str,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
    how: str = "left",
) -> DataFrame:
    """Join ``rows`` to ``per_key`` (one row per key, with its row count in ``count_col``).

    Keys above ``hot_rows`` are spread over ``salts`` partitions on the row side and repeated
    that many times on the per-key side; all other keys join as usual.
    """
    keys = list(keys)
    hot = F.broadcast(
        per_key.where(F.col(count_col) > hot_rows)
        .orderBy(F.col(count_col).desc(), *keys)
        .limit(MAX_HOT_KEYS)
        .select(*keys, F.lit(True).alias("_hot"))
    )
    # Rows without a key match nothing; they are spread as well.
    no_key = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    spread = F.when(F.coalesce(F.col("_hot"), no_key), F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int")).otherwise(0)
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, keys, "left").withColumn("_salt", spread).drop("_hot")
    right = per_key.join(hot, keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def bucketed_scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    number: str | None = None,
    running: tuple[Column, str] | None = None,
    previous: tuple[Column, str] | None = None,
) -> DataFrame:
    """Ordered scan per group without holding a whole group in one task.

    ``bucket`` must not decrease along ``order``. Windows run inside (group, bucket); one small
    row per (group, bucket) carries counts, sums and last values over to later buckets.
    ``previous`` values must not be null.
    """
    by = list(by)
    d = df.withColumn("_b", bucket)
    local = Window.partitionBy(*by, "_b").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    aggs = [F.count(F.lit(1)).alias("_n")]
    d = d.withColumn("_rn", F.row_number().over(local).cast("long"))
    if running:
        d = d.withColumn("_delta", running[0])
        d = d.withColumn("_rs", F.sum("_delta").over(upto))
        aggs.append(F.sum("_delta").alias("_s"))
    if previous:
        d = d.withColumn("_val", previous[0]).withColumn("_lag", F.lag(previous[0]).over(local))
        aggs.append(F.max_by("_val", "_rn").alias("_last"))
    edges = d.groupBy(*by, "_b").agg(*aggs)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_on")]
    if running:
        carry.append(F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_os"))
    if previous:
        carry.append(F.last("_last", ignorenulls=True).over(before).alias("_op"))
    edges = edges.select(*by, "_b", *carry)
    out = d.join(edges, [*by, "_b"])
    if number:
        out = out.withColumn(number, F.col("_rn") + F.col("_on"))
    if running:
        out = out.withColumn(running[1], F.col("_rs") + F.col("_os"))
    if previous:
        out = out.withColumn(previous[1], F.coalesce("_lag", "_op"))
    drop = [c for c in ("_b", "_rn", "_on", "_delta", "_rs", "_os", "_val", "_lag", "_op") if c in out.columns]
    return out.drop(*drop)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group; Spark limits each group before the shuffle as well."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)

"""Tables of immutable batch folders, each with one commit record: every row is written once, and half-written batches do not exist.

A batch is written to a folder of its own under ``batches``: its rows, and the keys it replaces (also those that end up
without rows). Only then an empty file under ``commits`` names it. Its name holds all there is to know, so the state of a
table is one listing. Readers take, per key, the rows of the last batch that replaced it. A job that dies leaves a
folder that no record names; run again, it writes another one. A batch that is committed already is not written again.

One writer at a time, as with a streaming query; two of them cannot take the same number, since a record is only created
where none is. After ``COMPACT_AFTER`` batches the current rows are written as a new base, so that reads stay short.
"""

from __future__ import annotations

import re
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPACT_AFTER = 32
ADD, BASE = "add", "base"
_RECORD = re.compile(r"^(\d{12})\.(add|base)\.([0-9a-f]{32})\.(.+)$")


class Commit(NamedTuple):
    number: int
    kind: str
    folder: str
    batch: str


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.Path, place.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """All records of a table in order; none if there is no table."""
    make, fs = _file_system(spark, path)
    home = make(f"{path}/commits")
    if not fs.exists(home):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(home))
    found = [_RECORD.match(n) for n in names]
    return [Commit(int(m[1]), m[2], m[3], m[4]) for m in found if m]


def live(spark: SparkSession, path: str) -> list[Commit]:
    """The last base and what came after it."""
    known = commits(spark, path)
    start = max((i for i, c in enumerate(known) if c.kind == BASE), default=0)
    return known[start:]


def _record(spark: SparkSession, path: str, kind: str, folder: str, batch: str) -> None:
    make, fs = _file_system(spark, path)
    number = max((c.number for c in commits(spark, path)), default=-1) + 1
    # Ends with an error where another writer took the number.
    fs.create(make(f"{path}/commits/{number:012d}.{kind}.{folder}.{batch}"), False).close()


def write_batch(rows: DataFrame, keys: DataFrame, path: str, key: str = "policy_version_id") -> str:
    """The folder of a batch, which nobody reads before it is committed."""
    folder = uuid.uuid4().hex
    rows.write.parquet(f"{path}/batches/{folder}/rows")
    keys.select(key).dropna().distinct().write.parquet(f"{path}/batches/{folder}/keys")
    return folder


def replace(rows: DataFrame, keys: DataFrame, path: str, batch: str, key: str = "policy_version_id", compact_after: int = COMPACT_AFTER) -> bool:
    """Replace the rows of ``keys`` by ``rows`` as one commit called ``batch``; False if that batch was committed before.

    ``keys`` has every key of this batch, also those without rows; rows of other keys must not occur. Null keys are not stored.
    """
    spark = rows.sparkSession
    path = path.rstrip("/")
    if any(c.batch == batch for c in commits(spark, path)):
        return False
    folder = write_batch(rows.where(F.col(key).isNotNull()), keys, path, key)
    _record(spark, path, ADD, folder, batch)
    if len(live(spark, path)) > compact_after:
        compact(spark, path, key)
    return True


def _view(spark: SparkSession, path: str, key: str, now: list[Commit]) -> DataFrame:
    def part(name: str) -> DataFrame:
        # A batch may have columns that others lack, and may be empty.
        each = [spark.read.parquet(f"{path}/batches/{c.folder}/{name}").withColumn("_commit", F.lit(c.number)) for c in now]
        out = each[0]
        for other in each[1:]:
            out = out.unionByName(other, allowMissingColumns=True)
        return out

    rows = part("rows")
    if len(now) == 1:
        return rows.drop("_commit")
    last = part("keys").groupBy(key).agg(F.max("_commit").alias("_commit"))
    return rows.join(last, [key, "_commit"], "left_semi").drop("_commit")


def read(spark: SparkSession, path: str, key: str = "policy_version_id") -> DataFrame | None:
    """The current rows; None if nothing was committed yet. A later commit does not change what was read."""
    path = path.rstrip("/")
    now = live(spark, path)
    return _view(spark, path, key, now) if now else None


def as_of(spark: SparkSession, path: str, number: int, key: str = "policy_version_id") -> DataFrame | None:
    """The rows as they were after commit ``number``."""
    path = path.rstrip("/")
    known = [c for c in commits(spark, path) if c.number <= number]
    start = max((i for i, c in enumerate(known) if c.kind == BASE), default=0)
    return _view(spark, path, key, known[start:]) if known else None


def compact(spark: SparkSession, path: str, key: str = "policy_version_id") -> None:
    """Write the current rows as a new base. What came before stays readable by number until ``obsolete`` folders are deleted."""
    path = path.rstrip("/")
    now = live(spark, path)
    if len(now) < 2:
        return
    rows = _view(spark, path, key, now)
    folder = write_batch(rows, rows, path, key)
    _record(spark, path, BASE, folder, f"base-{now[-1].number}")


def obsolete(spark: SparkSession, path: str) -> list[str]:
    """Batch folders that the current state does not need: replaced by a base, or never committed."""
    path = path.rstrip("/")
    make, fs = _file_system(spark, path)
    needed = {c.folder for c in live(spark, path)}
    home = make(f"{path}/batches")
    return sorted(f.getPath().getName() for f in fs.listStatus(home) if f.getPath().getName() not in needed) if fs.exists(home) else []

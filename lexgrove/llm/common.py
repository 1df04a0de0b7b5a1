"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.session import shared_dir

# A missing id sorts before every other one.
NO_ID = -(2**63)
# Rows handed to Python at once; whole texts, so a batch stays in the tens of megabytes.
ARROW_ROWS = 2000
ARROW_BYTES = 32_000_000


def python_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of one Arrow batch, as rows hold whole texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def byte_batches(spark: SparkSession, size: int = ARROW_BYTES) -> None:
    """Bound the bytes of one Arrow batch; a single longer text still makes a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


_HELD: dict[tuple[str, str], Any] = {}


def worker_held(kind: str, key: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one model with its memory. Another one frees it, as workers serve all stages."""
    if (kind, key) not in _HELD:
        drop_held()
        _HELD[kind, key] = make()
    return _HELD[kind, key]


def drop_held() -> None:
    """For tasks without a model: free what a worker still keeps from an earlier stage."""
    if _HELD:
        _HELD.clear()
        give_back()


def give_back() -> None:
    """Return freed memory to the machine; glibc keeps it otherwise, and the next model's comes on top of it."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def id_back(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name))


def utf8(name: str = "text") -> Column:
    """Text as bytes; a missing text is empty."""
    return F.coalesce(F.col(name).cast("string").cast("binary"), F.lit(b""))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a cut that lost executors do not undo."""
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that no classifier learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))

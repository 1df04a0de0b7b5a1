"""Per-key state that takes events in any order: batch status and sessions, with late rows in a table of their own.

Each key keeps its own clock: the latest event time it has seen, less ``delay``, is its horizon. What lies before the
horizon is settled and folded into a few values; what lies after it is kept as it came, so an event that arrives out of order
still takes its place. An event before the horizon comes too late to change anything and is put out as a late row: nothing
is dropped silently, and no key is held up or hurried by another one. An idle key settles by a timer and gives its state back, where the stream runs on.

Results are put out for every key a micro-batch touches and written by micro-batch; a repeated micro-batch overwrites
its own rows. The state of a key holds the events of ``delay`` at most, besides its unfinished items or open session;
a micro-batch meets a hot key in one task, with as many events as the files of the trigger hold.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexgrove.operators.status import ACTIVE_ITEMS, FAILED, READY

STATUS_ROWS = "kind string, change string, change_us long, change_seq long, active long, settled boolean, item string, us long, seq long, status string"
# ``active`` and ``waiting`` are JSON lists.
STATUS_STATE = "us long, seq long, change string, horizon long, active string, waiting string"
SESSION_ROWS = "kind string, start_us long, end_us long, n long, us long, seq long"
SESSION_STATE = "horizon long, open string"
# Kinds of rows that are put out.
STATE, CLOSED, OPEN, LATE = "state", "closed", "open", "late"


def micros(spec: str) -> int:
    """A duration such as ``2 hours`` in microseconds."""
    number, unit = spec.split()
    return int(float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000)


def follow(events, active: set, last: tuple | None) -> tuple | None:
    """Fold item events in time order: ``active`` changes in place, the last (us, seq, change) is returned.

    A batch turns ``processing`` when an item starts; when an item ends and none is left active it turns ``completed`` or
    ``failed`` by that item. Items that are not active need no memory: an ended item counts like one never seen.
    """
    for us, seq, item, status in events:
        if status in ACTIVE_ITEMS:
            active.add(item)
        else:
            active.discard(item)
        if status == "processing":
            last = (us, seq, "processing")
        elif not active and status in READY:
            last = (us, seq, "completed")
        elif not active and status in FAILED:
            last = (us, seq, "failed")
    return last


def _frame(key: tuple, rows: list[tuple], schema: str, key_name: str) -> pd.DataFrame:
    names = [key_name, *(c.split()[0] for c in schema.split(", "))]
    return pd.DataFrame([(*key, *r) for r in rows], columns=names, dtype=object)


def batch_steps(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, delay: int, idle_ms: int | None) -> Iterator[pd.DataFrame]:
    """Status of one batch from the events of its items: item, status, us, seq in any order, repeats allowed."""
    held = state.get if state.exists else (None,) * 6
    last = None if held[2] is None else (held[0], held[1], held[2])
    horizon, active, waiting = held[3], set(json.loads(held[4] or "[]")), {tuple(e) for e in json.loads(held[5] or "[]")}
    out = []
    if state.hasTimedOut:
        # An idle batch is settled as it stands; one without active items gives its state back.
        horizon = max([horizon, *(e[0] for e in waiting)])
        last = follow(sorted(waiting, key=_place), active, last)
        waiting = []
        if active:
            state.update((*(last or (None,) * 3), horizon, json.dumps(sorted(active, key=str)), "[]"))
        else:
            state.remove()
    else:
        for frame in frames:
            for event in zip(frame["us"].tolist(), frame["seq"].tolist(), frame["item"], frame["status"]):
                if horizon is not None and event[0] <= horizon:
                    out.append((LATE, None, None, None, None, None, event[2], event[0], event[1], event[3]))
                else:
                    waiting.add(event)
        waiting = sorted(waiting, key=_place)
        if waiting:
            horizon = max(waiting[-1][0] - delay, waiting[-1][0] - delay if horizon is None else horizon)
            done = [e for e in waiting if e[0] <= horizon]
            last, waiting = follow(done, active, last), waiting[len(done) :]
        state.update((*(last or (None,) * 3), horizon, json.dumps(sorted(active, key=str)), json.dumps(waiting)))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
    unsettled = set(active)
    change = follow(waiting, unsettled, last)
    us, seq, name = change or (None,) * 3
    out.append((STATE, name, us, seq, len(unsettled), change == last, None, None, None, None))
    yield _frame(key, out, STATUS_ROWS, "batch_id")


def _place(event: tuple) -> tuple:
    return event[0], event[1], str(event[2]), str(event[3])


def session_steps(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, name: str, gap: int, delay: int, idle_ms: int | None) -> Iterator[pd.DataFrame]:
    """Sessions of one key: events no further apart than ``gap`` belong together, wherever they stand in the stream."""
    horizon, spans = (state.get[0], [tuple(s) for s in json.loads(state.get[1])]) if state.exists else (None, [])
    if state.hasTimedOut:
        # Sessions of an idle key close; only its horizon stays.
        state.update((max([horizon, *(s[1] + gap for s in spans)]), "[]"))
        yield _frame(key, [(CLOSED, *s, None, None) for s in spans], SESSION_ROWS, name)
        return
    out = []
    for frame in frames:
        for us, seq in zip(frame["us"].tolist(), frame["seq"].tolist()):
            if horizon is not None and us <= horizon:
                out.append((LATE, None, None, None, us, seq))
            else:
                spans.append((us, us, 1))
    joined: list[tuple[int, int, int]] = []
    for start, end, n in sorted(spans):
        if joined and start - joined[-1][1] <= gap:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]), joined[-1][2] + n)
        else:
            joined.append((start, end, n))
    if joined:
        now = joined[-1][1] - delay
        horizon = now if horizon is None else max(horizon, now)
    closed = [s for s in joined if s[1] + gap <= horizon]
    joined = joined[len(closed) :]
    state.update((horizon, json.dumps(joined)))
    if joined and idle_ms:
        state.setTimeoutDuration(idle_ms)
    out += [(CLOSED, *s, None, None) for s in closed] + [(OPEN, *s, None, None) for s in joined]
    yield _frame(key, out, SESSION_ROWS, name)


def _start(rows: DataFrame, steps: Callable, key: str, columns: str, kept: str, out: str, checkpoint: str, idle: str | None, every: str) -> StreamingQuery:
    kind = rows.schema[key].dataType.simpleString()
    # Timers make Spark run on without new data, which a run over what is there must not do.
    timers = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    steps = partial(steps, idle_ms=micros(idle) // 1000 if idle else None)
    state = rows.groupBy(key).applyInPandasWithState(steps, f"{key} {kind}, {columns}", kept, "update", timers)

    def write(batch: DataFrame, batch_id: int) -> None:
        writer = batch.withColumn("micro_batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("micro_batch").parquet(out)

    query = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(processingTime=every) if idle else query.trigger(availableNow=True)).start()


def _timed(events: DataFrame, *columns: str) -> DataFrame:
    """Rows with their time in microseconds; events without a time stand at zero, those without a number come first."""
    number = F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq")
    return events.select(*columns, F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)).alias("us"), number)


def start_batch_status(events: DataFrame, out: str, checkpoint: str, delay: str = "2 days", idle: str | None = None, every: str = "1 minute") -> StreamingQuery:
    """Batch status over a stream of item events: batch_id, item_id, ts, seq, status.

    ``delay``: how much older than the batch's latest event an event may be. Without ``idle`` the stream takes what is there and
    ends. With it, it runs on, looks ``every`` so often, and a batch that had no events for that time settles as it stands and,
    when no item is active, gives its state back. A checkpoint belongs to one of the two.
    """
    rows = _timed(events, "batch_id", F.col("item_id").cast("string").alias("item"), "status")
    return _start(rows, partial(batch_steps, delay=micros(delay)), "batch_id", STATUS_ROWS, STATUS_STATE, out, checkpoint, idle, every)


def latest_batches(rows: DataFrame) -> DataFrame:
    """(batch_id, batch_status, active) from what the stream wrote.

    The last row of a batch counts, unless its state was given back before: then an earlier settled change may be the later one.
    """
    change = F.struct("change_us", "change_seq", "change")
    state = rows.where(F.col("kind") == STATE)
    known = F.col("change").isNotNull()
    last = state.groupBy("batch_id").agg(
        F.max_by(F.struct(change.alias("c"), "active"), "micro_batch").alias("last"),
        F.max(F.when(known & F.col("settled"), change)).alias("settled"),
    )
    best = F.greatest(F.when(F.col("last.c.change").isNotNull(), F.col("last.c")), F.col("settled"))
    return last.select("batch_id", F.coalesce(best["change"], F.lit("received")).alias("batch_status"), F.col("last.active").alias("active"))


def start_sessions(events: DataFrame, key: str, out: str, checkpoint: str, gap: str = "30 minutes", delay: str = "1 hour", idle: str | None = None, every: str = "1 minute") -> StreamingQuery:
    """Sessions per ``key`` over a stream of events with ts and seq; ``idle`` and ``every`` as for batch status."""
    steps = partial(session_steps, name=key, gap=micros(gap), delay=micros(delay))
    return _start(_timed(events, key), steps, key, SESSION_ROWS, SESSION_STATE, out, checkpoint, idle, every)


def sessions(rows: DataFrame, key: str) -> DataFrame:
    """(key, session_start, session_end, n): closed sessions, and those that were open when the key was last looked at."""
    span = F.struct("start_us", "end_us", "n")
    by_time = rows.groupBy(key, "micro_batch").agg(
        F.collect_list(F.when(F.col("kind") == OPEN, span)).alias("open"), F.count_if(F.col("kind") != LATE).alias("looked"),
    )
    # A micro-batch that brought late rows alone says nothing about open sessions.
    open_ = by_time.where("looked > 0").groupBy(key).agg(F.max_by("open", "micro_batch").alias("open")).select(key, F.inline("open"))
    closed = rows.where(F.col("kind") == CLOSED).select(key, "start_us", "end_us", "n")
    return closed.union(open_).select(key, F.timestamp_micros("start_us").alias("session_start"), F.timestamp_micros("end_us").alias("session_end"), "n")


def late_rows(rows: DataFrame, key: str) -> DataFrame:
    """Events that came after their time was settled."""
    own = [c for c in rows.columns if c in (key, "item", "seq", "status", "micro_batch")]
    return rows.where(F.col("kind") == LATE).select(*own, F.timestamp_micros("us").alias("ts"))

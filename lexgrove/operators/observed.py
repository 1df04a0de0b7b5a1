"""Counts that fall out of a job while it runs: no second pass over its input."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


def rows() -> Column:
    return F.count(F.lit(1))


class Counts:
    """Named counts of rows that pass chosen places of a plan; known once the job that reads the plan has run.

    A place counts what passes it in that job: use each counted DataFrame in one action only, or the first one decides.
    """

    def __init__(self) -> None:
        self._places: list[tuple[Observation, list[str]]] = []

    def at(self, df: DataFrame, **counts: Column) -> DataFrame:
        """``df``, counted as it passes: each of ``counts`` is an aggregate without distinct."""
        place = Observation()
        self._places.append((place, list(counts)))
        return df.observe(place, *(F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(name) for name, c in counts.items()))

    def get(self) -> dict[str, int]:
        """The counts; waits for the job. A place that an empty input removed from the plan counts nothing."""
        out: dict[str, int] = {}
        for place, names in self._places:
            # A place that fell out of the plan leaves a row without columns, which ``get`` cannot read.
            seen = place.get if place._jo.getRow().schema() is not None else {}
            out.update({n: int(seen.get(n) or 0) for n in names})
        return out


class StreamCounts(StreamingQueryListener):
    """Totals of the counts that streams observe under a name, and the same by micro-batch.

    Register it with ``spark.streams.addListener``. A micro-batch that is run again replaces what it counted before, also
    after a restart of the stream, as long as the listener lives.
    """

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._seen: dict[tuple[str, str, int], dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        with self._lock:
            for name, row in progress.observedMetrics.items():
                self._seen[name, str(progress.id), progress.batchId] = {k: int(v or 0) for k, v in row.asDict().items()}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def batches(self, name: str) -> dict[tuple[str, int], dict[str, int]]:
        with self._lock:
            return {key[1:]: dict(counts) for key, counts in self._seen.items() if key[0] == name}

    def totals(self, name: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for counts in self.batches(name).values():
            for k, v in counts.items():
                out[k] = out.get(k, 0) + v
        return out


def finish(query: StreamingQuery) -> None:
    """Wait for a stream that ends, and for its last progress to reach the listeners."""
    query.awaitTermination()
    query._jsq.sparkSession().sparkContext().listenerBus().waitUntilEmpty()

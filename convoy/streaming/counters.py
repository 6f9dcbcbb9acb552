"""Counters of a live job, gathered from the metrics that its queries observe."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(stream: DataFrame, name: str, **counts: Column) -> DataFrame:
    """The same rows; per micro-batch the sum of each count is reported under ``name``."""
    return stream.observe(name, *[F.sum(c.cast("long")).alias(k) for k, c in counts.items()])


class Counters(StreamingQueryListener):
    """Sums observed metrics and rows dropped as late, each micro-batch of a query once, also when it is run again."""

    def __init__(self):
        self._batches: dict[tuple[str, int], dict[str, int]] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        found = {}
        for name, row in progress.observedMetrics.items():
            for key, value in row.asDict().items():
                found[f"{name}.{key}"] = int(value or 0)
        found["late"] = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        with self._lock:
            self._batches[str(progress.id), progress.batchId] = found  # a batch run again replaces its counts

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            ended = self._ended.setdefault(str(event.runId), threading.Event())
        ended.set()

    def wait(self, query, seconds: float = 60) -> None:
        """Until the end of the query was reported; its last batch is reported before."""
        query.awaitTermination()
        with self._lock:
            ended = self._ended.setdefault(str(query.runId), threading.Event())
        ended.wait(seconds)

    def totals(self) -> dict[str, int]:
        with self._lock:
            out: dict[str, int] = {}
            for found in self._batches.values():
                for key, value in found.items():
                    out[key] = out.get(key, 0) + value
            return out

    def table(self, spark: SparkSession) -> DataFrame:
        """counter, rows."""
        return spark.createDataFrame(sorted(self.totals().items()), "counter string, rows long")

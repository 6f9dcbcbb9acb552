"""Streaming operators that need state.

Sliding-window rules need no code of their own: ``rules.sustained_alerts`` runs unchanged on a
frame with a watermark, and so do the row rules and ``quality.judge``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from convoy.operators.rules import keep

WATERMARK = "5 seconds"
DEDUP_SPAN = "1 hour"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_event_time(stream: DataFrame, column: str = "event_time", delay: str = WATERMARK) -> DataFrame:
    """Watermarked stream; rows without tenant or time are dropped. Zoneless times are read as UTC."""
    zoned = stream.withColumn(column, F.col(column).cast("timestamp"))
    return zoned.filter(F.col("tenant").isNotNull() & F.col(column).isNotNull()).withWatermark(column, delay)


def drop_duplicates(stream: DataFrame, keys: list[str], column: str = "event_time", span: str = DEDUP_SPAN) -> DataFrame:
    """First message per key within ``span`` of event time; later copies are dropped for good."""
    return stream.withWatermark(column, span).dropDuplicatesWithinWatermark(keys)


class PairProcessor(StatefulProcessor):
    """Adjacent matching events of one key, in event-time order, closer than ``within_us``.

    Rows wait in a buffer until the watermark has passed them, so the buffer holds no more than
    the watermark delay. What remains per key is the last event's time, whether it matched, and
    the length of the current run. Rows, not frames, and one state value: a key has few events, and
    each frame and each call to the store costs more than they do. Times are microseconds.
    """

    def __init__(self, within_us: int, skip: str):
        self.within_us = within_us
        self.every = skip == "next_row"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "last_us bigint, length bigint, waiting string")

    def _get(self) -> tuple[int, int, list]:
        last, length, waiting = self.known.get() or (0, 0, "[]")
        return last, length, json.loads(waiting)

    def _put(self, last: int, length: int, waiting: list, wake: list) -> None:
        self.known.update((last, length, json.dumps(waiting)))
        if wake:
            self.handle.registerTimer(min(row[0] for row in wake) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [list(row[3:]) for row in rows]  # event_us, seq, matched, dtc
        if fresh:
            last, length, waiting = self._get()
            self._put(last, length, waiting + fresh, fresh)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        last, length, rows = self._get()
        ready = sorted((r for r in rows if r[0] < limit), key=itemgetter(0, 1))
        found = []
        for us, _, matched, dtc in ready:
            near = length > 0 and us - last < self.within_us
            length = (length + 1 if near else 1) if matched else 0
            last = us
            if length >= 2 and (self.every or length % 2 == 0):
                found.append(Row(vin=key[0], tenant=key[1], dtc=dtc, detected_us=us))
        if ready:
            later = [r for r in rows if r[0] >= limit]
            self._put(last, length, later, later)
        yield from found

    def close(self) -> None:
        pass


def misfire_recurrence(stream: DataFrame, within_seconds: int = 600, skip: str = "past_last", match: Column | None = None) -> DataFrame:
    """Streaming form of ``pattern.misfire_recurrence`` on a watermarked stream.

    Only EVENT rows are keyed by vehicle, a small share of the traffic. Needs the RocksDB state store.
    """
    if match is None:
        match = (F.col("event_type") == "DTC_SET") & F.col("dtc").rlike("^P030[0-8]$")
    events = keep(stream, F.col("msg_type") == "EVENT", "event_time").select(
        "vin", "tenant", "event_time", F.unix_micros("event_time").alias("event_us"), "seq", F.coalesce(match, F.lit(False)).alias("matched"), "dtc"
    )
    pairs = events.groupBy("vin", "tenant").transformWithState(
        statefulProcessor=PairProcessor(within_seconds * 1_000_000, skip),
        outputStructType="vin string, tenant string, dtc string, detected_us bigint",
        outputMode="append", timeMode="eventTime",
    )
    return pairs.select(
        "vin", "tenant", F.lit("misfire").alias("failure_type"), F.lit("critical").alias("severity"),
        F.lit("realtime").alias("source"), F.array("dtc").alias("dtc_codes"), F.timestamp_micros("detected_us").alias("detected_at"),
    )

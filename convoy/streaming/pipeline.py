"""From raw messages to stored telemetry, alerts and latest state."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from convoy import schemas as S
from convoy.operators import quality, rules
from convoy.streaming import counters, sinks, state
from convoy.streaming import operators as so


@dataclass
class Paths:
    base: str
    checkpoints: str = field(default="")

    def __post_init__(self):
        self.checkpoints = self.checkpoints or f"{self.base}/_checkpoints"

    def data(self, name: str) -> str:
        return f"{self.base}/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.checkpoints}/{name}"


def route_batch(paths: Paths, shards: int, shard=quality.md5_shard):
    """From one parse of a micro-batch: dead letters, counts by reason, accepted messages."""

    def write(batch: DataFrame, number: int) -> None:
        judged = quality.narrowed(quality.judge(batch, shards, shard=shard)).persist()
        try:
            messages = quality.accepted(judged, *[c for c in ("arrival",) if c in batch.columns])
            sinks.write_batch(quality.quarantined(judged), paths.data("dead_letters"), number, "reason")
            sinks.write_batch(quality.reason_counts(judged), paths.data("counters"), number)
            sinks.write_batch(messages, paths.data("accepted"), number)
        finally:
            judged.unpersist()

    return write


def alert_stream(
    timed: DataFrame, window: str = "30 seconds", slide: str = "5 seconds", within_seconds: int = 600, skip: str = "past_last"
) -> DataFrame:
    """The firings of all ten rules on a watermarked stream of flat messages, as one stream."""
    raised = [
        rules.row_alerts(timed, rules.ROW_RULES + rules.ELEMENT_RULES),
        rules.sustained_alerts(timed, rules.SUSTAINED_RULES, window=window, slide=slide),
        so.misfire_recurrence(timed, within_seconds, skip),
    ]
    return raised[0].unionByName(raised[1]).unionByName(raised[2])


def alert_batch(paths: Paths, vehicles: str):
    """Alerts of known vehicles with vehicle id and owner's tenant, and counts of unknown VINs. The vehicle table is read
    anew in each batch, so a vehicle that was added a moment ago is known."""

    def write(batch: DataFrame, number: int) -> None:
        fleet = batch.sparkSession.read.parquet(vehicles)
        batch = batch.persist()
        try:
            # what closing windows and waiting pairs give comes out of state in a batch without input, which Spark takes for empty:
            # merged, else it would broadcast all of these alerts
            sinks.write_batch(rules.enrich_alerts(batch.hint("merge"), fleet), paths.data("alerts"), number, "tenant")
            sinks.write_batch(rules.unknown_alerts(batch, fleet), paths.data("unknown_vins"), number)
        finally:
            batch.unpersist()

    return write


def store_batch(paths: Paths):
    """Deduplicated messages into the FAST table, the HEALTH table and the lake, by day."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            day = F.to_date("event_time").alias("dt")
            for kind, fields in (("FAST", S.FAST_FIELDS), ("HEALTH", S.HEALTH_FIELDS)):
                rows = batch.filter(F.col("msg_type") == kind).select(
                    F.col("event_time").alias("ts"), "vin", "tenant", "seq", *[f"payload.{n}" for n, _ in fields], day
                )
                sinks.write_days(rows, paths.data(f"telemetry_{kind.lower()}"), number)
            sinks.write_days(sinks.lake_rows(batch), paths.data("lake"), number)
        finally:
            batch.unpersist()

    return write


def start_routing(raw: DataFrame, paths: Paths, shards: int, once: bool = False) -> StreamingQuery:
    """``raw`` (topic, value and perhaps arrival) into dead letters, counts and accepted messages."""
    return sinks.start(raw, paths.checkpoint("route"), route_batch(paths, shards), once, name="route")


def start_pipeline(accepted: DataFrame, paths: Paths, vehicles: str, once: bool = False, order: tuple[str, ...] = ("arrival", "seq"), **rule_times) -> list[StreamingQuery]:
    """The live layer on the stream of accepted messages (nested payload, ``event_time``, the order columns).

    Rules read the stream before duplicates are dropped, stored tables after. The twin drops stale messages itself; the
    archive holds what it accepted. With ``once`` a query starts when the one before has ended: together they would hold the
    stores and kept batches of all at a time. Metrics: ``store.received``, ``store.unique`` (as one minus the other, duplicates and
    late rows), ``twin.accepted``, ``twin.stale``, ``alerts.raised``.
    """
    accepted.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", so.ROCKSDB)
    one = F.lit(1)
    flat = so.with_event_time(accepted).select("*", "payload.*").drop("payload")
    alerts = counters.observed(alert_stream(flat, **rule_times), "alerts", raised=one)
    named = counters.observed(accepted.filter("tenant IS NOT NULL AND event_time IS NOT NULL"), "store", received=one)
    stored = counters.observed(so.drop_duplicates(named, ["vin", "seq"]), "kept", unique=one)
    changes = counters.observed(state.twin_changes(accepted, list(order), archive=True), "twin", accepted=F.col("accepted"), stale=F.col("stale"))
    started = []
    for name, stream, writer in (
        ("alerts", alerts, alert_batch(paths, vehicles)),
        ("store", stored, store_batch(paths)),
        ("twin", changes, state.store_changes(paths.data("twin"), S.PAYLOAD_FIELDS, paths.data("archive"), S.MESSAGE_SCHEMA)),
    ):
        started.append(sinks.start(stream, paths.checkpoint(name), writer, once, name=name))
        if once:
            started[-1].awaitTermination()
    return started


def accepted_stream(spark, paths: Paths, arrival: bool = True, files: int = 1000) -> DataFrame:
    """The accepted messages that routing wrote, as a stream of at most so many files a micro-batch."""
    schema = S.MESSAGE_SCHEMA + (", arrival long" if arrival else "")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(paths.data("accepted")).withColumn("event_time", F.col("ts"))

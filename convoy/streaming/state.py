"""The live twin as keyed state: what a vehicle is known by lives in the state store, and a batch writes only changes.

A micro-batch costs what it names. Its messages are applied to the state of their vehicles and each vehicle that changed
gives one row, its whole new document with a revision number. The view of the fleet is the newest revision per vehicle:
a stored view plus the change batches after it. ``fold_changes`` makes a new view and removes what no reader needs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from convoy.streaming import sinks

#: Times inside JSON documents, to the microsecond.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
CHANGES = ("vin string, tenant string, updated_us long, last_msg_type string, last_seqs string, document string, revision long, "
           "accepted long, stale long, messages array<string>")
_STATE = "tenant string, updated_us long, last_msg_type string, last_seqs string, document string, revision long"


_place = itemgetter(0)


class TwinProcessor(StatefulProcessor):
    """Folds the messages of one vehicle, in arrival order, into its document.

    A message counts if its number is above all earlier ones of its kind; the others are only counted as stale. All rows
    of a vehicle in one micro-batch are in memory, as many as the source's limit per trigger lets in. Rows, not
    frames: a frame per vehicle cost more than its messages. The state is read once and written once per vehicle.
    """

    def __init__(self, order: list[str], archive: bool):
        self.order = order
        self.archive = archive

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        arrived = []
        for row in rows:
            head, _, message = row[1].partition("\n")
            head = json.loads(head)
            arrived.append((tuple((c not in head, head.get(c)) for c in self.order), head, message))
        arrived.sort(key=_place)
        tenant, updated, last_kind, seqs, document, revision = self.known.get() or (None, None, None, "{}", "{}", 0)
        highest, fields, kept = json.loads(seqs), json.loads(document), []
        for _, head, message in arrived:
            kind, seq = head["msg_type"], head["seq"]
            if kind in highest and seq <= highest[kind]:
                continue
            tenant = head.get("tenant") if revision == 0 and not kept else tenant
            highest[kind], updated, last_kind = seq, head["event_us"], kind
            fields.update(json.loads(message).get("payload") or {})  # fields that are null are not in the text
            kept.append(message)
        if kept:
            revision += 1
            seqs, document = json.dumps(highest), json.dumps(fields)
            self.known.update((tenant, updated, last_kind, seqs, document, revision))
        yield Row(
            vin=key[0], tenant=tenant, updated_us=updated, last_msg_type=last_kind, last_seqs=seqs, document=document,
            revision=revision, accepted=len(kept), stale=len(arrived) - len(kept), messages=kept if self.archive else [])

    def close(self) -> None:
        pass


def twin_changes(messages: DataFrame, order: list[str], ts: str = "event_time", archive: bool = False) -> DataFrame:
    """Messages (vin, tenant, msg_type, seq, ``ts``, nested payload, order columns) -> one row per vehicle that a batch names.

    ``accepted`` is 0 where all its messages were stale. With ``archive`` the row carries the accepted messages as JSON.
    Messages without vin, kind, number or time are left out. Needs the RocksDB state store.
    """
    whole = F.to_json(F.struct(*[c for c in messages.columns if c not in order or c == "seq"]), TIMES).alias("message")
    named = messages.filter(F.col("vin").isNotNull() & F.col("msg_type").isNotNull() & F.col("seq").isNotNull() & F.col(ts).isNotNull())
    head = F.struct(*dict.fromkeys([*order, "msg_type", "seq", "tenant"]), F.unix_micros(F.col(ts).cast("timestamp")).alias("event_us"))
    rows = named.select("vin", F.concat(F.to_json(head, TIMES), F.lit("\n"), whole).alias("entry"))  # a value costs more to hand over than to read
    return rows.groupBy("vin").transformWithState(
        statefulProcessor=TwinProcessor(order, archive), outputStructType=CHANGES, outputMode="append", timeMode="none")


def documents(changes: DataFrame, fields: list[tuple[str, str]], kinds: tuple[str, ...] = ("FAST", "HEALTH", "EVENT")) -> DataFrame:
    """Change rows with their document as typed columns: vin, tenant, updated_at, last_msg_type, last_seq_*, the fields, revision."""
    parsed = changes.withColumn("_d", F.from_json("document", ", ".join(f"{n} {t}" for n, t in fields), TIMES)).withColumn("_s", F.from_json("last_seqs", "map<string,bigint>"))
    return parsed.select(
        "vin", "tenant", F.timestamp_micros("updated_us").alias("updated_at"), "last_msg_type",
        *[F.col("_s")[k].alias(f"last_seq_{k.lower()}") for k in kinds], *[F.col(f"_d.{n}").alias(n) for n, _ in fields], "revision")


def store_changes(base: str, fields: list[tuple[str, str]], archive: str | None = None, schema: str | None = None):
    """Batch writer: changed documents, and the accepted messages (of this ``schema``) in ``archive``."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            sinks.write_batch(documents(batch.filter("accepted > 0"), fields), f"{base}/changes", number)
            if archive:
                each = batch.select(F.explode("messages").alias("message")).select(F.from_json("message", schema, TIMES).alias("_m")).select("_m.*")
                sinks.write_batch(sinks.archived(each), archive, number)
        finally:
            batch.unpersist()

    return write


def _newest(rows: DataFrame) -> DataFrame:
    """Newest revision per vehicle; reduced in the map tasks."""
    best = rows.groupBy("vin").agg(F.max_by(F.struct(*rows.columns), "revision").alias("_r"))
    return best.select("_r.*")


def current_twin(spark: SparkSession, base: str) -> DataFrame | None:
    """The view of the fleet: the stored view and the change batches after it; None before the first batch."""
    views, batches = sinks.versions(spark, f"{base}/view"), sinks.batches(spark, f"{base}/changes")
    after = [b for b in batches if not views or b > views[-1]]
    parts = [spark.read.parquet(f"{base}/view/version={views[-1]}")] if views else []
    parts += [spark.read.parquet(*[f"{base}/changes/batch={b}" for b in after])] if after else []
    if not parts:
        return None
    return parts[0] if views and not after else _newest(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))


def fold_changes(spark: SparkSession, base: str) -> int | None:
    """Makes the view up to the newest batch and returns its number. Two views stay, and the batches after the older of
    them, so a reader that began with it loses no file. Run it as often as a day's changes are too many to read along."""
    batches = sinks.batches(spark, f"{base}/changes")
    views = sinks.versions(spark, f"{base}/view")
    if not batches or (views and views[-1] >= batches[-1]):
        return views[-1] if views else None
    sinks.publish(current_twin(spark, base), f"{base}/view", batches[-1], keep=2)
    oldest = sinks.versions(spark, f"{base}/view")[0]
    for done in [b for b in batches if b <= oldest and oldest != batches[-1]]:
        sinks.remove(spark, f"{base}/changes/batch={done}")
    return batches[-1]

"""Validation of raw messages: one reason column, accepted and quarantined rows, counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy import schemas as S
from convoy.functions import codes
from convoy.functions.shard import md5_shard
from convoy.operators.scan import once

TOPIC = r"\Afleet/([^/]+)/shard-([0-9]+)/([^/]+)/telemetry\z"
ZONED = r"(Z|z|[+-][0-9]{2}(:?[0-9]{2})?)\z"
# Reasons in the order in which they are tested; the first failing test counts.
REASONS = ["bad_topic", "shard_mismatch", "bad_json", "topic_vin_mismatch", "schema_invalid"]

# every scalar is first read as text, then converted; this is the lenient conversion of numbers in quotes
_TEXT_ENVELOPE = "vin string, msg_type string, seq string, ts string, fw_version string, schema_ver string, driver_token string, payload string, _bad string"
_TEXT_TYPES = {"array<double>": "array<string>", "array<string>": "array<string>", "map<string,double>": "map<string,string>"}
_TEXT_PAYLOAD = ", ".join(f"{n} {_TEXT_TYPES.get(t, 'string')}" for n, t in S.PAYLOAD_FIELDS)


def _whole(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(number == F.floor(number), number.cast("decimal(38,0)").try_cast("bigint"))


def _converted(name: str, kind: str) -> Column:
    raw = F.col(f"_p.{name}")
    if kind == "double":
        return raw.try_cast("double")
    if kind == "int":
        return _whole(raw).try_cast("int")
    if kind == "boolean":
        return raw.try_cast("boolean")
    if kind == "array<double>":
        return F.transform(raw, lambda x: x.try_cast("double"))
    if kind == "map<string,double>":
        return F.transform_values(raw, lambda _, v: v.try_cast("double"))
    return raw


def _field_ok(name: str, kind: str, required: bool) -> Column:
    raw, value = F.col(f"_p.{name}"), _converted(name, kind)
    if kind == "array<double>":
        ok = F.forall(value, lambda x: x.isNotNull())
    elif kind == "map<string,double>":
        ok = F.forall(F.map_values(value), lambda x: x.isNotNull())
    else:
        ok = value.isNotNull()
        low, high = S.BOUNDS.get(name, (None, None))
        if low is not None:
            ok = ok & (value >= low)
        if high is not None:
            ok = ok & (value <= high)
    ok = F.coalesce(ok, F.lit(False))
    return ok if required else raw.isNull() | ok


def _all(conditions: list[Column]) -> Column:
    result = F.lit(True)
    for condition in conditions:
        result = result & condition
    return result


def _payload_ok() -> Column:
    """Required fields, types, ranges and codes of the payload that ``msg_type`` announces."""
    pads = F.forall(_converted("brake_pad_pct", "array<double>"), lambda x: x.between(0, 100))
    active = F.col("_p.active_dtc")
    fast = _all([_field_ok(n, t, n in S.FAST_REQUIRED) for n, t in S.FAST_FIELDS])
    heading = F.col("_p.heading").try_cast("double")
    fast = fast & F.coalesce((heading >= 0) & (heading < 360), F.lit(False))
    health = _all([_field_ok(n, t, n in S.HEALTH_REQUIRED) for n, t in S.HEALTH_FIELDS if n != "active_dtc"])
    health = health & F.coalesce(pads, F.lit(False)) & (active.isNull() | F.forall(active, codes.dtc_valid))
    kind, dtc = F.col("_p.event_type"), F.col("_p.dtc")
    event = F.coalesce(kind.isin(S.EVENT_TYPES), F.lit(False)) & (dtc.isNull() | codes.dtc_valid(dtc))
    event = event & ~(F.coalesce(kind.isin("DTC_SET", "DTC_CLEARED"), F.lit(False)) & dtc.isNull())
    event = event & _field_ok("freeze_frame", "map<string,double>", False) & _field_ok("value", "double", False)
    announced = F.col("_m.msg_type")
    return F.when(announced == "FAST", fast).when(announced == "HEALTH", health).when(announced == "EVENT", event).otherwise(F.lit(False))


def _envelope_ok() -> Column:
    ts = F.col("_m.ts")
    return _all(
        [
            codes.vin_valid(F.col("_m.vin")),
            F.coalesce(_whole(F.col("_m.seq")) >= 0, F.lit(False)),
            F.coalesce(ts.rlike(ZONED), F.lit(False)) & F.try_to_timestamp(ts).isNotNull(),
            F.col("_m.fw_version").isNotNull(),
            F.col("_m.schema_ver").isNull() | _whole(F.col("_m.schema_ver")).isNotNull(),
            F.col("_p").isNotNull(),
        ]
    )


def judge(raw: DataFrame, shards: int, topic: str = "topic", value: str = "value", shard: Callable[[Column, int], Column] = md5_shard) -> DataFrame:
    """Adds ``reason`` (NULL when accepted), ``detail``, ``tenant`` and the parsed message.

    Purely column expressions: no shuffle, one pass, the same on a table and on a stream.
    """
    address = F.col(topic)
    parsed = raw.withColumns(
        {
            "_text": F.col(value).cast("string"),
            "_tenant": F.regexp_extract(address, TOPIC, 1),
            "_shard": F.regexp_extract(address, TOPIC, 2).try_cast("int"),
            "_vin": F.regexp_extract(address, TOPIC, 3),
        }
    )
    parsed = once(parsed, "_m", F.from_json("_text", _TEXT_ENVELOPE, {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}))
    parsed = once(parsed, "_p", F.from_json("_m.payload", _TEXT_PAYLOAD))
    known = F.coalesce(address.rlike(TOPIC), F.lit(False))
    right_shard = F.coalesce(F.col("_shard") == shard(F.col("_vin"), shards), F.lit(False))
    # every field of the envelope is read as text, so only malformed JSON counts as corrupt
    # The parser stops after the first value. In an array that must end with a mark the text cannot hold (its own
    # digest) and have two elements, anything before or after the message shows.
    mark = F.md5("_text")
    pair = F.from_json(F.concat(F.lit("["), F.col("_text"), F.lit(',"'), mark, F.lit('"]')), "array<string>", {"allowSingleQuotes": "false"})
    alone = F.get(F.filter(F.transform(F.array(pair), lambda a: (F.size(a) == 2) & (F.get(a, 1) == mark)), lambda x: x.isNotNull()), 0)
    is_object = F.col("_m._bad").isNull() & F.coalesce(F.col("_text").rlike(r"^[ \t\r\n]*\{") & alone, F.lit(False))
    reason = (
        F.when(~known, REASONS[0])
        .when(~right_shard, REASONS[1])
        .when(~is_object, REASONS[2])
        .when(~F.coalesce(F.col("_m.vin") == F.col("_vin"), F.lit(False)), REASONS[3])
        .when(~(_envelope_ok() & _payload_ok()), REASONS[4])
    )
    detail = (
        F.when(F.col("reason").isin(REASONS[0], REASONS[1]), address)
        .when(F.col("reason") == REASONS[3], F.concat_ws(" != ", "_vin", F.coalesce("_m.vin", F.lit("none"))))
        .when(F.col("reason") == REASONS[4], F.concat_ws(" ", "_m.msg_type", "_m.seq"))
        .otherwise(F.lit(""))
    )
    return once(parsed, "reason", reason).withColumn("detail", detail)


def narrowed(judged: DataFrame, value: str = "value") -> DataFrame:
    """The same for ``accepted``, ``quarantined`` and ``reason_counts`` with what they read, for keeping: of an accepted row the
    parsed message, of another one its text."""
    good = F.col("reason").isNull()
    return judged.withColumns(
        {"_text": F.when(~good, F.col("_text")), "_m": F.when(good, F.col("_m").dropFields("payload", "_bad")), "_p": F.when(good, F.col("_p"))}
    ).drop(value, "_shard", "_vin")


def accepted(judged: DataFrame, *keep: str) -> DataFrame:
    """Typed messages of the declared schema, with the tenant from the topic."""
    payload = F.struct(
        *[
            (F.when(F.col("_m.msg_type") == "HEALTH", F.coalesce(_converted(n, t), F.array().cast(t))) if n == "active_dtc" else _converted(n, t)).alias(n)
            for n, t in S.PAYLOAD_FIELDS
        ]
    )
    return judged.filter(F.col("reason").isNull()).select(
        F.col("_m.vin").alias("vin"), F.col("_m.msg_type").alias("msg_type"), _whole(F.col("_m.seq")).alias("seq"),
        F.try_to_timestamp("_m.ts").alias("ts"), F.col("_m.fw_version").alias("fw_version"),
        F.coalesce(_whole(F.col("_m.schema_ver")).cast("int"), F.lit(1)).alias("schema_ver"),
        F.col("_m.driver_token").alias("driver_token"), F.col("_tenant").alias("tenant"), payload.alias("payload"), *keep,
    )


def quarantined(judged: DataFrame, topic: str = "topic") -> DataFrame:
    """Dead letters; write them partitioned by ``reason``."""
    return judged.filter(F.col("reason").isNotNull()).select(
        F.col(topic).alias("source_topic"), "reason", "detail", F.col("_text").alias("raw")
    )


def reason_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("messages"))


def flatten(messages: DataFrame) -> DataFrame:
    """Envelope plus payload fields as top-level columns, with ``event_time`` = ``ts``."""
    return messages.select("vin", "msg_type", "seq", F.col("ts").alias("event_time"), "fw_version", "schema_ver", "driver_token", "tenant", "payload.*")

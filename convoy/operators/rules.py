"""Alert rules as data, evaluated together in one pass over the telemetry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.schemas import MISFIRE_CODES

ALERT_COLUMNS = ["vin", "tenant", "failure_type", "severity", "source", "dtc_codes", "detected_at"]


@dataclass(frozen=True)
class Rule:
    """Fires once per row, or once per element of array ``each`` (named ``x`` in ``when``)."""

    failure_type: str
    msg_type: str
    when: str
    codes: tuple[str, ...] = ()
    codes_from: str | None = None
    each: str | None = None
    severity: str = "critical"
    source: str = "realtime"


@dataclass(frozen=True)
class SustainedRule:
    """Fires for a sliding window in which every sample of ``signal`` is above ``above``."""

    failure_type: str
    msg_type: str
    signal: str
    above: float
    codes: tuple[str, ...] = ()
    severity: str = "critical"
    source: str = "realtime"


_MISFIRE_SQL = ", ".join(f"'{c}'" for c in MISFIRE_CODES)

# The single-reading, per-element and sustained rules with their thresholds.
ROW_RULES = [
    Rule("lubrication", "FAST", "oil_kpa < 100 AND rpm > 0", ("P0520", "P0521", "P0522", "P0523", "P0524")),
    Rule("12v_battery", "HEALTH", "charge_v < 12.5D", ("P0562", "P0615")),
    Rule("misfire", "HEALTH", f"mil_on AND arrays_overlap(active_dtc, array({_MISFIRE_SQL}))", codes_from="active_dtc"),
    Rule("ev_battery", "HEALTH", "cell_temp_max_c > 60", ("P0A80", "P0AFA")),
]
ELEMENT_RULES = [
    Rule("brake_wear", "HEALTH", "x < 20", ("C0750",), each="brake_pad_pct"),
    Rule("tyre", "HEALTH", "x < 550", ("C0750",), each="tire_kpa"),
    Rule("tyre", "HEALTH", "x > 60", ("C0750",), each="tire_c"),
]
SUSTAINED_RULES = [
    SustainedRule("cooling", "FAST", "coolant_c", 110.0, ("P0128", "P0217")),
    SustainedRule("transmission", "FAST", "trans_c", 130.0, ("P0700", "P0730")),
]

# Thresholds of the daily, type-blind baseline (they differ from the rules above).
BASELINE_CHECKS = [
    "max_coolant_c > 110", "min_oil_kpa < 40", "min_charge_v < 12.5D", "min_brake_pad_pct < 8",
    "max_trans_c > 130", "min_tire_kpa < 550", "max_cell_temp_c > 60",
]


def keep(df: DataFrame, condition: Column, ts: str) -> DataFrame:
    """Filter; on a stream it stays above the watermark, so that all messages move event time forward.

    A predicate that mentions the event time is not pushed below the watermark. On a table the
    plain predicate is used, which reaches the scan.
    """
    return df.filter(F.when(F.col(ts).isNotNull(), condition)) if df.isStreaming else df.filter(condition)


def _alert(failure_type: str, severity: str, source: str, codes: Column) -> Column:
    return F.struct(
        F.lit(failure_type).alias("failure_type"), F.lit(severity).alias("severity"),
        F.lit(source).alias("source"), codes.alias("dtc_codes"),
    )


def _code_array(codes: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(c) for c in codes]).cast("array<string>")


def _hits(rule: Rule) -> Column:
    """Array holding one alert per firing of the rule on this row."""
    codes = F.col(rule.codes_from) if rule.codes_from else _code_array(rule.codes)
    alert = _alert(rule.failure_type, rule.severity, rule.source, codes)
    own_type = F.col("msg_type") == rule.msg_type
    if rule.each:
        bad = F.coalesce(F.expr(f"filter({rule.each}, x -> {rule.when})"), F.expr(f"filter({rule.each}, x -> false)"))
        fired = F.transform(bad, lambda _: alert)
        return F.when(own_type & fired.isNotNull(), fired).otherwise(F.filter(F.array(alert), lambda a: F.lit(False)))
    return F.filter(F.array(alert), lambda a: F.coalesce(own_type & F.expr(rule.when), F.lit(False)))


def row_alerts(df: DataFrame, rules: list[Rule], ts: str = "event_time", keep: tuple[str, ...] = ()) -> DataFrame:
    """All firings of all ``rules`` with a single scan and no shuffle; no dedup across rules."""
    kinds = sorted({r.msg_type for r in rules})
    fired = F.explode(F.concat(*[_hits(r) for r in rules]))
    return df.filter(F.col("msg_type").isin(kinds)).select("vin", "tenant", *keep, fired.alias("_a"), F.col(ts).alias("detected_at")).select(
        "vin", "tenant", *keep, "_a.failure_type", "_a.severity", "_a.source", "_a.dtc_codes", "detected_at"
    )


def sustained_alerts(
    df: DataFrame,
    rules: list[SustainedRule],
    ts: str = "event_time",
    window: str = "30 seconds",
    slide: str = "5 seconds",
    min_samples: int = 1,
) -> DataFrame:
    """Sliding-window minimum per vehicle for all rules at once; detected at the window's end.

    Works on batch and (after ``withWatermark``) streaming frames. The minimum is combined on
    the map side, so overlapping windows cost one row per task and window in the shuffle. With
    ``min_samples=1`` a lone hot sample fires in every window that covers it.
    """
    signals = sorted({r.signal for r in rules})
    kinds = sorted({r.msg_type for r in rules})
    present = F.coalesce(*[F.col(s) for s in signals]).isNotNull()
    grouped = (
        keep(df, F.col("msg_type").isin(kinds) & present, ts)
        .groupBy("vin", "tenant", F.window(ts, window, slide).alias("_w"))
        .agg(
            *[F.min(F.when(F.col("msg_type") == r.msg_type, F.col(r.signal))).alias(f"_min_{i}") for i, r in enumerate(rules)],
            *[F.count(F.when(F.col("msg_type") == r.msg_type, F.col(r.signal))).alias(f"_n_{i}") for i, r in enumerate(rules)],
        )
    )
    fired = [
        F.when(
            (F.col(f"_min_{i}") > r.above) & (F.col(f"_n_{i}") >= min_samples),
            _alert(r.failure_type, r.severity, r.source, _code_array(r.codes)),
        )
        for i, r in enumerate(rules)
    ]
    return grouped.select(
        "vin", "tenant", F.explode(F.filter(F.array(*fired), lambda a: a.isNotNull())).alias("_a"),
        F.col("_w.end").alias("detected_at"),
    ).select("vin", "tenant", "_a.failure_type", "_a.severity", "_a.source", "_a.dtc_codes", "detected_at")


def baseline_flag(df: DataFrame, out: str = "baseline", checks: list[str] | None = None) -> DataFrame:
    """1 when a trouble code is active or any threshold is strictly breached; NULL is no breach."""
    breach = F.coalesce(F.col("any_dtc_today") > 0, F.lit(False))
    for check in checks or BASELINE_CHECKS:
        breach = breach | F.coalesce(F.expr(check), F.lit(False))
    return df.withColumn(out, breach.cast("int"))


def enrich_alerts(alerts: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Alerts of known vehicles with the vehicle's id and *its* tenant.

    The vehicle table is broadcast only when Spark measures it below its threshold; otherwise
    the join shuffles and a vehicle with very many alerts is split by the skew-join rule.
    """
    known = vehicles.select("vin", "vehicle_id", F.col("tenant").alias("_owner"))
    return alerts.join(known, "vin").withColumn("tenant", F.col("_owner")).drop("_owner")


def unknown_alerts(alerts: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Alert counts of VINs without a vehicle; counted per VIN before the join."""
    counts = alerts.groupBy("vin").agg(F.count(F.lit(1)).alias("alerts"))
    return counts.join(vehicles.select("vin"), "vin", "left_anti")

"""Recurrence pattern: two adjacent matching events of a key within a time limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoy.operators.scan import same

SKIP_POLICIES = ("past_last", "next_row")


def recurring(
    events: DataFrame,
    keys: list[str],
    ts: str,
    order: list[str],
    match: Column,
    within: str,
    chunk: Column,
    skip: str = "past_last",
) -> DataFrame:
    """Rows that complete a pair ``A A`` of adjacent events with ``later - earlier < within``.

    A non-matching event, or a wait of ``within`` or longer, ends the current run of matches.
    ``past_last`` reports disjoint pairs (every even position of a run), ``next_row`` every
    position from the second on. Positions are counted inside time chunks, in parallel also for
    one busy key; one summary row per chunk then tells how long the run was that reached into it.
    NULL keys and chunks count as values.
    """
    if skip not in SKIP_POLICIES:
        raise ValueError(f"skip must be one of {SKIP_POLICIES}")
    ordering = [F.col(c) for c in order]
    point = F.struct(F.col(ts).alias("ts"), F.col("_match").alias("match"))
    near = F.expr(f"INTERVAL {within}")
    window = Window.partitionBy("_at").orderBy(*ordering)
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.withColumn("_match", F.coalesce(match, F.lit(False))).withColumn(
        "_at", F.struct(same(*keys).alias("key"), chunk.alias("chunk"))
    )
    rows = rows.withColumns({"_prev": F.lag(point).over(window), "_index": F.row_number().over(window)})
    continues = F.col("_match") & F.col("_prev.match") & (F.col(ts) - F.col("_prev.ts") < near)
    rows = rows.withColumn("_start", F.when(~F.coalesce(continues, F.lit(False)), F.col("_index")))
    rows = rows.withColumn("_run_start", F.max("_start").over(so_far))
    rows = rows.withColumns(
        {
            "_place": F.when(F.col("_match"), F.col("_index") - F.col("_run_start") + 1).otherwise(0).cast("long"),
            # the run that begins with the chunk's first event may have begun in an earlier chunk
            "_leading": F.col("_match") & (F.col("_run_start") == 1),
        }
    ).drop("_prev", "_start", "_run_start")
    reaching = _run_lengths_before(rows, ordering, point, near)
    position = F.col("_place") + F.when(F.col("_leading"), F.col("_reaching")).otherwise(0)
    hit = F.col("_match") & (F.col("_position") >= 2)
    if skip == "past_last":
        hit = hit & (F.col("_position") % 2 == 0)
    return (
        rows.join(reaching, "_at")
        .withColumn("_position", position)
        .filter(hit)
        .drop("_match", "_at", "_index", "_place", "_leading", "_reaching", "_position")
    )


def _run_lengths_before(rows: DataFrame, ordering: list[Column], point: Column, near: Column) -> DataFrame:
    """Per chunk the length of the run of earlier chunks that its first event continues, else 0."""
    at = F.struct(*ordering)
    ends = rows.groupBy("_at").agg(
        F.min_by(point, at).alias("_first"), F.max_by(F.struct(point.alias("point"), "_place", "_leading"), at).alias("_last")
    )
    by_chunk = Window.partitionBy("_at.key").orderBy("_at.chunk")
    before = F.lag("_last").over(by_chunk)
    linked = F.col("_first.match") & F.col("_before.point.match") & (F.col("_first.ts") - F.col("_before.point.ts") < near)
    linked_ends = ends.withColumn("_before", before).withColumn("_linked", F.coalesce(linked, F.lit(False)))
    # a chunk that is one single linked run passes the length on; any other chunk starts a new sum
    passes = F.col("_linked") & F.col("_last._leading")
    groups = linked_ends.withColumn(
        "_group", F.sum(F.when(passes, 0).otherwise(1)).over(by_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    in_group = Window.partitionBy("_at.key", "_group").orderBy("_at.chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lengths = groups.withColumn("_length", F.sum("_last._place").over(in_group))
    return lengths.select(
        "_at", F.when(F.col("_linked"), F.lag("_length").over(by_chunk)).otherwise(0).alias("_reaching")
    )


def misfire_recurrence(
    df: DataFrame,
    chunk: Column,
    ts: str = "event_time",
    tie: str = "seq",
    within: str = "10 MINUTES",
    skip: str = "past_last",
) -> DataFrame:
    """Alert rows for repeated misfire codes (P0300-P0308) set on one vehicle."""
    events = df.filter(F.col("msg_type") == "EVENT").select("vin", "tenant", ts, tie, "event_type", "dtc")
    match = (F.col("event_type") == "DTC_SET") & F.col("dtc").rlike("^P030[0-8]$")
    hits = recurring(events, ["vin", "tenant"], ts, [ts, tie], match, within, chunk, skip)
    return hits.select(
        "vin", "tenant", F.lit("misfire").alias("failure_type"), F.lit("critical").alias("severity"),
        F.lit("realtime").alias("source"), F.array("dtc").alias("dtc_codes"), F.col(ts).alias("detected_at"),
    )

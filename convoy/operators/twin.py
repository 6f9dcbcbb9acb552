"""Latest state per vehicle, folded from all its messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.operators.dedup import drop_stale, first_arrival


def fold_twin(
    messages: DataFrame,
    fields: list[str],
    order: list[str],
    chunk: Column,
    key: str = "vin",
    kind: str = "msg_type",
    seq: str = "seq",
    ts: str = "event_time",
    kinds: tuple[str, ...] = ("FAST", "HEALTH", "EVENT"),
) -> DataFrame:
    """One row per key: newest non-null value of every field among accepted messages.

    A message is accepted if its ``seq`` exceeds all earlier arrivals of the same key and kind.
    The fold itself is an aggregation (``max_by`` on arrival), so a key with most of the rows
    is reduced in every map task before anything is shuffled.
    """
    ordering = [F.col(c) for c in order]
    accepted = drop_stale(messages, [key, kind], seq, ordering, chunk)
    arrived = F.struct(*ordering) if len(order) > 1 else ordering[0]

    def newest(column: Column) -> Column:
        return F.max_by(column, F.when(column.isNotNull(), arrived))

    return accepted.groupBy(key).agg(
        F.min_by("tenant", arrived).alias("tenant"),
        F.max_by(ts, arrived).alias("updated_at"),
        F.max_by(kind, arrived).alias("last_msg_type"),
        *[F.max(F.when(F.col(kind) == k, F.col(seq))).alias(f"last_seq_{k.lower()}") for k in kinds],
        *[newest(F.col(f)).alias(f) for f in fields],
    )


def merge_latest(old: DataFrame | None, new: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert of whole rows: the newest per key of the stored and the incoming table."""
    both = new if old is None else old.unionByName(new, allowMissingColumns=True)
    return first_arrival(both, [key], [F.col(order).desc_nulls_last()])


def vehicle_state(twin: DataFrame, keys: DataFrame, key: str = "vin") -> DataFrame:
    """Latest state of the requested vehicles."""
    return twin.join(keys.select(key).distinct(), key, "left_semi")

"""Ordered running values that stay parallel when one key holds most of the rows.

``Window.partitionBy(key)`` puts a whole key into one task. Here a key's history is cut into
chunks (usually spans of time). Each chunk is first reduced to one row by an ordinary
aggregation with map-side combine, the small per-chunk rows are scanned per key, and the
carried-in value is joined back. Full rows are only ever grouped by ``(key, chunk)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row however often it is used.

    The optimizer would copy a plain projection into every expression that refers to it, and
    parse or hash the same text again each time. It does not move expressions across a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def same(*columns: str | Column) -> Column:
    """One value that equals itself also where a column is NULL: a key to group, window and join by."""
    return F.struct(F.lit(True).alias("_"), *columns)


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min, "last": F.last}


def time_chunk(ts: Column, width: str) -> Column:
    """Start of the span of ``width`` that holds ``ts``."""
    return F.window(ts, width).getField("start")


def number_chunk(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width))


def carried(
    df: DataFrame, keys: list[str], chunk: str, partials: dict[str, tuple[Column, str]], descending: bool = False
) -> DataFrame:
    """One row per (keys, chunk) with each partial combined over all *earlier* chunks.

    ``partials`` maps an output name to (aggregate, combine), combine being sum, max, min or last.
    """
    per_chunk = df.groupBy(*keys, chunk).agg(*[agg.alias(name) for name, (agg, _) in partials.items()])
    direction = F.col(chunk).desc() if descending else F.col(chunk).asc()
    earlier = Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.select(
        *keys, chunk, *[_COMBINE[how](name).over(earlier).alias(name) for name, (_, how) in partials.items()]
    )


def chunk_window(keys: list[str], chunk: str, order: list[Column]):
    return Window.partitionBy(*keys, chunk).orderBy(*order)


def running_max_before(
    df: DataFrame, keys: list[str], chunk: str, order: list[Column], value: str, out: str
) -> DataFrame:
    """Adds ``out``: the largest ``value`` among strictly earlier rows of the key (NULL for the first).

    NULL keys and chunks count as values. The window inside chunks comes first: it leaves the rows
    partitioned and sorted by ``_same``, so the join with the carried values needs neither a shuffle
    nor a sort of them.
    """
    carry = carried(df, keys, chunk, {"_carried": (F.max(value), "max")}).select(same(*keys, chunk).alias("_same"), "_carried")
    inside = Window.partitionBy("_same").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_same", same(*keys, chunk))
        .withColumn("_inside", F.max(value).over(inside))
        .join(carry, "_same")
        .withColumn(out, F.greatest("_inside", "_carried"))
        .drop("_inside", "_carried", "_same")
    )

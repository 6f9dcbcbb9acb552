"""Array helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sibling_delta(values: Column) -> Column:
    """Largest gap between one element and the mean of the others; NULL below two elements."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    gap = F.array_max(F.transform(values, lambda v: F.abs(v - (total - v) / (n - 1))))
    return F.when(F.coalesce(n, F.lit(0)) >= 2, gap)


def non_empty(values: Column) -> Column:
    """1 when the array has an element; NULL and empty arrays count as 0."""
    return (F.coalesce(F.size(values), F.lit(0)) > 0).cast("int")


def array_literal(values: Column) -> Column:
    """Array rendered as ``{a,b}`` text."""
    return F.replace(F.replace(F.to_json(values), F.lit("["), F.lit("{")), F.lit("]"), F.lit("}"))


def guarded_ratio(numerator: Column, denominator: Column, above: float) -> Column:
    """``numerator / denominator`` where the denominator exceeds ``above``, else NULL."""
    return F.when(denominator > above, numerator / denominator)

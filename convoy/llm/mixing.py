"""Mixing sources to target weights by hash thresholds.

Every document has a 60-bit hash of its id and text, and a source takes all documents below its threshold. Thresholds
come from histograms: size by (source, bucket of the hash), the bucket in which the running sum crosses the budget,
then the same inside that bucket only. Nothing is sorted but histogram rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoy.llm.common import WORD, stored

#: The hash has 60 bits; two histogram levels take 12 bits each, the rest is resolved by value.
LEVEL_BITS = 12
HASH_BITS = 60
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of md5 over id and text, as a long."""
    joined = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float, cap: float, weights=WEIGHTS) -> DataFrame:
    """(source, source_size) -> plus ``target``: weights by rank of the source name (code points, null last).

    Targets are proportional to the weights but end at ``cap`` times the source; what is above is shared again. In the
    order of cap * size / weight the first sources are capped; with k of them capped the level of the others is
    (budget - their caps) / (weight of the others), and the right k is the first whose level is below the next cap.
    One row per source goes through the windows, never a document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(wheel, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("ratio", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        F.lit(float(share)) * F.sum("source_size").over(everything)
        - F.coalesce(F.lit(float(cap)) * F.sum("source_size").over(before), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("level", level)
    fit = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return leveled.withColumn("fit", fit).select(
        "source", "source_size",
        F.least(F.coalesce(F.col("fit") * F.col("weight"), F.lit(float(cap)) * F.col("source_size")),
                F.lit(float(cap)) * F.col("source_size")).alias("target"),
    )


def _cell(bits: int) -> Column:
    return F.shiftright(F.col("hash"), HASH_BITS - bits)


def _crossing(histogram: DataFrame, cell: str) -> DataFrame:
    """(source, budget, <cell>, size) -> the cell in which the running size passes the budget, and the size before it."""
    run = Window.partitionBy("source").orderBy(cell)
    running = histogram.withColumn("through", F.sum("size").over(run))
    return running.where((F.col("through") > F.col("budget")) & (F.col("through") - F.col("size") <= F.col("budget"))).select(
        F.col("source").alias("s"), F.col(cell).alias("c"), F.col("budget").alias("b"), (F.col("through") - F.col("size")).alias("base"),
        F.col("size").alias("here"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, hash, size) and (source, budget) -> (source, ``below``): documents with a hash under it are taken.

    The value at the boundary is taken if that comes nearer to the budget. Sources without a crossing take all.
    """
    g = goals.select(F.col("source").alias("gs"), "budget")
    near = sized.join(g, F.col("source").eqNullSafe(F.col("gs")))
    level = _crossing(near.groupBy("source", "budget", _cell(LEVEL_BITS).alias("cell")).agg(F.sum("size").alias("size")), "cell")
    for bits in (2 * LEVEL_BITS, HASH_BITS):
        above = bits - LEVEL_BITS if bits < HASH_BITS else 2 * LEVEL_BITS
        inside = sized.join(level, F.col("source").eqNullSafe(F.col("s")) & (_cell(above) == F.col("c")))
        cells = inside.groupBy("source", F.col("b"), F.col("base"), _cell(bits).alias("cell")).agg(F.sum("size").alias("size"))
        level = _crossing(cells.withColumn("budget", F.col("b") - F.col("base")).drop("b", "base"), "cell")
    over = F.col("base") + F.col("here") - F.col("b") < F.col("b") - F.col("base")
    return goals.join(level, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", F.when(F.col("s").isNull(), F.lit(1 << HASH_BITS)).otherwise(F.col("c") + F.when(over, 1).otherwise(0)).alias("below"))


def plan(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """(source, hash, size) -> one row per source: ps (the source), source_size, target, rounds, budget, below."""
    goals = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap, weights).withColumn(
        "rounds", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(0)
    ).withColumn("budget", F.col("target") - F.col("rounds") * F.col("source_size")), "mix-targets")
    below = thresholds(sized, goals.select("source", "budget")).select(F.col("source").alias("ps"), "below")
    picked = goals.join(below, F.col("source").eqNullSafe(F.col("ps")))
    return stored(picked.select(F.col("source").alias("ps"), "source_size", "target", "rounds", "budget", "below"), "mix-thresholds")


def copies(hash_: Column) -> Column:
    """How often the mix takes a document, beside the columns of :func:`plan`."""
    again = (F.col("budget") > 0) & (hash_ < F.col("below"))
    return (F.col("rounds") + F.when(again, 1).otherwise(0)).cast("long")


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                              mix_hash(F.col(doc_id), F.col(text)).alias("hash")), "mix-sizes")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, cap: float = 2.0,
        weights=WEIGHTS) -> DataFrame:
    """One row per input row: doc_id, source, hash, size, source_size, target, copies (times the mix takes it), taken.

    Whole documents are taken, each ``floor`` or ``ceil`` of target / source size times. Null texts and texts without a
    word have size 0 and add nothing; a null source is a source of its own; rows equal in id and text share a hash and
    are taken together; an empty table gives an empty table. Columns other than the three named play no part.
    """
    sized = sizes(docs, doc_id, text, source)
    picked = plan(sized, share, cap, weights)
    return sized.join(picked, F.col("source").eqNullSafe(F.col("ps"))).withColumn("copies", copies(F.col("hash"))).select(
        "doc_id", "source", "hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, cap: float = 2.0,
             weights=WEIGHTS) -> DataFrame:
    """The mixture itself: the rows of ``docs`` with all their columns, each as often as the mix takes it."""
    picked = plan(sizes(docs, doc_id, text, source), share, cap, weights)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("rs"),
                       mix_hash(F.col(doc_id), F.col(text)).alias("rh"))
    taken = rows.join(picked, F.col("rs").eqNullSafe(F.col("ps"))).select("row", copies(F.col("rh")).alias("n")).where("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


#: DuckDB form of :func:`mix` as the query returns it.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')), 1, 15) AS BIGINT) AS hash
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM sizes),
ratios AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM weighed),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
    - coalesce(2.0::DOUBLE * sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
  FROM ratios),
fit AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, level LIMIT 1),
goals AS (
  SELECT source, source_size, least(coalesce((SELECT level FROM fit) * weight, 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size) AS target FROM levels),
rounds AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 2) ELSE 0 END AS rounds FROM goals),
budgets AS (SELECT *, target - rounds * source_size AS budget FROM rounds),
groups AS (SELECT source, hash, sum(size) AS here FROM sized GROUP BY source, hash),
running AS (
  SELECT source, hash, here, sum(here) OVER (PARTITION BY source ORDER BY hash) AS through FROM groups),
more AS (
  SELECT r.source, r.hash, b.budget > 0 AND (r.through <= b.budget
    OR (r.through - r.here <= b.budget AND r.through - b.budget < b.budget - (r.through - r.here))) AS again
  FROM running r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source)
SELECT s.doc_id, s.size, b.source_size, b.target, CAST((b.rounds + CASE WHEN m.again THEN 1 ELSE 0 END) * s.size AS BIGINT) AS taken
FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
JOIN more m ON m.source IS NOT DISTINCT FROM s.source AND m.hash = s.hash
"""

"""Scoring quality: average precision, best threshold, precision at k, cost.

Rows are folded to distinct scores first. The cumulative counts over descending scores are
then carried across score chunks, so no task ever sorts all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoy.operators.scan import carried, same

# Cost of a breakdown and of an inspection.
COST_BREAKDOWN = 150_000
COST_INSPECTION = 3_000
DEFAULT_THRESHOLD = 0.5
MIN_LEAD_DAYS = 5


def score_chunk(score: Column) -> Column:
    """Span of a score in [0, 1]: even steps above 1/16, steps of equal ratio for the many tiny scores below."""
    small = F.floor(F.log2(score) * F.lit(64.0)) - 100_000
    return F.when(score >= 1 / 16, F.floor(score * F.lit(4096.0))).when(score > 0, small).otherwise(F.lit(-1_000_000))


def score_curve(scored: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Per distinct score: rows and positives at it, above it (``*_above``), and in total."""
    points = (
        scored.groupBy(*by, score)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
        .withColumn("_chunk", score_chunk(F.col(score)))
    )
    above = carried(
        points, by, "_chunk", {"_n0": (F.sum("n"), "sum"), "_p0": (F.sum("pos"), "sum")}, descending=True
    )
    above = above.select(same(*by, "_chunk").alias("_same"), "_n0", "_p0")
    window = Window.partitionBy("_same").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    points = points.withColumn("_same", same(*by, "_chunk"))
    inside = points.withColumns({"_n1": F.sum("n").over(window), "_p1": F.sum("pos").over(window)})
    return inside.join(above, "_same").withColumns(
        {
            "n_above": F.coalesce(F.col("_n1"), zero) + F.coalesce(F.col("_n0"), zero),
            "pos_above": F.coalesce(F.col("_p1"), zero) + F.coalesce(F.col("_p0"), zero),
        }
    ).drop("_chunk", "_same", "_n0", "_p0", "_n1", "_p1")


def _with(rows: DataFrame, per_group: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the columns of their group; a NULL group is a group."""
    values = per_group.select(same(*by).alias("_same"), *[c for c in per_group.columns if c not in by])
    return rows.withColumn("_same", same(*by)).join(values, "_same").drop("_same")


def _totals(curve: DataFrame, by: list[str]) -> DataFrame:
    return curve.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("n").alias("rows"))


def average_precision(scored: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Sum over distinct scores of (recall step) x (precision at that score); NULL without positives."""
    curve = score_curve(scored, by, score, label)
    precision = (F.col("pos_above") + F.col("pos")) / (F.col("n_above") + F.col("n"))
    return curve.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")).alias("average_precision"),
        F.sum("pos").alias("positives"), F.sum("n").alias("rows"),
    )


def best_f1(scored: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Threshold with the highest F1 (lowest such threshold on ties); 0.5 without positives."""
    curve = score_curve(scored, by, score, label)
    curve = _with(curve, _totals(curve, by).drop("rows"), by)
    tp = F.col("pos_above") + F.col("pos")
    precision = tp / (F.col("n_above") + F.col("n"))
    recall = F.try_divide(tp, F.col("positives"))
    f1 = F.when(precision + recall > 0, F.lit(2.0) * precision * recall / (precision + recall + F.lit(1e-12))).otherwise(0.0)
    return (
        curve.withColumn("_f1", F.coalesce(f1, F.lit(0.0)))
        .groupBy(*by)
        .agg(
            F.max_by(score, F.struct("_f1", -F.col(score))).alias("_best"),
            F.max("_f1").alias("f1"), F.max("positives").alias("positives"),
        )
        .select(
            *by,
            F.when(F.col("positives") == 0, F.lit(DEFAULT_THRESHOLD)).otherwise(F.col("_best")).alias("threshold"),
            "f1", "positives",
        )
    )


def top_k(
    scored: DataFrame, by: list[str], tie: str, tie_chunk: Column, k: int | None = None,
    score: str = "score", label: str = "label",
) -> DataFrame:
    """The ``k`` rows with the highest scores per group (``k=None``: as many as there are positives).

    The curve tells the score of the k-th row. Rows above it are taken as they are; only the
    rows that tie with it are ranked, by ``tie``, in chunks that do not decrease along ``tie``.
    """
    curve = score_curve(scored, by, score, label)
    wanted = F.col("positives") if k is None else F.lit(k).cast("long")
    totals = _totals(curve, by).select(*by, F.least(wanted, F.col("rows")).alias("_k"))
    cut = (
        _with(curve, totals, by)
        .filter((F.col("n_above") < F.col("_k")) & (F.col("n_above") + F.col("n") >= F.col("_k")))
        .select(*by, F.col(score).alias("_cut"), (F.col("_k") - F.col("n_above")).alias("_room"))
    )
    near = _with(scored, cut, by).filter(F.col(score) >= F.col("_cut")).withColumn("_chunk", tie_chunk)
    tied = near.filter(F.col(score) == F.col("_cut"))
    before = carried(tied, by, "_chunk", {"_seen": (F.count(F.lit(1)), "sum")})
    placed = tied.withColumn("_same", same(*by, "_chunk"))
    placed = placed.withColumn("_place", F.row_number().over(Window.partitionBy("_same").orderBy(tie)))
    before = before.select(same(*by, "_chunk").alias("_same"), "_seen")
    rank = F.col("_place") + F.coalesce(F.col("_seen"), F.lit(0))
    taken = placed.join(before, "_same").filter(rank <= F.col("_room"))
    above = near.filter(F.col(score) > F.col("_cut"))
    return above.select(*scored.columns).unionByName(taken.select(*scored.columns))


def precision_at_k(
    scored: DataFrame, by: list[str], tie: str, tie_chunk: Column, k: int | None = None,
    score: str = "score", label: str = "label",
) -> DataFrame:
    """Share of positives among the ``k`` highest scores."""
    chosen = top_k(scored, by, tie, tie_chunk, k, score, label)
    return chosen.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.col(label).cast("long")).alias("hits"), F.avg(label).alias("precision_at_k")
    )


def classification(scored: DataFrame, by: list[str], flag: Column, label: Column, lead: Column | None = None, min_lead: int = MIN_LEAD_DAYS) -> DataFrame:
    """Precision, recall (0 where undefined) and recall among positives at least ``min_lead`` days ahead."""
    hit, truth = flag.cast("boolean"), label.cast("boolean")
    tp, fp, fn = F.count_if(hit & truth), F.count_if(hit & ~truth), F.count_if(~hit & truth)
    outputs = [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
    ]
    if lead is not None:
        early = truth & F.coalesce(lead >= min_lead, F.lit(False))
        outputs.append(F.try_divide(F.count_if(early & hit), F.count_if(early)).alias("recall_at_lead"))
    return scored.groupBy(*by).agg(*outputs)


def cost_saved(scored: DataFrame, by: list[str], flag: Column, label: Column) -> DataFrame:
    """True alarms save a breakdown minus an inspection; false alarms cost an inspection."""
    hit, truth = flag.cast("boolean"), label.cast("boolean")
    saved = F.count_if(hit & truth) * (COST_BREAKDOWN - COST_INSPECTION) - F.count_if(hit & ~truth) * COST_INSPECTION
    return scored.groupBy(*by).agg(saved.alias("saved"))


def widest_risk(df: DataFrame, columns: list[str], risk: str = "fleet_risk", top: str = "top_type") -> DataFrame:
    """Highest of several score columns and its name (the first column on ties)."""
    best = F.greatest(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])
    name = F.lit(None).cast("string")
    for c in reversed(columns):
        name = F.when(F.col(c) == F.col(risk), F.lit(c)).otherwise(name)
    return df.withColumn(risk, best).withColumn(top, name)


def metrics_report(metrics: DataFrame, title: str) -> DataFrame:
    """Markdown table of a small metrics table, one line per row, as text rows in order."""
    names = metrics.columns
    head = [f"# {title}", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
    body = metrics.select(F.lit(len(head)).alias("part"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    spark = metrics.sparkSession
    header = spark.range(1).select(F.posexplode(F.array(*[F.lit(h) for h in head])).alias("part", "line"))
    return header.unionByName(body).orderBy("part", "line").select("line")

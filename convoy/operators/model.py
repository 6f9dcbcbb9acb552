"""Per-type classifiers, calibration, backtest and feature importance.

The procedure: one shallow, slow learner per failure type with early stopping, all types grown together
(``boosting``), sigmoid calibration on the validation split, thresholds by best F1, and the evaluation of ``evaluate``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoy.operators import boosting, evaluate
from convoy.operators.features import lead_days
from convoy.operators.rules import baseline_flag
from convoy.operators.scan import carried, chunk_window

# Training settings.
MIN_CALIBRATION_ROWS = 10
IMPORTANCE_REPEATS = 5
LABEL = "any_failure_label"


@dataclass
class TypeModel:
    """A fitted classifier with optional sigmoid calibration; ``trees`` is None without rows of both kinds."""

    failure_type: str
    trees: boosting.Boosted | None
    slope: float | None = None
    offset: float | None = None

    def score(self, df: DataFrame, vector: str = "features") -> DataFrame:
        return score(df, {self.failure_type: self}, vector)

    def probability(self, margin: Column) -> Column:
        """The margin itself without a calibration."""
        calibrated = margin if self.slope is None else margin * F.lit(self.slope) + F.lit(self.offset)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-calibrated))


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out).transform(df)


def train(
    inputs: DataFrame, types: list[str], max_iter: int = boosting.ROUNDS, depth: int = boosting.DEPTH, step: float = boosting.STEP,
    min_leaf: int = boosting.MIN_LEAF, seed: int = 42, patience: int = boosting.PATIENCE,
) -> dict[str, TypeModel]:
    """One model per type from rows with ``split`` (train, validate), ``features`` and ``failure_type``.

    A tenth of the training rows, chosen by hash, decides how many trees are kept: boosting goes on until the loss on
    those rows has not fallen for ``patience`` trees, and the model has the trees up to the lowest loss.
    """
    held = F.pmod(F.xxhash64("vin", "day", F.lit(seed)), F.lit(10)) == 0
    rows = inputs.withColumns({"x": vector_to_array("features"), "y": F.array_position(F.lit(types), F.col("failure_type")) - 1})
    grown = boosting.fit(
        rows.filter("split = 'train'"), len(types), held=held, rounds=max_iter, depth=depth, step=step, min_leaf=min_leaf, patience=patience
    )
    models = {name: TypeModel(name, trees) for name, trees in zip(types, grown)}
    fitted = [m for m in models.values() if m.trees is not None]
    if not fitted:
        return models
    validate = rows.filter("split = 'validate'").select(boosting.margins(F.col("x"), [m.trees for m in fitted]).alias("m"), "failure_type").checkpoint()
    counts = {r["failure_type"]: r["n"] for r in validate.groupBy("failure_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    for i, model in enumerate(fitted):
        yes = counts.get(model.failure_type, 0)
        if yes >= MIN_CALIBRATION_ROWS and sum(counts.values()) - yes >= MIN_CALIBRATION_ROWS:
            hit = F.col("failure_type").eqNullSafe(model.failure_type).cast("double")
            curve = validate.select(array_to_vector(F.array(F.col("m")[i])).alias("margin"), hit.alias("label"))
            line = LogisticRegression(featuresCol="margin", labelCol="label").fit(curve)
            model.slope, model.offset = float(line.coefficients[0]), float(line.intercept)
    return models


def score(df: DataFrame, models: dict[str, TypeModel], vector: str = "features") -> DataFrame:
    """One score column per type, 0 for a type without a model; one Arrow pass for all types."""
    fitted = [m for m in models.values() if m.trees is not None]
    scores = {name: F.lit(0.0) for name in models}
    if fitted:
        df = df.withColumn("_margins", boosting.margins(vector_to_array(vector), [m.trees for m in fitted]))
        scores |= {m.failure_type: m.probability(F.col("_margins")[i]) for i, m in enumerate(fitted)}
    return df.withColumns(scores).drop("_margins")


def long_form(scored: DataFrame, types: list[str]) -> DataFrame:
    """(row, type): score and whether the row's vehicle fails with that type."""
    pair = F.explode(F.array(*[F.struct(F.lit(t).alias("model"), F.col(t).alias("score")) for t in types]))
    return scored.withColumn("_p", pair).withColumns(
        {"model": F.col("_p.model"), "score": F.col("_p.score"), "label": (F.col("failure_type") == F.col("_p.model")).cast("int")}
    ).drop("_p")


def type_metrics(validated: DataFrame, tested: DataFrame, types: list[str]) -> DataFrame:
    """Per type: threshold, average precision, precision, recall, recall at lead, and the baseline's."""
    thresholds = evaluate.best_f1(long_form(validated, types), ["model"]).select("model", "threshold")
    test = long_form(baseline_flag(tested), types).join(thresholds, "model")
    chosen = F.col("score") >= F.col("threshold")
    ours = evaluate.classification(test, ["model"], chosen, F.col("label"), lead=F.col("days_to_failure"))
    base = evaluate.classification(test, ["model"], F.col("baseline"), F.col("label")).select(
        "model", F.col("precision").alias("baseline_precision"), F.col("recall").alias("baseline_recall")
    )
    ranked = evaluate.average_precision(test, ["model"]).select("model", "average_precision")
    return thresholds.join(ours, "model").join(base, "model").join(ranked, "model")


def fleet_metrics(tested: DataFrame, types: list[str], thresholds: dict[str, float], tie_chunk_width: float = 1000.0, k: int = 100) -> DataFrame:
    """Fleet-wide: precision at k by widest risk and the money saved by model and baseline.

    ``row_id`` must be a unique whole number; it breaks ties between equal risks.
    """
    flagged = F.lit(False)
    for name in types:
        flagged = flagged | (F.col(name) >= F.lit(thresholds[name]))
    rows = evaluate.widest_risk(baseline_flag(tested), types).withColumns(
        {"scope": F.lit("fleet"), "flagged": flagged.cast("int"), "score": F.col("fleet_risk"), "label": F.col(LABEL)}
    )
    top = evaluate.precision_at_k(rows, ["scope"], "row_id", F.floor(F.col("row_id") / F.lit(tie_chunk_width)), k)
    model = evaluate.cost_saved(rows, ["scope"], F.col("flagged"), F.col("label")).withColumnRenamed("saved", "saved_model")
    base = evaluate.cost_saved(rows, ["scope"], F.col("baseline"), F.col("label")).withColumnRenamed("saved", "saved_baseline")
    return top.join(model, "scope").join(base, "scope")


def backtest(snapshot: DataFrame, types: list[str], tie_chunk_width: float = 1000.0, cuts: tuple[float, ...] = (0.5, 0.2)) -> DataFrame:
    """What happened after the as-of day to the vehicles scored on it.

    Precision among as many vehicles as really failed, right type among the hits, flagged and
    caught per cut, and the mean error of the lead estimate for the vehicles that failed.
    """
    will_fail = F.col("days_to_failure").isNotNull()
    estimate = lead_days(F.col("failure_type"))
    rows = evaluate.widest_risk(snapshot, types).withColumns(
        {"scope": F.lit("fleet"), "score": F.col("fleet_risk"), "label": will_fail.cast("int"), "_estimate": F.when(will_fail, estimate)}
    )
    chosen = evaluate.top_k(rows, ["scope"], "row_id", F.floor(F.col("row_id") / F.lit(tie_chunk_width)))
    hit = F.col("label") == 1
    top = chosen.groupBy("scope").agg(
        F.avg("label").alias("precision_at_k"),
        F.try_divide(F.count_if(hit & (F.col("top_type") == F.col("failure_type"))), F.count_if(hit)).alias("type_correct"),
    )
    outcome = []
    for cut in cuts:
        over = F.col("fleet_risk") >= cut
        name = str(cut).replace(".", "_")
        outcome += [F.count_if(over).alias(f"flagged_{name}"), F.count_if(over & hit).alias(f"caught_{name}")]
    overall = rows.groupBy("scope").agg(
        F.count(F.lit(1)).alias("vehicles"), F.sum("label").alias("failed"), *outcome,
        F.count("_estimate").alias("lead_n"), F.avg(F.abs(F.col("_estimate") - F.col("days_to_failure"))).alias("lead_mae"),
    )
    return overall.join(top, "scope", "left")


def _placed(rows: DataFrame, by: list[str], order: Column, out: str) -> DataFrame:
    """Places of the rows of a group in an order by a 64-bit hash, ranked chunk by chunk."""
    ranked = rows.withColumns({"_order": order, "_chunk": F.shiftright(order, 48)})
    before = carried(ranked, by, "_chunk", {"_before": (F.count(F.lit(1)), "sum")})
    inside = ranked.withColumn("_in", F.row_number().over(chunk_window(by, "_chunk", [F.col("_order"), F.col("n")])))
    return inside.join(before, [*by, "_chunk"]).withColumn(out, F.col("_in") + F.coalesce(F.col("_before"), F.lit(0))).drop("_order", "_chunk", "_in", "_before")


def permutation_importance(tested: DataFrame, model: TypeModel, columns: list[str], rows: int | None = None, repeats: int = IMPORTANCE_REPEATS, seed: int = 42) -> DataFrame:
    """Mean drop of average precision when one input is shuffled among the rows.

    All rows, or the ``rows`` with the smallest hashes if the caller asks for a sample. Every (input,
    repeat) draws its own order of the rows by another hash; a row gets the input of the row that has
    its place in that order. Orders are ranked in hash chunks, and all shuffled copies are scored in one job.
    """
    hashed = tested.withColumn("n", F.xxhash64("vin", "day", F.lit(seed)))
    if rows is not None:
        hashed = hashed.orderBy("n").limit(rows)
    sample = (
        hashed.select(
            "n", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"),
            (F.col("failure_type") == model.failure_type).cast("int").alias("label"),
        )
    )
    trials = F.explode(F.array(*[F.lit(i) for i in range(len(columns))])).alias("f")
    copies = sample.select("n", "x", "label", trials).select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("r"))
    value_of = F.element_at("x", F.col("f") + 1)
    placed = _placed(copies, ["f", "r"], F.col("n"), "place")
    donors = _placed(copies.withColumn("donor", value_of), ["f", "r"], F.xxhash64("n", "f", "r", F.lit(seed)), "place").select("f", "r", "place", "donor")
    shuffled = placed.join(donors, ["f", "r", "place"])
    value = F.col("donor")
    mixed = shuffled.withColumn("x", F.transform("x", lambda v, i: F.when(i == F.col("f"), value).otherwise(v)))
    base = sample.withColumns({"f": F.lit(-1), "r": F.lit(0)}).select("n", "f", "r", "x", "label")
    every = base.unionByName(mixed.select("n", "f", "r", "x", "label")).withColumn("features", array_to_vector("x"))
    scored = model.score(every).withColumn("score", F.col(model.failure_type))
    quality = evaluate.average_precision(scored, ["f", "r"])
    names = F.array(*[F.lit(c) for c in columns])
    per_input = quality.groupBy("f").agg(F.avg("average_precision").alias("ap"))
    with_base = per_input.withColumn("base", F.max(F.when(F.col("f") == -1, F.col("ap"))).over(Window.partitionBy(F.lit(0))))
    return with_base.filter("f >= 0").select(
        F.element_at(names, F.col("f") + 1).alias("feature"), (F.col("base") - F.col("ap")).alias("importance")
    )

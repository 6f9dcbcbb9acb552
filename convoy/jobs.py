"""Batch jobs over stored tables: python -m convoy.jobs JOB --help (or through spark-submit)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy import catalogue
from convoy.operators import evaluate, features, model, risk, rollup
from convoy.schemas import FAILURE_TYPES
from convoy.session import build_session, ensure_checkpoint_dir
from convoy.sources import readers
from convoy.streaming import pipeline, sinks, state


def run_features(spark: SparkSession, fast: str, health: str, labels: str, out: str) -> DataFrame:
    """Nightly features from the stored telemetry and the label file; returns the counts."""
    table = features.feature_table(spark.read.parquet(fast), spark.read.parquet(health), readers.failure_labels(spark, labels))
    table.write.mode("overwrite").parquet(out)
    return features.feature_counts(spark.read.parquet(out))


def run_rollup(spark: SparkSession, fast: str, out: str, now: str) -> None:
    rollup.write_refreshed(spark.read.parquet(fast), out, F.lit(now).cast("timestamp"), ts="ts")


def run_training(
    spark: SparkSession, table: str, vehicles: str, out: str, version: str, as_of: str | None = None, max_iter: int = 300,
    types: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Trains, evaluates, backtests and scores; writes metrics, a text report and predictions under ``out``."""
    ensure_checkpoint_dir(spark)
    types = types or FAILURE_TYPES
    inputs = model.assemble(features.model_inputs(readers.features(spark, table)), features.FEATURES)
    inputs = inputs.withColumn("row_id", F.xxhash64("vin", "day")).checkpoint()
    day = features.as_of_date(inputs, override=as_of).first()["as_of"]
    known = features.knowable_as_of(inputs, F.lit(day))
    cuts = features.split_cuts(known).first()
    known = known.withColumn("split", features.split_name(F.col("day"), F.lit(cuts["train_cut"]), F.lit(cuts["validate_cut"])))
    models = model.train(known, types, max_iter=max_iter)
    scored = model.score(known, models).checkpoint()  # read by every metric
    validated, tested = scored.filter("split = 'validate'"), scored.filter("split = 'test'")
    model.type_metrics(validated, tested, types).write.mode("overwrite").parquet(f"{out}/type_metrics")
    per_type = spark.read.parquet(f"{out}/type_metrics")
    thresholds = {r["model"]: r["threshold"] for r in per_type.collect()}  # one row per type
    width = float(2**54)  # row ids are 64-bit hashes
    limits = {t: thresholds.get(t, evaluate.DEFAULT_THRESHOLD) for t in types}
    model.fleet_metrics(tested, types, limits, width).write.mode("overwrite").parquet(f"{out}/fleet_metrics")
    snapshot = model.score(inputs.filter(F.col("day") == F.lit(day)), models).checkpoint()
    model.backtest(snapshot, types, width).write.mode("overwrite").parquet(f"{out}/backtest")
    evaluate.metrics_report(per_type, "Failure models").coalesce(1).write.mode("overwrite").text(f"{out}/report")
    long = risk.long_scores(snapshot.drop("failure_type"), types, features.FEATURES, version, features.lead_days(F.col("failure_type")))
    fleet = spark.read.parquet(vehicles)
    # a second run of a version replaces its predictions; ids follow from what they name
    named = risk.to_predictions(risk.top_scores(long), fleet).withColumn("prediction_id", F.xxhash64("vehicle_id", "failure_type", F.lit(version)))
    tenant = F.col("tenant_id" if "tenant_id" in fleet.columns else "tenant").alias("tenant_id")
    named = named.join(fleet.select("vehicle_id", tenant), "vehicle_id")
    named.withColumn("created_at", F.current_timestamp()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_version").parquet(f"{out}/predictions")
    return {n: spark.read.parquet(f"{out}/{n}") for n in ("type_metrics", "fleet_metrics", "backtest", "predictions")}


def run_risk_refresh(spark: SparkSession, predictions: str, out: str, version: int) -> DataFrame:
    """Replaces the stored latest-risk table. Predictions need tenant_id, prediction_id and vehicle_id."""
    sinks.publish(risk.latest_risk(spark.read.parquet(predictions), "prediction_id"), out, version)
    return sinks.current(spark, out)


def run_catalogue(spark: SparkSession, codes: str, signatures: str, out: str, version: int) -> None:
    """Knowledge base from two stored tables: codes (entry_id, code, description) and signatures (entry_id, failure_type, description)."""
    stored = sinks.current(spark, f"{out}/codes", before=version)
    known, patterns = catalogue.build(stored, spark.read.parquet(codes), spark.read.parquet(signatures))
    sinks.publish(known, f"{out}/codes", version)
    sinks.publish(patterns, f"{out}/signatures", version)


def run_stream(spark: SparkSession, messages: str, vehicles: str, out: str, shards: int = 32, once: bool = False, servers: str | None = None) -> list:
    """The live layer: raw messages (files of topic, value, arrival in a folder, or Kafka topics where ``servers`` is given)
    to dead letters, accepted messages, enriched alerts, day tables, lake, archive and the twin. Waits where ``once``."""
    paths = pipeline.Paths(out)
    raw = readers.kafka_stream(spark, servers, messages) if servers else readers.message_stream(spark, messages, f"{readers.RAW_SCHEMA}, arrival long")
    queries = [pipeline.start_routing(raw, paths, shards, once)]
    if once:
        queries[0].awaitTermination()
    queries += pipeline.start_pipeline(pipeline.accepted_stream(spark, paths), paths, vehicles, once)
    if once:
        for query in queries[1:]:
            query.awaitTermination()
    return queries


def run_fold(spark: SparkSession, out: str, before: str | None = None) -> None:
    """Daily upkeep of the live tables: folds the twin's changes into its view; drops the days before ``before``."""
    paths = pipeline.Paths(out)
    state.fold_changes(spark, paths.data("twin"))
    for name in ("telemetry_fast", "telemetry_health") if before else ():
        sinks.drop_days(spark, paths.data(name), before)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="convoy.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)
    wanted = {
        "features": ["fast", "health", "labels", "out"], "rollup": ["fast", "out", "now"], "train": ["table", "vehicles", "out", "version"],
        "refresh-risk": ["predictions", "out", "version"], "catalogue": ["codes", "signatures", "out", "version"],
        "stream": ["messages", "vehicles", "out"], "fold": ["out"],
    }
    for name, options in wanted.items():
        job = jobs.add_parser(name)
        for option in options:
            job.add_argument(f"--{option}", required=True)
    jobs.choices["train"].add_argument("--as-of")
    jobs.choices["stream"].add_argument("--servers")
    jobs.choices["stream"].add_argument("--once", action="store_true")
    jobs.choices["fold"].add_argument("--before")
    args = parser.parse_args(argv)
    spark = build_session(f"convoy-{args.job}")
    if args.job == "features":
        run_features(spark, args.fast, args.health, args.labels, args.out).show()
    elif args.job == "rollup":
        run_rollup(spark, args.fast, args.out, args.now)
    elif args.job == "train":
        run_training(spark, args.table, args.vehicles, args.out, args.version, args.as_of)["backtest"].show(truncate=False)
    elif args.job == "refresh-risk":
        run_risk_refresh(spark, args.predictions, args.out, int(args.version))
    elif args.job == "stream":
        if not args.once:
            run_stream(spark, args.messages, args.vehicles, args.out, servers=args.servers)
            spark.streams.awaitAnyTermination()
        else:
            run_stream(spark, args.messages, args.vehicles, args.out, once=True, servers=args.servers)
    elif args.job == "fold":
        run_fold(spark, args.out, args.before)
    else:
        run_catalogue(spark, args.codes, args.signatures, args.out, int(args.version))


if __name__ == "__main__":
    main()

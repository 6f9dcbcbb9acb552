"""Queries that go through a stored form: write with a sink, read back with a reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from convoy.operators import features, risk, search
from convoy.plans import derive as d
from convoy.plans import features as pf
from convoy.plans import ml
from convoy.plans.registry import query
from convoy.session import ensure_checkpoint_dir
from convoy.sources import readers
from convoy.streaming import sinks


def _folder(spark):
    return f"{ensure_checkpoint_dir(spark)}/stores-{uuid.uuid4().hex}"


@query("feature_store", "O-SNK-8", "O-SRC-4", sql=f"WITH {pf._FEATURES} SELECT vin, day, avg_coolant_c, min_charge_v, coolant_slope_7d, any_failure_label FROM lab")
def feature_store(spark, sf_dir):
    path = f"{_folder(spark)}/features"
    pf.table(spark, sf_dir).write.mode("overwrite").parquet(path)
    return readers.features(spark, path).select("vin", "day", "avg_coolant_c", "min_charge_v", "coolant_slope_7d", "any_failure_label")


@query("label_file", "O-SRC-3", sql=f"WITH {d.SIG}, {d.LABELS} SELECT vin, vehicle_type, failure_type, failure_at FROM labels_all")
def label_file(spark, sf_dir):
    path = f"{_folder(spark)}/labels"
    rows = d.failure_labels(spark, sf_dir).select("vin", "tenant", "vehicle_type", "failure_type", "onset_at", "failure_at")
    rows.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").csv(path)
    read = readers.failure_labels(spark, path)
    return read.select("vin", "vehicle_type", "failure_type", F.col("failure_at").cast("timestamp_ntz").alias("failure_at"))


@query("archive_store", "O-SNK-6", "O-SNK-2", sql=f"WITH {d.SIG}, {d.COPIES} SELECT tenant, msg_type, count(*) AS n, count(*) AS dated FROM dup GROUP BY ALL")
def archive_store(spark, sf_dir):
    """Two batches appended to the raw archive, the second one written twice as after a failure."""
    path = f"{_folder(spark)}/archive"
    rows = d.signals(spark, sf_dir)
    sinks.write_batch(sinks.archived(rows), path, 0, "tenant")
    for _ in range(2):
        sinks.write_batch(sinks.archived(rows.filter("kind = 'click'")), path, 1, "tenant")
    return spark.read.parquet(path).groupBy("tenant", "msg_type").agg(F.count(F.lit(1)).alias("n"), F.count("archived_at").alias("dated"))


@query("prediction_store", "O-SNK-9", "O-ML-16", "O-ML-17",
       sql=f"""WITH {pf._FEATURES}, {d.VEHICLES}, sc AS ({ml._LONG_SQL}), tr AS (SELECT * FROM trend), ld AS ({pf._LEAD_SQL})
       SELECT v.vehicle_id, sc.day, sc.failure_type, CAST(CAST(round(s, 5) AS DECIMAL(6,5)) AS DOUBLE) AS risk_score, CAST(CAST(ld.lead_days AS DECIMAL(4,1)) AS DOUBLE) AS lead_days
       FROM sc JOIN vehicles v USING (vin) LEFT JOIN ld ON ld.vin = sc.vin AND ld.day = sc.day AND ld.failure_type = sc.failure_type WHERE s >= 0.01""")
def prediction_store(spark, sf_dir):
    """Scored pairs appended as predictions with the stored decimal types."""
    path = f"{_folder(spark)}/predictions"
    scored = ml.stand_in_scores(spark, sf_dir)
    long = risk.long_scores(scored, list(ml._SCORE), features.NUMERIC_FEATURES, "v1", features.lead_days(F.col("failure_type")), key="key")
    rows = risk.to_predictions(long.select("key.*", "*").drop("key"), d.vehicles(spark, sf_dir))
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path).select(
        "vehicle_id", "day", "failure_type", F.col("risk_score").cast("double").alias("risk_score"), F.col("lead_days").cast("double").alias("lead_days")
    )


@query("catalogue_upsert", "O-VEC-3", "O-SNK-9",
       sql="""WITH u AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT item_id, text FROM benchmark)
       SELECT doc_id, md5(text) AS text_md5, 384::BIGINT AS size FROM u""")
def catalogue_upsert(spark, sf_dir):
    """Documents as the stored catalogue; benchmark items replace entries of the same key."""
    base = f"{_folder(spark)}/catalogue"
    stored = d.spread(d.table(spark, sf_dir, "documents").select("doc_id", "text"))
    sinks.publish(search.upsert_catalogue(None, stored, "doc_id", "text"), base, 0)
    entries = d.table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    sinks.publish(search.upsert_catalogue(sinks.current(spark, base), entries, "doc_id", "text"), base, 1)
    return sinks.current(spark, base).select("doc_id", F.md5("text").alias("text_md5"), F.size("vector").cast("long").alias("size"))

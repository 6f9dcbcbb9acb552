"""The batch jobs end to end on derived telemetry."""

from pyspark.sql import functions as F

from convoy import jobs
from convoy.operators import search
from convoy.plans import derive as d
from convoy.streaming import sinks


def test_features_training_and_risk(spark, sf_dir, tmp_path):
    base = str(tmp_path)
    rows = d.telemetry(spark, sf_dir).withColumn("ts", F.col("event_time").cast("timestamp"))
    rows.filter("msg_type = 'FAST'").write.parquet(f"{base}/fast")
    rows.filter("msg_type = 'HEALTH'").write.parquet(f"{base}/health")
    labels = d.failure_labels(spark, sf_dir).select("vin", "tenant", "vehicle_type", "failure_type", "onset_at", "failure_at")
    labels.write.option("header", True).csv(f"{base}/labels")
    counts = jobs.run_features(spark, f"{base}/fast", f"{base}/health", f"{base}/labels", f"{base}/features").first()
    assert counts["rows"] > 200 and 0 < counts["positives"] < counts["rows"]
    d.vehicles(spark, sf_dir).write.parquet(f"{base}/vehicles")
    out = jobs.run_training(spark, f"{base}/features", f"{base}/vehicles", f"{base}/ml", "v1", max_iter=3, types=["cooling", "battery"])
    assert out["type_metrics"].count() == 2 and out["fleet_metrics"].count() == 1 and out["backtest"].count() == 1
    assert "| cooling |" in "\n".join(r.value for r in spark.read.text(f"{base}/ml/report").collect())
    predictions = out["predictions"]
    assert predictions.filter("size(feature_vector) <> 384 OR risk_score < 0.01").count() == 0
    n = predictions.count()
    latest = jobs.run_risk_refresh(spark, f"{base}/ml/predictions", f"{base}/risk", 0)
    due = predictions.filter("lead_days > 0 AND lead_days <= 30")
    assert latest.count() == due.select("vehicle_id").distinct().count()


def test_catalogue_search(spark, tmp_path):
    entries = [(0, "P0301", "Cylinder 1 misfire detected"), (1, "P0303", "Cylinder 3 misfire detected"), (2, "P0524", "Engine oil pressure too low")]
    spark.createDataFrame(entries, "entry_id long, code string, description string").write.parquet(f"{tmp_path}/in/codes")
    spark.createDataFrame([(0, "tyre", "pressure of one tyre falls slowly")], "entry_id long, failure_type string, description string").write.parquet(f"{tmp_path}/in/signatures")
    for version in (0, 1):
        jobs.run_catalogue(spark, f"{tmp_path}/in/codes", f"{tmp_path}/in/signatures", f"{tmp_path}/kb", version)
    stored = sinks.current(spark, f"{tmp_path}/kb/codes")
    assert stored.count() == 3
    asked = spark.createDataFrame([(0, "cylinder 3 misfire"), (1, "oil pressure too low")], "q long, text string")
    found = search.cosine_neighbours(search.hashed_vectors(asked, "q", "text"), stored, 1, "q", "entry_id")
    codes = {r.query_id: r.code for r in found.join(stored, found.item_id == stored.entry_id).collect()}
    assert codes == {0: "P0303", 1: "P0524"}
    assert sinks.current(spark, f"{tmp_path}/kb/signatures").count() == 1
    assert sinks.versions(spark, f"{tmp_path}/kb/codes") == [0, 1]

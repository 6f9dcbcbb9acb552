"""Readers: topics, message files, JDBC tables, label files and stored features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy import schemas as S

RAW_SCHEMA = "topic string, value string"


def kafka_stream(spark: SparkSession, servers: str, topics: str, starting: str = "latest", max_offsets: int | None = None) -> DataFrame:
    """Messages of one or more topics; needs the Kafka connector package on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    reader = reader.option("subscribe", topics).option("startingOffsets", starting)
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(
        "topic", F.col("value").cast("string").alias("value"), "partition", F.col("offset").alias("arrival"), "timestamp"
    )


def message_stream(spark: SparkSession, path: str, schema: str = RAW_SCHEMA, fmt: str = "json", **options: str) -> DataFrame:
    """The same from files that appear in a folder."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def parse_telemetry(raw: DataFrame, value: str = "value", *keep: str) -> DataFrame:
    """Already validated telemetry JSON; keys that are absent or do not parse become NULL."""
    message = F.from_json(F.col(value).cast("string"), S.MESSAGE_SCHEMA, {"mode": "PERMISSIVE"})
    return raw.select(message.alias("_m"), *keep).select("_m.*", *keep).withColumn("event_time", F.col("ts"))


def parse_alerts(raw: DataFrame, value: str = "value", *keep: str) -> DataFrame:
    return raw.select(F.from_json(F.col(value).cast("string"), S.ALERT_SCHEMA).alias("_a"), *keep).select("_a.*", *keep)


def by_topic(raw: DataFrame, telemetry: str, alerts: str) -> tuple[DataFrame, DataFrame]:
    """Telemetry and alerts of a mixed stream; other topics and records without a VIN are dropped."""
    seen = parse_telemetry(raw.filter(F.col("topic") == telemetry)).filter("vin IS NOT NULL AND msg_type IS NOT NULL AND seq IS NOT NULL")
    raised = parse_alerts(raw.filter(F.col("topic") == alerts)).filter("vin IS NOT NULL AND failure_type IS NOT NULL")
    return seen, raised


def jdbc_table(
    spark: SparkSession, url: str, table: str, tenant: str, column: str, lower: str, upper: str, partitions: int, **options: str
) -> DataFrame:
    """One tenant's rows of a database table, read in parallel ranges of ``column``.

    The tenant filter runs inside the database. The driver class must be on the class path.
    """
    safe = tenant.replace("'", "''")
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", "10000")
    reader = reader.option("dbtable", f"(SELECT * FROM {table} WHERE tenant = '{safe}') AS t")
    reader = reader.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper)
    return reader.option("numPartitions", partitions).options(**options).load()


def failure_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label file with a header; empty or unreadable times become NULL."""
    rows = spark.read.option("header", True).schema(S.LABEL_SCHEMA).csv(path)
    return rows.withColumns({c: F.try_to_timestamp(c) for c in ("onset_at", "failure_at")})


def features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

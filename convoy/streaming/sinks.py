"""Sinks. Every batch writer is safe to repeat: a retried batch overwrites its own output."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BatchWriter = Callable[[DataFrame, int], None]

#: State partitions of a new stream per core. Each is a store with files, buffers and a commit of its own, and each task of a
#: batch writes a file per folder: their number follows the cores, while the rows of a batch are bounded by the trigger.
STATE_PER_CORE = 3
_SHUFFLE = "spark.sql.shuffle.partitions"


@contextmanager
def _few_partitions(spark: SparkSession) -> Iterator[None]:
    """No more than ``STATE_PER_CORE`` shuffle partitions a core for a stream that starts here. The stream takes them over when
    it starts; one with a checkpoint keeps the number that is noted there."""
    before = spark.conf.get(_SHUFFLE)
    spark.conf.set(_SHUFFLE, str(min(int(before), STATE_PER_CORE * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLE, before)


def write_batch(df: DataFrame, path: str, batch: int, *partitions: str) -> None:
    """Appends a micro-batch as the folder ``batch=N``. A batch that is run again leaves a complete folder as it is, so
    that no running reader loses its files or meets rows twice; what a failed attempt left is replaced."""
    folder = f"{path}/batch={batch}"
    if _exists(df.sparkSession, f"{folder}/_SUCCESS"):
        df.write.format("noop").mode("overwrite").save()  # the batch's state must still be brought forward
        return
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(folder)


def write_days(df: DataFrame, path: str, batch: int, day: str = "dt") -> None:
    """Appends a micro-batch with the day as the outer folder, ``dt=D/batch=N``, so a reader of some days lists only those;
    a batch that is run again replaces its own folders."""
    named = df.withColumn("batch", F.lit(batch))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, "batch").parquet(path)


def drop_days(spark: SparkSession, path: str, before: str, day: str = "dt") -> list[str]:
    """Removes the folders of all days before ``before`` (yyyy-mm-dd) and returns them. Readers list folders when they
    start, so drop days that no job reads any more."""
    old = [d for d in _children(spark, path, f"{day}=") if d < before]
    for value in old:
        remove(spark, f"{path}/{day}={value}")
    return old


def start(stream: DataFrame, checkpoint: str, writer: BatchWriter, once: bool = False, every: str = "30 seconds", name: str | None = None) -> StreamingQuery:
    """Runs ``writer`` per micro-batch, continuously or over all data available now."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(writer)
    query = query.queryName(name) if name else query
    with _few_partitions(stream.sparkSession):
        return (query.trigger(availableNow=True) if once else query.trigger(processingTime=every)).start()


def start_files(stream: DataFrame, path: str, checkpoint: str, *partitions: str, fmt: str = "parquet", once: bool = False, every: str = "30 seconds") -> StreamingQuery:
    """File sink with its own commit log (exactly once)."""
    query = stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if partitions:
        query = query.partitionBy(*partitions)
    with _few_partitions(stream.sparkSession):
        return (query.trigger(availableNow=True) if once else query.trigger(processingTime=every)).start()


def start_kafka(stream: DataFrame, servers: str, topic: str, checkpoint: str, key: str = "vin", every: str = "1 second") -> StreamingQuery:
    """JSON messages keyed by vehicle; needs the Kafka connector package."""
    rows = stream.select(F.col(key).alias("key"), as_json(stream).alias("value"))
    query = rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return query.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def as_json(df: DataFrame):
    """Rows as JSON text with ISO-8601 times."""
    return F.to_json(F.struct(*df.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"})


def lake_rows(messages: DataFrame, ts: str = "event_time") -> DataFrame:
    """Nested messages with their day for the lake."""
    return messages.select("vin", "msg_type", "seq", ts, "tenant", "payload", F.date_format(ts, "yyyy-MM-dd").alias("dt"))


def archived(messages: DataFrame) -> DataFrame:
    return messages.withColumn("archived_at", F.current_timestamp())


# --- whole-table replacement without a table format -------------------------------------------------
def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _exists(spark: SparkSession, path: str) -> bool:
    fs, place = _folder(spark, path)
    return fs.exists(place)


def _children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What follows ``prefix`` in the names of a folder's entries, sorted."""
    fs, folder = _folder(spark, path)
    names = [status.getPath().getName() for status in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(n[len(prefix):] for n in names if n.startswith(prefix))


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _folder(spark, path)
    fs.delete(place, True)


def _complete(spark: SparkSession, base: str, prefix: str) -> list[int]:
    return sorted(int(n) for n in _children(spark, base, prefix) if _exists(spark, f"{base}/{prefix}{n}/_SUCCESS"))


def batches(spark: SparkSession, base: str) -> list[int]:
    """Completed micro-batches of a table written by ``write_batch``."""
    return _complete(spark, base, "batch=")


def versions(spark: SparkSession, base: str) -> list[int]:
    """Completed versions of a table kept as ``base/version=N``."""
    return _complete(spark, base, "version=")


def current(spark: SparkSession, base: str, before: int | None = None) -> DataFrame | None:
    """Newest completed version (older than ``before``), or None."""
    known = [v for v in versions(spark, base) if before is None or v < before]
    return spark.read.parquet(f"{base}/version={known[-1]}") if known else None


def publish(df: DataFrame, base: str, version: int, keep: int | None = None) -> None:
    """Writes a complete version; a path being read is never overwritten. Old versions stay, as a reader may hold any of
    them, unless the caller says how many to ``keep``."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{base}/version={version}")
    if keep is None:
        return
    for old in versions(spark, base)[:-keep]:
        remove(spark, f"{base}/version={old}")

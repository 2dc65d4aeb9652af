"""Streaming redaction and live counters, and a helper to run a stream over what is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.detect import BUILT_IN, ColumnDetector, Detector
from veilspark.operators.policy import LayeredPolicy, Policy
from veilspark.operators.redact import redact
from veilspark.operators.staging import numbered_folders, staging_path


def redact_stream(
    texts: DataFrame,
    text: str = "text",
    policy: Policy | LayeredPolicy | None = None,
    detectors: Sequence[Detector | ColumnDetector] = BUILT_IN,
) -> DataFrame:
    """Each text redacted on its own: the batch operator, unchanged, and without state."""
    return redact(texts, text, policy, detectors)


def live_entity_counts(redacted: DataFrame) -> DataFrame:
    """Running count of reported entities by type and action."""
    kinds = F.transform("entities", lambda e: F.struct(e["type"].alias("type"), e["action"].alias("action")))
    exploded = redacted.select(F.explode(kinds).alias("e")).select("e.*")
    return exploded.groupBy("type", "action").agg(F.count("*").alias("entities_total"))


def live_request_counts(redacted: DataFrame, route: str) -> DataFrame:
    """Running count of requests and of blocked requests for one route."""
    return redacted.groupBy(F.lit(route).alias("route")).agg(
        F.count("*").alias("requests_total"), F.sum(F.col("blocked").cast("long")).alias("blocked_total")
    )


def read_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The table ``name`` of a folder as a stream, a few files per micro-batch. It is one file or a folder of files."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16)
    if files.getFileStatus(where).isDirectory():
        return source.parquet(f"{folder}/{name}")
    return source.option("pathGlobFilter", name).parquet(folder)


def drain(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Run an appending stream over all available input into a staged table, and read that table. With the
    ``path`` of an earlier run, go on from there with what has come since."""
    spark = stream.sparkSession
    path = path or staging_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


EPOCH = "epoch-"


def write_epoch(path: str):
    """A writer for ``foreachBatch`` that writes every micro-batch once, as parquet.

    A batch has a folder of its own, which counts when its job has committed. A batch that comes again
    after a failure is skipped if its folder counts, and written over if it does not.
    """

    def write(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        if (epoch, True) not in numbered_folders(spark, path, EPOCH):
            rows.write.mode("overwrite").parquet(f"{path}/{EPOCH}{epoch}")

    return write


def read_epochs(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all batches that :func:`write_epoch` has committed."""
    folders = [f"{path}/{EPOCH}{n}" for n, done in numbered_folders(spark, path, EPOCH) if done]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def drain_epochs(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over all available input into committed batches under ``path``, and read them."""
    query = (
        stream.writeStream.foreachBatch(write_epoch(f"{path}/data"))
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return read_epochs(stream.sparkSession, f"{path}/data", stream.schema)


def window_counts(requests: DataFrame, every: str = "1 hour", ts: str = "ts", by: str = "route") -> DataFrame:
    """``window_start, <by>, requests``: counts of requests by event-time window, of one batch of rows."""
    counted = requests.groupBy(F.window(ts, every).alias("window"), by).agg(F.count("*").alias("requests"))
    return counted.select(F.col("window.start").alias("window_start"), by, "requests")


def drain_window_counts(requests: DataFrame, path: str, every: str = "1 hour", ts: str = "ts", by: str = "route") -> DataFrame:
    """Windowed counts of a stream, without state: every micro-batch commits its own partial counts, and
    their sums are the counts. A row counts in its window however late it comes, and once. Rows without
    a time have no window and are not counted."""
    spark = requests.sparkSession
    write = write_epoch(f"{path}/data")
    query = (
        requests.writeStream.foreachBatch(lambda rows, epoch: write(window_counts(rows, every, ts, by), epoch))
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    kind = requests.schema[by].dataType.simpleString()
    parts = read_epochs(spark, f"{path}/data", f"window_start timestamp, {by} {kind}, requests long")
    return parts.groupBy("window_start", by).agg(F.sum("requests").alias("requests"))


def live_window_counts(requests: DataFrame, delay: str, every: str = "1 hour", ts: str = "ts", by: str = "route") -> DataFrame:
    """Windowed counts with state bounded by a watermark: a window is given once, when no row of it can
    come any more. Rows later than ``delay`` behind the latest are not counted; Spark reports how many."""
    return window_counts(requests.withWatermark(ts, delay), every, ts, by)


def drain_totals(stream: DataFrame, name: str) -> DataFrame:
    """Run an aggregating stream over all available input; the last full result, staged.

    Every micro-batch replaces the table, so a repeated batch writes the same totals again. A stream
    without any input has no totals.
    """
    spark = stream.sparkSession
    path = staging_path(spark, name)

    def save(totals: DataFrame, epoch: int) -> None:
        totals.write.mode("overwrite").parquet(f"{path}/data-{epoch}")

    query = (
        stream.writeStream.outputMode("complete")
        .foreachBatch(save)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    last = max((n for n, done in numbered_folders(spark, path, "data-") if done), default=None)
    if last is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/data-{last}")

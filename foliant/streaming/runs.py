"""Benchmark runs as a stream: rows that arrive once, late rows dropped, and rates per window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def timed(rows: DataFrame, time: str) -> DataFrame:
    """Event time with a zone, which watermarks need."""
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def once(rows: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each key once, within the watermark; state is bounded by it."""
    return timed(rows, time).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def rates(rows: DataFrame, time: str, width: str = "1 day", late: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Rows and mean value per key and window, final once the watermark has passed."""
    return timed(rows, time).withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def resumed(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Rows whose key has no result under `path` yet: what a run that was stopped still has to do."""
    spark = rows.sparkSession
    if not _exists(spark, path):
        return rows
    return rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines beside those already there."""
    rows.write.mode("append").json(path)


def run_checkpointed(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str) -> None:
    """Does `work` on what a stream has not been through yet and keeps each result once under `path`.

    Each batch has a folder of its own, named by its number, which a batch that is repeated after a failure writes anew:
    so nothing is lost or doubled whenever the run is stopped. Rows whose key a former batch has a result of are passed over.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = f"{path}/batch={number}"
        rows = batch.dropDuplicates([key])
        if _exists(spark, path):
            before = spark.read.option("basePath", path).parquet(path).where(F.col("batch") != number).select(key)
            rows = rows.join(before.distinct(), key, "left_anti")
        work(rows).write.mode("overwrite").parquet(folder)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sessions(rows: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Rows and values per key and session, a session ending after `gap` without a row; works on tables and streams."""
    timed_ = timed(rows, time)
    marked = timed_.withWatermark(time, late) if rows.isStreaming else timed_
    grouped = marked.groupBy(F.session_window(time, gap).alias("session"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n", "total")

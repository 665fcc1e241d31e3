"""Streams of lines and of reviewers' changes: threshold rows, counts by time, and a table kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from docloom.functions.thresholds import detect
from docloom.operators import overlay


def thresholds(lines: DataFrame) -> DataFrame:
    """Threshold rows of a stream of lines (manual_id, line_no, page, text): stateless, so any trigger and sink will do."""
    return detect(lines.withColumn("source", F.concat(F.lit("p."), (F.col("page") + 1).cast("string"), F.lit(" / text"))))


def counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows (start, key, n): events of each window and key. State older than `late` is given up, and rows later than that are left out."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def new_thresholds(found: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Threshold rows without repeats of a manual's threshold_id and place that arrive within `late`."""
    return found.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(["manual_id", "threshold_id", "line_no", "at"])


def _version(folder: str, batch: int) -> str:
    return f"{folder}/batch={batch:012d}"


def keep_latest(changes: DataFrame, folder: str, key: list[str], order: list[str]) -> DataStreamWriter:
    """A writer that appends, for each micro-batch, the last change of each key to folder.

    A batch is one folder named by its number and is overwritten if it is repeated, so a restart
    neither loses nor doubles a change. What is written grows with the changes and not with the table; current() merges.
    """

    def write(batch: DataFrame, number: int) -> None:
        overlay.latest(batch, key, order).write.mode("overwrite").parquet(_version(folder, number))

    return changes.writeStream.foreachBatch(write)


def current(spark: SparkSession, folder: str, key: list[str], order: list[str]) -> DataFrame:
    """The last change of each key over all batches that keep_latest wrote."""
    return overlay.latest(spark.read.parquet(folder).drop("batch"), key, order)


def compact(spark: SparkSession, folder: str, target: str, key: list[str], order: list[str]) -> DataFrame:
    """current() written as the first batch of target, to which later batches can be copied; folder stays as it is."""
    current(spark, folder, key, order).write.mode("overwrite").parquet(_version(target, 0))
    return spark.read.parquet(target).drop("batch")

"""Continuous ingestion of record files into the journal's layout, and counts by time.

The batch journal appends what it is given; this keeps up with a folder that evaluation runs
write to. Spark's checkpoint remembers which files are in, so a restart neither loses nor repeats one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def records_stream(spark: SparkSession, folder: str, schema: str, per_batch: int = 100) -> DataFrame:
    """New JSON-lines files of a folder, at most ``per_batch`` files at once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(folder)


def to_journal(stream: DataFrame, path: str, checkpoint: str, key: str, time: str, late: str = "1 hour") -> StreamingQuery:
    """Appends each key once within the lateness that ``late`` allows; state older than that is dropped."""
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return once.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, time: str, by: list[str], width: str, late: str) -> DataFrame:
    """(window_start, by…, n) per tumbling window, complete once the watermark has passed it."""
    own = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return own.select(F.col("w.start").alias("window_start"), *by, "n")

"""Structured Streaming counterparts of the column profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tabweave.operators.describe import numeric_profile


def windowed_moments(stream: DataFrame, time: str, value: str, by: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, by, n, mean, std, min, max) over event-time windows; in append and update mode rows later than `late`
    are dropped by the watermark, and append mode leaves out windows still open at the end of the stream; complete mode has all rows and
    windows. The state is one row of mergeable sums a window and key."""
    t = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    w = t.groupBy(F.window("_t", width).alias("w"), F.col(by)).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return w.select(F.col("w.start").alias("window_start"), by, "n", "mean", "std", "min", "max")


def monitor_profile(stream: DataFrame, columns: list[str], out: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends the numeric profile of each micro-batch to the table at `out`, once a batch: a batch that is run
    again overwrites its own partition."""

    def each(batch: DataFrame, number: int) -> None:
        numeric_profile(batch, columns).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)

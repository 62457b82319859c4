"""Group statistics of a stream: counts, sums and non-zeros merge, so means and thresholded means stay exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(events: DataFrame, time_col: str, group_col: str, value_col: str, window: str = "1 day", late: str = "1 day", trim: float = 0.1) -> DataFrame:
    """(start, group, n, nonzero, total, mean, thresholded) by tumbling window and group, of a stream or a table.

    ``late`` is the watermark: rows that come later than that are not counted, and state older than that is dropped.
    """
    rows = events.select(F.col(time_col).cast("timestamp").alias("__ts"), F.col(group_col).alias("group"), F.col(value_col).alias("__v"))
    if events.isStreaming:
        rows = rows.withWatermark("__ts", late)
    g = rows.groupBy(F.window("__ts", window), "group").agg(F.count("*").alias("n"), F.count_if(F.col("__v") != 0).alias("nonzero"), F.sum("__v").alias("total"))
    mean = F.coalesce("total", F.lit(0.0)) / F.col("n")
    return g.select(F.col("window.start").alias("start"), "group", "n", "nonzero", "total", mean.alias("mean"), F.when(F.col("nonzero") / F.col("n") >= trim, mean).otherwise(0.0).alias("thresholded"))


def run_available(stats: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what there is of a stream and appends finished windows as Parquet at ``path``; a rerun goes on from ``checkpoint``."""
    stats.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def snapshot(stats: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """All windows so far, finished or not, as a table in memory."""
    stats.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stats.sparkSession.table(name)

"""Event streams (an extension: batch operators have no streaming counterpart to match)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of value per key and tumbling window; rows later than ``late`` are dropped by the watermark. Works on
    streams and tables alike."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("_ts", late)
    g = e.groupBy(F.window("_ts", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), key, "n", "total")


def latest_steps(steps: DataFrame, late: str = "1 day") -> DataFrame:
    """Append-only step log, repeated saves dropped within the watermark."""
    return steps.withColumn("_ts", F.col("saved_at").cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(["run_id", "step_index", "status"])

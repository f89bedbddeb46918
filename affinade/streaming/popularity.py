"""Beyond the batch operators: popularity of event keys over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def popularity_stream(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window start, i, n: events per key and tumbling window; rows later than ``late`` are left out."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("i")).where("i is not null")
    return rows.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "i").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "i", "n")

"""The hourly mean on a stream: the same aggregation with a watermark for late readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_stream(readings: DataFrame, *values: str, late: str = "2 hours") -> DataFrame:
    """Mean of each station and hour of a stream of readings; hours close once the watermark has passed them."""
    return (
        readings.withWatermark("ts", late).groupBy("station_id", F.window("ts", "1 hour"))
        .agg(*[F.avg(v).alias(v) for v in values]).select("station_id", F.col("window.start").alias("ts"), *values)
    )

"""Cleaning and densifying station readings.

Tables are long: ``readings(station_id, ts, wd, ws, pm25)``, ``stations(station_id,
lon, lat)``. Missing values are nulls throughout.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wind as w


def numbers(df: DataFrame, *columns: str) -> DataFrame:
    """Text to numbers; what is no number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def known_only(readings: DataFrame, stations: DataFrame) -> DataFrame:
    return readings.join(stations.select("station_id"), "station_id", "left_semi")


def between(df: DataFrame, start: datetime, end: datetime, column: str = "ts", strict: bool = False) -> DataFrame:
    """Rows from ``start`` to ``end``, both inclusive; with ``strict`` an empty result is an error."""
    out = df.where(F.col(column).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    if strict and out.isEmpty():
        raise ValueError("no rows in the time window")
    return out


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order`` (the position in the file)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def zero_is_missing(df: DataFrame, column: str = "pm25", without: object = None, shift_hours: int = 0) -> DataFrame:
    """Zero readings become null, one station is dropped, timestamps are shifted to local time."""
    out = df.withColumn(column, F.nullif(F.col(column), F.lit(0.0)))
    if without is not None:
        out = out.where(~F.col("station_id").eqNullSafe(F.lit(without)))
    return out.withColumn("ts", F.col("ts") + F.expr(f"interval {shift_hours} hours")) if shift_hours else out


def with_vectors(df: DataFrame) -> DataFrame:
    """Adds ``wd_valid, ws_valid, pm25_valid, vector_valid`` and the transport ``ux, vy`` (0 where invalid)."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    both = ok("wd") & ok("ws")
    return df.withColumns({
        "wd_valid": ok("wd"), "ws_valid": ok("ws"), "pm25_valid": ok("pm25"), "vector_valid": both,
        "ux": F.when(both, w.transport_x(F.col("wd"), F.col("ws"))).otherwise(0.0),
        "vy": F.when(both, w.transport_y(F.col("wd"), F.col("ws"))).otherwise(0.0),
    })


def merge_aliases(readings: DataFrame, aliases: DataFrame, *values: str) -> DataFrame:
    """Readings of alias stations as those of one output station: mean by hour. ``aliases(raw_id, station_id)``, names in any case."""
    named = aliases.select(F.lower(F.col("raw_id").cast("string")).alias("_raw"), F.col("station_id").alias("_to"))
    return (
        readings.join(named, F.lower(F.col("station_id").cast("string")) == F.col("_raw"), "left")
        .withColumn("station_id", F.coalesce("_to", "station_id")).groupBy("station_id", "ts").agg(*[F.avg(v).alias(v) for v in values])
    )


def hourly(readings: DataFrame, *values: str) -> DataFrame:
    """Mean of each station and hour, nulls skipped column by column."""
    return readings.groupBy("station_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(*[F.avg(v).alias(v) for v in values])


def hours_of(readings: DataFrame) -> DataFrame:
    """``ts, t_idx``: the distinct hours and their numbers from 0."""
    hours = readings.select("ts").distinct()
    return hours.withColumn("t_idx", F.row_number().over(Window.orderBy("ts")).cast("long") - 1)


def dense(readings: DataFrame, stations: DataFrame, hours: DataFrame) -> DataFrame:
    """Every station at every hour; absent readings are null. The grid is stations times hours, which is the result."""
    return hours.crossJoin(F.broadcast(stations.select("station_id"))).join(readings, ["station_id", "ts"], "left")


def city_mean(vectors: DataFrame) -> DataFrame:
    """Mean vector of the valid stations of each hour, 0 if there are none."""
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("vector_valid"), F.col(c))), F.lit(0.0))
    return vectors.groupBy("t_idx").agg(mean("ux").alias("vx"), mean("vy").alias("vy"), F.count_if("vector_valid").alias("n_valid"))


def moments(df: DataFrame, train: Column, *values: str) -> DataFrame:
    """Mean and population deviation + 1e-6 of each value over the training rows; 0 and 1 if there are none."""
    own = [F.when(train, F.col(v)) for v in values]
    return df.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{v}_mean") for c, v in zip(own, values, strict=True)], *[F.coalesce(F.stddev_pop(c) + 1e-6, F.lit(1.0)).alias(f"{v}_std") for c, v in zip(own, values, strict=True)])


def chronological(df: DataFrame, train_share: float = 0.8, window: int = 24) -> DataFrame:
    """Adds ``part``: train before the cut, validation from it. Too short a rest gives all to both (``both``)."""
    span = df.agg((F.max("t_idx") + 1).alias("n"))
    cut = F.greatest(F.lit(1), F.floor(F.col("n") * train_share))
    return df.join(F.broadcast(span)).withColumn("part", F.when((F.col("n") - cut < window) | (cut < window), "both").when(F.col("t_idx") < cut, "train").otherwise("validation")).drop("n")


def study_windows(df: DataFrame, start: datetime, hours: int = 168) -> DataFrame:
    """Adds ``window_id``: tumbling windows from a declared start; rows before it go."""
    since = F.timestamp_diff("HOUR", F.lit(start).cast("timestamp_ntz"), F.col("ts"))
    return df.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz")).withColumn("window_id", F.floor(since / hours))


def even_windows(spark, total: int, length: int, n: int) -> DataFrame:
    """``window_id, start``: n overlapping windows, starts evenly spaced and rounded half to even."""
    step = (total - length) / max(1, n - 1)
    return spark.range(n).select(F.col("id").alias("window_id"), F.rint(F.col("id") * step).cast("long").alias("start"))


def in_windows(df: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    """Rows of ``df(t_idx)`` in each window, by an equi join on exploded hours."""
    hours = windows.select("window_id", "start", F.explode(F.sequence("start", F.col("start") + length - 1)).alias("t_idx"))
    return df.join(hours, "t_idx").withColumn("t_in_window", F.col("t_idx") - F.col("start")).drop("start")


def sliding(spark, total: int, length: int) -> DataFrame:
    """``start`` of windows that follow each other, and one aligned to the end."""
    starts = sorted({*range(0, max(1, total - length + 1), length), max(0, total - length)})
    return spark.createDataFrame([(s,) for s in starts], "start long")


def impute_sliding(df: DataFrame, starts: DataFrame, length: int, value: str = "pm25") -> DataFrame:
    """Each window predicts its own station mean; overlaps are averaged; observed values stay.

    ``df(station_id, t_idx, value)`` is dense.
    """
    hours = starts.select("start", F.explode(F.sequence("start", F.col("start") + length - 1)).alias("t_idx"))
    cut = df.join(F.broadcast(hours), "t_idx")
    means = cut.groupBy("station_id", "start").agg(F.avg(value).alias("_mean"))
    predicted = cut.join(means, ["station_id", "start"]).groupBy("station_id", "t_idx").agg(F.avg("_mean").alias("predicted"), F.first(value).alias("observed"))
    return predicted.select("station_id", "t_idx", F.coalesce("observed", "predicted").alias(value), F.col("observed").isNull().alias("imputed"))


def hold_out(stations: DataFrame, share: float, seed: str) -> DataFrame:
    """Adds ``held_out``: max(1, round(share * n)) stations by a hash of seed and id, at least one left."""
    order = F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit(seed), F.col("station_id").cast("string")))))
    n = F.count("*").over(Window.partitionBy())
    take = F.least(n - 1, F.greatest(F.lit(1), F.rint(n * share)))
    return stations.withColumn("held_out", order <= take)


def product_checks(product: DataFrame) -> DataFrame:
    """``check_name, n_violations, passed`` of a completed wind product, from two aggregate passes.

    ``product(station_id, ts, wd_valid, wd_missing, ws_valid, vector_valid, ux, vy)``.
    """
    whole = product.agg(
        F.count("*").alias("n"), F.count_distinct("station_id").alias("s"), F.count_distinct("ts").alias("t"), F.count_distinct("station_id", "ts").alias("st"),
        F.count_if(F.col("wd_valid") == F.col("wd_missing")).alias("inverse"), F.count_if(F.col("vector_valid") != (F.col("wd_valid") & F.col("ws_valid"))).alias("both"),
        F.count_if(F.col("ux").isNull() | F.isnan("ux") | F.col("vy").isNull() | F.isnan("vy")).alias("finite"),
    )
    rows = [
        ("nonempty", F.when(F.col("n") == 0, 1).otherwise(0)), ("unique_keys", F.col("n") - F.col("st")), ("full_grid", F.col("s") * F.col("t") - F.col("st")),
        ("masks_inverse", F.col("inverse")), ("vector_mask", F.col("both")), ("finite", F.col("finite")),
    ]
    return _checks(whole, rows)


def declared_checks(product: DataFrame, meta: dict[str, str], required: tuple[str, ...], n_stations: int | None = None) -> DataFrame:
    """What product_checks() can't see in the rows: time grows for each station, required metadata are there, and as many stations as expected."""
    before = F.lag("ts").over(Window.partitionBy("station_id").orderBy("t_idx"))
    whole = product.withColumn("_before", before).agg(F.count_if(F.col("ts") <= F.col("_before")).alias("back"), F.count_distinct("station_id").alias("s"))
    rows = [("time_grows", F.col("back")), ("metadata", F.lit(sum(not meta.get(k) for k in required)))]
    return _checks(whole, [*rows, ("station_count", F.abs(F.col("s") - n_stations))] if n_stations is not None else rows)


def panel_checks(panel: DataFrame) -> DataFrame:
    """Contract of ``panel(t_idx, sensor_idx, ts)``: same sensors at every hour, contiguous hours, no null, time grows."""
    by_hour = panel.groupBy("t_idx").agg(F.count("*").alias("n"), F.count_distinct("sensor_idx").alias("d"), F.min("ts").alias("ts"), F.sum(F.when(F.col("ts").isNull(), 1).otherwise(0)).alias("nulls"))
    all_sensors = panel.agg(F.count_distinct("sensor_idx").alias("sensors"))
    stepped = by_hour.withColumn("before", F.lag("ts").over(Window.orderBy("t_idx")))
    whole = stepped.join(F.broadcast(all_sensors)).agg(
        F.count_if((F.col("n") != F.col("sensors")) | (F.col("d") != F.col("sensors"))).alias("same"), (F.max("t_idx") - F.min("t_idx") + 1 - F.count("*")).alias("gaps"),
        F.sum("nulls").alias("nulls"), F.count_if(F.col("ts") <= F.col("before")).alias("back"),
    )
    return _checks(whole, [("same_sensors", F.col("same")), ("contiguous", F.col("gaps")), ("no_null_time", F.col("nulls")), ("time_grows", F.col("back"))])


def _checks(whole: DataFrame, rows: list[tuple[str, Column]]) -> DataFrame:
    made = whole.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.coalesce(c, F.lit(0)).cast("long").alias("n_violations")) for n, c in rows])).alias("r")).select("r.*")
    return made.withColumn("passed", F.col("n_violations") == 0)

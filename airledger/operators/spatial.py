"""Interpolation of station vectors onto points and grids, neighbour tables, held-out scores."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wind as w
from .bounded import few


def interpolate(points: DataFrame, observed: DataFrame, keys: list[str], values: list[str], length: float = 4.0, floor: float = 1e-12) -> DataFrame:
    """Kernel-weighted mean at ``points(keys, x, y)`` of ``observed(keys, sx, sy, values)``, joined within the keys alone.

    Points carry ``keys`` (as the hour); where all weights vanish the plain mean of
    the active stations serves. Points whose keys have no active station give no row.
    """
    weight = w.gaussian((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2, length)
    total = F.sum("_w")
    pairs = points.join(observed, keys).withColumn("_w", weight)
    at = [c for c in points.columns if c not in keys]
    return pairs.groupBy(*keys, *at).agg(*[F.when(total > floor, F.sum(F.col("_w") * F.col(v)) / total).otherwise(F.avg(v)).alias(v) for v in values])


def place(stations: DataFrame, nx: int, ny: int) -> DataFrame:
    """Adds grid positions ``sx, sy`` and cells ``ix, iy``; the limits are one row."""
    lim = stations.agg(F.min("lon").alias("_x0"), F.max("lon").alias("_x1"), F.min("lat").alias("_y0"), F.max("lat").alias("_y1"))
    out = stations.join(F.broadcast(lim)).withColumn("sx", w.to_grid(F.col("lon"), F.col("_x0"), F.col("_x1"), nx)).withColumn("sy", w.to_grid(F.col("lat"), F.col("_y0"), F.col("_y1"), ny))
    return out.withColumn("ix", w.cell(F.col("sx"), nx)).withColumn("iy", w.cell(F.col("sy"), ny)).drop("_x0", "_x1", "_y0", "_y1")


def cells(spark, nx: int, ny: int) -> DataFrame:
    """``ix, iy, x, y`` in x-major order."""
    return spark.range(nx * ny).select(F.floor(F.col("id") / ny).alias("ix"), (F.col("id") % ny).alias("iy")).withColumns({"x": F.col("ix").cast("double"), "y": F.col("iy").cast("double")})


def wind_field(vectors: DataFrame, placed: DataFrame, nx: int, ny: int, length: float = 4.0, dt_s: float = 3600.0, dx_m: float = 1000.0, strict: bool = False) -> DataFrame:
    """``t_idx, ix, iy, ux, vy, dx, dy`` of each cell at each hour that has an active station.

    ``vectors(t_idx, station_id, ux, vy, vector_valid)``. With ``strict`` an hour
    without an active station is an error. The grid of cells is small (nx * ny rows)
    and is broadcast; hours stay where they are and are joined by hour alone.
    """
    active = vectors.where("vector_valid").join(few(placed.select("station_id", "sx", "sy")), "station_id").select("t_idx", "sx", "sy", "ux", "vy")
    hours = vectors.select("t_idx").distinct()
    if strict and not hours.join(active, "t_idx", "left_anti").isEmpty():
        raise ValueError("an hour has no active station")
    points = hours.join(few(cells(vectors.sparkSession, nx, ny)))
    field = interpolate(points, active, ["t_idx"], ["ux", "vy"], length)
    return field.select("t_idx", "ix", "iy", "ux", "vy", w.displacement(F.col("ux"), dt_s, dx_m).alias("dx"), w.displacement(F.col("vy"), dt_s, dx_m).alias("dy"))


def with_imputer(vectors: DataFrame, impute: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's imputer, called once for each hour with that hour's rows."""
    return vectors.groupBy("t_idx").applyInPandas(impute, schema)


def predict_held_out(vectors: DataFrame, placed: DataFrame, held: DataFrame, length: float = 4.0) -> DataFrame:
    """``t_idx, station_id, ux, vy, obs_ux, obs_vy``: held-out stations predicted by the rest alone."""
    sites = few(placed.select("station_id", "sx", "sy"))
    valid = vectors.where("vector_valid").join(sites, "station_id")
    inputs = valid.join(held.select("station_id"), "station_id", "left_anti").select("t_idx", "sx", "sy", "ux", "vy")
    targets = valid.join(held.select("station_id"), "station_id", "left_semi").select("t_idx", "station_id", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("ux").alias("obs_ux"), F.col("vy").alias("obs_vy"))
    return interpolate(targets, inputs, ["t_idx"], ["ux", "vy"], length)


def scores(predicted: DataFrame, *keys: str) -> DataFrame:
    """Vector RMSE, circular direction and speed errors, and the number of rows."""
    ux, vy, ox, oy = (F.col(c) for c in ("ux", "vy", "obs_ux", "obs_vy"))
    return predicted.groupBy(*keys).agg(
        F.sqrt(F.avg((ux - ox) ** 2 + (vy - oy) ** 2)).alias("vector_rmse"), F.avg(w.direction_error(w.direction(ux, vy), w.direction(ox, oy))).alias("direction_mae"),
        F.avg(F.abs(w.speed(ux, vy) - w.speed(ox, oy))).alias("speed_mae"), F.count("*").alias("n"),
    )


def adopted(results: DataFrame, candidate: str) -> DataFrame:
    """Whether the candidate beats every baseline; ``results(method, vector_rmse)``."""
    own = F.max(F.when(F.col("method") == candidate, F.col("vector_rmse")))
    best = F.min(F.when(F.col("method") != candidate, F.col("vector_rmse")))
    return results.agg(own.alias("candidate"), best.alias("best_baseline"), (own < best).alias("adopted"))


def first_per_cell(placed: DataFrame) -> DataFrame:
    """Stations kept for observation: the first of each grid cell, numbered in cell order."""
    kept = placed.withColumn("_r", F.row_number().over(Window.partitionBy("ix", "iy").orderBy("station_id"))).where("_r = 1").drop("_r")
    return kept.withColumn("sensor_idx", F.row_number().over(Window.orderBy("station_id")).cast("long") - 1)


def ensemble(vectors: DataFrame, placed: DataFrame, n_members: int, method: str, seed: str, scale: float = 0.1) -> DataFrame:
    """``member_id, t_idx, sx, sy, ux, vy, ensemble_kind``: station bootstrap by hash draws, or perturbed vectors."""
    members = vectors.sparkSession.range(n_members).select(F.col("id").alias("member_id"))
    valid = vectors.where("vector_valid").join(few(placed.select("station_id", "sx", "sy")), "station_id").select("t_idx", "station_id", "sx", "sy", "ux", "vy")
    kind = F.lit("transport").alias("ensemble_kind")
    if method == "perturb":
        def noise(which: str):
            a, b = (F.pmod(F.xxhash64(F.lit(seed), F.lit(which + k), "member_id", "t_idx", "station_id"), F.lit(1 << 30)) for k in "ab")
            return F.sqrt(-2 * F.log((a + 0.5) / float(1 << 30))) * F.cos(2 * F.pi() * b / float(1 << 30)) * scale

        return valid.join(few(members)).select("member_id", "t_idx", "sx", "sy", (F.col("ux") + noise("x")).alias("ux"), (F.col("vy") + noise("y")).alias("vy"), kind)
    numbered = placed.select("station_id", (F.row_number().over(Window.orderBy("station_id")) - 1).alias("place"))
    n = numbered.count()
    draws = members.join(vectors.sparkSession.range(n).select(F.col("id").alias("slot"))).withColumn("place", F.pmod(F.xxhash64(F.lit(seed), "member_id", "slot"), F.lit(n)).cast("int"))
    drawn = draws.join(numbered, "place").groupBy("member_id", "station_id").agg(F.count("*").alias("times"))
    return valid.join(drawn, "station_id").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("member_id", "t_idx", "sx", "sy", "ux", "vy", kind)


def neighbours(rows: DataFrame, radius: int, k: int) -> DataFrame:
    """``station_id, t_idx, slot, n_station, n_t`` : the first k observations within ±radius hours, in station-major order, not itself; missing slots repeat slot 1.

    ``rows(station_id, t_idx, allowed)``. An equi join on exploded hours; hours are clamped at the ends.
    """
    ends = rows.agg(F.min("t_idx").alias("_lo"), F.max("t_idx").alias("_hi"))
    near = rows.join(F.broadcast(ends)).select("station_id", "t_idx", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda d: F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.col("t_idx") + d))))).alias("n_t"))
    seen = rows.where("allowed").select(F.col("station_id").alias("n_station"), F.col("t_idx").alias("n_t"))
    pairs = near.join(seen, "n_t").where("not (n_station = station_id and n_t = t_idx)")
    first = pairs.withColumn("slot", F.row_number().over(Window.partitionBy("station_id", "t_idx").orderBy("n_station", "n_t"))).where(F.col("slot") <= k)
    slots = rows.select("station_id", "t_idx", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("slot"))
    own = slots.join(first, ["station_id", "t_idx", "slot"], "left")
    pad = Window.partitionBy("station_id", "t_idx")
    return own.select("station_id", "t_idx", "slot", F.coalesce("n_station", F.max(F.when(F.col("slot") == 1, F.col("n_station"))).over(pad)).alias("n_station"), F.coalesce("n_t", F.max(F.when(F.col("slot") == 1, F.col("n_t"))).over(pad)).alias("n_t"))


def supervision(panel: DataFrame, placed: DataFrame, held: DataFrame) -> DataFrame:
    """Training rows: unit (x, y, t), a station-major number and the part by held-out station."""
    lim = placed.agg(F.min("lon").alias("_x0"), F.max("lon").alias("_x1"), F.min("lat").alias("_y0"), F.max("lat").alias("_y1"))
    hours = panel.agg((F.max("t_idx") + 1).alias("_n"))
    own = panel.where("vector_valid").join(few(placed), "station_id").join(few(held.select("station_id", "held_out")), "station_id").join(F.broadcast(lim)).join(F.broadcast(hours))
    return own.select(
        (F.col("station_id") * F.col("_n") + F.col("t_idx")).alias("linear_id"), w.to_unit(F.col("lon"), F.col("_x0"), F.col("_x1")).alias("x"), w.to_unit(F.col("lat"), F.col("_y0"), F.col("_y1")).alias("y"),
        (F.col("t_idx") / F.greatest(F.col("_n") - 1, F.lit(1))).alias("t"), F.when(F.col("held_out"), "validation").otherwise("train").alias("part"), "ux", "vy",
    )

"""Gridded inventories and activities as long tables.

``inventory(source_idx, ix, iy, mass)`` is sparse: an absent cell is zero, so means
divide by all cells and percentiles see the zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock


def crop(inventory: DataFrame, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """Cells of the half-open window, indices from 0 again."""
    return inventory.where(F.col("ix").between(x0, x1 - 1) & F.col("iy").between(y0, y1 - 1)).withColumns({"ix": F.col("ix") - x0, "iy": F.col("iy") - y0})


def densify(inventory: DataFrame, nx: int, ny: int) -> DataFrame:
    sources = inventory.select("source_idx").distinct()
    grid = inventory.sparkSession.range(nx * ny).select(F.floor(F.col("id") / ny).alias("ix"), (F.col("id") % ny).alias("iy"))
    return sources.join(F.broadcast(grid)).join(inventory, ["source_idx", "ix", "iy"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))


def normalized(inventory: DataFrame, nx: int, ny: int, eps: float = 1e-8) -> DataFrame:
    """Each source over its own 99th percentile (linear) of all cells; a source with none is all zero and has scale 1."""
    p99 = densify(inventory, nx, ny).groupBy("source_idx").agg(F.expr("percentile(mass, 0.99)").alias("p99"))
    scale = F.when(F.col("p99") <= eps, 1.0).otherwise(F.col("p99"))
    return inventory.join(p99, "source_idx").withColumn("mass", F.when(F.col("p99") <= eps, 0.0).otherwise(F.col("mass") / (F.col("p99") + eps))).withColumn("scale", scale).drop("p99")


def profile(inventory: DataFrame, nx: int, ny: int) -> DataFrame:
    """Least and largest mass, 99th percentile, nonzero cells and an all-zero flag of each source."""
    return densify(inventory, nx, ny).groupBy("source_idx").agg(
        F.min("mass").alias("least"), F.max("mass").alias("most"), F.expr("percentile(mass, 0.99)").alias("p99"), F.count_if(F.col("mass") != 0).alias("nonzero"), (F.max(F.abs("mass")) == 0).alias("all_zero")
    )


def coarsen(inventory: DataFrame, nx: int, ny: int, to_x: int, to_y: int) -> DataFrame:
    """Block means where sizes divide, else the nearest cell of an even grid; nothing is renormalized."""
    if nx % to_x == 0 and ny % to_y == 0:
        fx, fy = nx // to_x, ny // to_y
        return inventory.groupBy("source_idx", F.floor(F.col("ix") / fx).alias("ix"), F.floor(F.col("iy") / fy).alias("iy")).agg((F.sum("mass") / (fx * fy)).alias("mass"))
    spark = inventory.sparkSession

    def picks(n: int, to: int, name: str) -> DataFrame:
        return spark.range(to).select(F.col("id").alias(f"to_{name}"), F.rint(F.col("id") * ((n - 1) / max(1, to - 1))).cast("long").alias(name))

    out = inventory.join(F.broadcast(picks(nx, to_x, "ix")), "ix").join(F.broadcast(picks(ny, to_y, "iy")), "iy")
    return out.select("source_idx", F.col("to_ix").alias("ix"), F.col("to_iy").alias("iy"), "mass")


def grouped(inventory: DataFrame, groups: DataFrame) -> DataFrame:
    """``group_idx, ix, iy, mass``: the mean over a group's sources, absent cells as zero. ``groups(source_idx, group_idx)``."""
    sizes = groups.groupBy("group_idx").agg(F.count("*").alias("_n"))
    return inventory.join(F.broadcast(groups), "source_idx").groupBy("group_idx", "ix", "iy").agg(F.sum("mass").alias("mass")).join(F.broadcast(sizes), "group_idx").withColumn("mass", F.col("mass") / F.col("_n")).drop("_n")


def above(inventory: DataFrame, threshold: float = 1e-6) -> DataFrame:
    return inventory.where(F.col("mass") > threshold)


def cell_count_guard(inventory: DataFrame, threshold: float, most: int) -> DataFrame:
    """``n_cells, ok``: distinct active cells against a cap."""
    return above(inventory, threshold).agg(F.count_distinct("ix", "iy").alias("n_cells")).withColumn("ok", F.col("n_cells") <= most)


def shift(inventory: DataFrame, dx: int, dy: int, nx: int, ny: int) -> DataFrame:
    moved = inventory.withColumns({"ix": F.col("ix") + dx, "iy": F.col("iy") + dy})
    return moved.where(F.col("ix").between(0, nx - 1) & F.col("iy").between(0, ny - 1))


def rescale(inventory: DataFrame, factor: float, nx: int, ny: int) -> DataFrame:
    """Extent scaled about each source's mass centroid, nearest neighbour."""
    center = inventory.groupBy("source_idx").agg((F.sum(F.col("mass") * F.col("ix")) / F.sum("mass")).alias("cx"), (F.sum(F.col("mass") * F.col("iy")) / F.sum("mass")).alias("cy"))
    grid = inventory.sparkSession.range(nx * ny).select(F.floor(F.col("id") / ny).alias("tx"), (F.col("id") % ny).alias("ty"))
    back = center.join(F.broadcast(grid)).select("source_idx", "tx", "ty", F.rint(F.col("cx") + (F.col("tx") - F.col("cx")) / factor).cast("long").alias("ix"), F.rint(F.col("cy") + (F.col("ty") - F.col("cy")) / factor).cast("long").alias("iy"))
    return back.join(inventory, ["source_idx", "ix", "iy"]).select("source_idx", F.col("tx").alias("ix"), F.col("ty").alias("iy"), "mass")


def swap(inventory: DataFrame, a: int, b: int) -> DataFrame:
    return inventory.withColumn("source_idx", F.when(F.col("source_idx") == a, b).when(F.col("source_idx") == b, a).otherwise(F.col("source_idx")).cast("long"))


def emissions(inventory: DataFrame, activity: DataFrame) -> DataFrame:
    """``t_idx, ix, iy, emission``: the sum over sources of activity times mass."""
    return activity.join(inventory, "source_idx").groupBy("t_idx", "ix", "iy").agg(F.sum(F.col("theta") * F.col("mass")).alias("emission"))


def activity_from_basis(basis: DataFrame, coefficients: DataFrame, strict: bool = True) -> DataFrame:
    """``t_idx, source_idx, theta``; a negative activity is an error if ``strict``."""
    out = basis.join(F.broadcast(coefficients), "basis_idx").groupBy("t_idx", "source_idx").agg(F.sum(F.col("phi") * F.col("c")).alias("theta"))
    if strict and not out.where("theta < 0").isEmpty():
        raise ValueError("negative activity")
    return out


def profiles(hours: DataFrame, names: DataFrame) -> DataFrame:
    """Default activities of ``names(source_idx, source_name)`` at ``hours(t_idx, ts)``."""
    return hours.join(F.broadcast(names)).select("t_idx", "source_idx", "source_name", "ts", clock.activity(F.col("source_name"), F.col("t_idx"), F.hour("ts").cast("double")).alias("theta"))


def contribution(activity: DataFrame) -> DataFrame:
    """Total, and share of hours above half of the largest activity (0 if that is not positive), by source."""
    top = F.max("theta").over(Window.partitionBy("source_idx"))
    busy = F.when(F.col("_top") > 0, (F.col("theta") > 0.5 * F.col("_top")).cast("double")).otherwise(0.0)
    return activity.withColumn("_top", top).groupBy("source_idx").agg(F.sum("theta").alias("total"), F.avg(busy).alias("active_fraction"))


def diurnal(activity: DataFrame) -> DataFrame:
    """Mean by hour of the day, 0 where there is none."""
    hours = activity.sparkSession.range(24).select(F.col("id").alias("hour"))
    means = activity.groupBy("source_idx", F.hour("ts").cast("long").alias("hour")).agg(F.avg("theta").alias("theta"))
    grid = activity.select("source_idx").distinct().join(F.broadcast(hours))
    return grid.join(means, ["source_idx", "hour"], "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)))


def daily(activity: DataFrame) -> DataFrame:
    return activity.groupBy("source_idx", F.to_date("ts").alias("day")).agg(F.sum("theta").alias("theta"))


def input_checks(inventory: DataFrame, names: DataFrame, sensors: DataFrame, nx: int, ny: int) -> DataFrame:
    """``check_name, n_violations`` of maps, names and sensors, each table in one aggregate."""
    def rows(df: DataFrame, **checks) -> DataFrame:
        made = df.agg(*[c.cast("long").alias(n) for n, c in checks.items()])
        return made.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.coalesce(n, F.lit(0)).alias("n_violations")) for n in checks])).alias("r")).select("r.*")

    from ..functions.wind import inside

    return (
        rows(inventory, maps_finite_nonnegative=F.count_if(F.col("mass").isNull() | F.isnan("mass") | (F.col("mass") < 0)))
        .unionByName(rows(names, names_unique=F.count("*") - F.count_distinct("source_name"), names_nonempty=F.count_if(F.coalesce(F.trim("source_name"), F.lit("")) == "")))
        .unionByName(rows(sensors, sensors_inside=F.count_if(~inside(F.col("x"), F.col("y"), nx, ny))))
    )


def setting_checks(activity: DataFrame, dt: float, lag: int, dispersion: tuple[float, ...]) -> DataFrame:
    """``check_name, n_violations``: activities ``theta`` finite and not negative; step, lag and dispersions positive."""
    theta = F.count_if(F.col("theta").isNull() | F.isnan("theta") | (F.col("theta") < 0))
    declared = [("dt_positive", int(not dt > 0)), ("lag_positive", int(not lag > 0)), ("dispersion_positive", sum(not d > 0 for d in dispersion))]
    rows = [F.struct(F.lit("activity_finite_nonnegative").alias("check_name"), F.col("_n").alias("n_violations"))]
    rows += [F.struct(F.lit(n).alias("check_name"), F.lit(v).cast("long").alias("n_violations")) for n, v in declared]
    return activity.agg(theta.alias("_n")).select(F.explode(F.array(*rows)).alias("r")).select("r.*")

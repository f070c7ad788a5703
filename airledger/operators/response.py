"""Lagged response of sensors to gridded sources under transported puffs.

Under a city wind a puff's displacement depends on its release time alone, so substeps
are cumulated once for each release and joined to cells; lags are exploded and joined
by equality. Kernel rows stream into the partial aggregation of the response, and the
same rows serve footprints.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wind as w
from .bounded import few


def paths(city: DataFrame, lag: int, per_hour: int = 4) -> DataFrame:
    """``tau, j, px, py``: displacement after substep ``j`` (from 1) of a release at ``tau``; left endpoints, wind linear in time and clamped at the end.

    ``city(t_idx, vx, vy)`` by hours without gaps. Substeps divide the hour, so prefix sums
    are exact. Hours of several settings may stand apart in one table (see study.spread()).
    """
    after = city.select((F.col("t_idx") - 1).alias("t_idx"), F.col("vx").alias("_vx"), F.col("vy").alias("_vy"))
    hours = city.join(after, "t_idx", "left").select("t_idx", "vx", "vy", F.coalesce("_vx", "vx").alias("vx1"), F.coalesce("_vy", "vy").alias("vy1"))
    part = F.col("k") / per_hour
    steps = hours.select("t_idx", "vx", "vy", "vx1", "vy1", F.explode(F.sequence(F.lit(0), F.lit(per_hour - 1))).alias("k")).select(
        "t_idx", "k", ((F.col("vx") * (1 - part) + F.col("vx1") * part) / per_hour).alias("sx"), ((F.col("vy") * (1 - part) + F.col("vy1") * part) / per_hour).alias("sy")
    )
    releases = city.select(F.col("t_idx").alias("tau"), F.explode(F.sequence(F.lit(0), F.lit(max(0, lag - 2)))).alias("later")).withColumn("t_idx", F.col("tau") + F.col("later"))
    so_far = Window.partitionBy("tau").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return releases.join(steps, "t_idx").withColumn("j", F.col("later") * per_hour + F.col("k") + 1).select("tau", "j", F.sum("sx").over(so_far).alias("px"), F.sum("sy").over(so_far).alias("py"))


def flights(city: DataFrame, lag: int, nx: int, ny: int, per_hour: int = 4) -> DataFrame:
    """``tau, ends array<lag, px, py, wx, wy>, out_x array, out_y array``: one row for each release hour.

    ``out_x[ix]`` is the first substep at which a release from column ``ix`` has left the domain
    sideways (null if it never does), ``out_y[iy]`` likewise; a cell's exit is the earlier of the
    two. So exits cost columns plus rows of the grid for each hour, not cells, and need no join.
    """
    way = paths(city, lag, per_hour).groupBy("tau").agg(F.sort_array(F.collect_list(F.struct("j", "px", "py"))).alias("_way"))  # a few substeps a lag
    none = F.array().cast("array<struct<j: int, px: double, py: double>>")
    own = city.select(F.col("t_idx").alias("tau"), "vx", "vy").join(way, "tau", "left").withColumn("_way", F.coalesce("_way", none))

    def first_out(n: int, step: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_min(F.transform(F.filter("_way", lambda p: ~(i + p[step]).between(-0.5, n - 0.5)), lambda p: p.j)))

    at_hour = lambda p: F.struct((p.j / per_hour).cast("long").alias("lag"), p.px.alias("px"), p.py.alias("py"), (p.px / (p.j / per_hour)).alias("wx"), (p.py / (p.j / per_hour)).alias("wy"))
    start = F.struct(F.lit(0).cast("long").alias("lag"), F.lit(0.0).alias("px"), F.lit(0.0).alias("py"), F.col("vx").alias("wx"), F.col("vy").alias("wy"))
    later = F.transform(F.filter("_way", lambda p: p.j % per_hour == 0), at_hour)
    return own.select("tau", F.concat(F.array(start), later).alias("ends"), first_out(nx, "px").alias("out_x"), first_out(ny, "py").alias("out_y"))


def puffs(cells: DataFrame, city: DataFrame, lag: int, nx: int, ny: int, per_hour: int = 4) -> tuple[DataFrame, DataFrame]:
    """(puffs, exits): ``ix, iy, tau, lag, x, y, wx, wy`` of puffs still inside, and ``ix, iy, tau, exit_j`` of those that leave.

    A puff ends at its first substep outside the domain. At lag 0 it stands at its cell and the
    wind is that of its release. Cells are a grid's; their number is checked before they are
    broadcast (see few()).
    """
    each = flights(city, lag, nx, ny, per_hour).join(few(cells, nx * ny)).withColumn("exit_j", F.least(F.get("out_x", F.col("ix")), F.get("out_y", F.col("iy"))))
    exits = each.where("exit_j is not null").select("ix", "iy", "tau", "exit_j")
    inside = each.select("ix", "iy", "tau", F.explode(F.filter("ends", lambda e: F.col("exit_j").isNull() | (e.lag * per_hour < F.col("exit_j")))).alias("e"))
    return inside.select("ix", "iy", "tau", "e.lag", (F.col("ix") + F.col("e.px")).alias("x"), (F.col("iy") + F.col("e.py")).alias("y"), "e.wx", "e.wy"), exits


def kernel(puffs_: DataFrame, sensors: DataFrame, hours: DataFrame, keep: list[str] | None = None, **dispersion: float | Column) -> DataFrame:
    """``t_idx, tau, lag, sensor_idx, ix, iy, g`` (and columns of the puffs named in ``keep``) at hours that exist; ``sensors(sensor_idx, sx, sy)`` are few and broadcast. Dispersion (along, across, least_age) may be columns of the puffs."""
    arrived = puffs_.withColumn("t_idx", F.col("tau") + F.col("lag")).join(hours.select("t_idx"), "t_idx", "left_semi")
    g = w.puff(F.col("sx") - F.col("x"), F.col("sy") - F.col("y"), F.col("wx"), F.col("wy"), F.col("lag").cast("double"), **dispersion)
    return arrived.join(few(sensors)).select("t_idx", "tau", "lag", "sensor_idx", "ix", "iy", g.alias("g"), *(keep or []))


def response(kernel_: DataFrame, inventory: DataFrame, basis: DataFrame, lag: int | None = None, trim: int = 0, threshold: float = 1e-6, admissible: DataFrame | None = None) -> DataFrame:
    """``t_idx, sensor_idx, source_idx, basis_idx, h``: mass times basis at the release times kernel, summed.

    Cells at or below the threshold and zero basis values are skipped; ``trim`` drops warm-up rows; nothing is renormalized.
    With ``admissible(source_idx, basis_idx)`` other columns are never computed: masses meet
    their bases before they meet kernel rows (see also emitting()).
    """
    rows = kernel_ if lag is None else kernel_.where(F.col("lag") < lag)
    if admissible is not None:
        own = few(inventory.where(F.col("mass") > threshold).join(few(admissible), "source_idx"))
        rows = rows.where(F.col("t_idx") >= trim).join(own, ["ix", "iy"]).join(basis.where("phi <> 0").withColumnRenamed("t_idx", "tau"), ["tau", "basis_idx"])
        return rows.groupBy("t_idx", "sensor_idx", "source_idx", "basis_idx").agg(F.sum(F.col("mass") * F.col("phi") * F.col("g")).alias("h"))
    rows = rows.where(F.col("t_idx") >= trim).join(few(inventory.where(F.col("mass") > threshold)), ["ix", "iy"])
    rows = rows.join(basis.where("phi <> 0").withColumnRenamed("t_idx", "tau"), "tau")
    return rows.groupBy("t_idx", "sensor_idx", "source_idx", "basis_idx").agg(F.sum(F.col("mass") * F.col("phi") * F.col("g")).alias("h"))


def emitting(puffs_: DataFrame, inventory: DataFrame, basis: DataFrame, admissible: DataFrame, threshold: float = 1e-6) -> DataFrame:
    """Puffs of releases that any admissible column has mass for: a semi join before the kernel is computed."""
    cells = few(inventory.where(F.col("mass") > threshold).join(few(admissible), "source_idx").select("ix", "iy", "basis_idx").distinct())
    hours = basis.where("phi <> 0").select(F.col("t_idx").alias("tau"), "basis_idx").distinct()
    return puffs_.join(hours.join(cells, "basis_idx").select("ix", "iy", "tau").distinct(), ["ix", "iy", "tau"], "left_semi")


def wide_response(kernel_: DataFrame, inventory: DataFrame, basis: DataFrame, columns: list[tuple[int, int]], by: list[str], threshold: float = 1e-6) -> DataFrame:
    """``by..., h<source>_<basis>``: the response of declared columns side by side, 0 where nothing arrives.

    Masses of a cell and basis values of an hour are put side by side first, so every kernel row
    stays one row and adds to all columns at once.
    """
    sources, bases = sorted({s for s, _ in columns}), sorted({b for _, b in columns})
    mass = inventory.where(F.col("mass") > threshold).groupBy("ix", "iy").pivot("source_idx", sources).agg(F.sum("mass"))
    phi = basis.groupBy(F.col("t_idx").alias("tau")).pivot("basis_idx", bases).agg(F.sum("phi"))
    mass = mass.select("ix", "iy", *[F.coalesce(F.col(str(s)), F.lit(0.0)).alias(f"_m{s}") for s in sources])
    phi = phi.select("tau", *[F.coalesce(F.col(str(b)), F.lit(0.0)).alias(f"_p{b}") for b in bases])
    rows = kernel_.join(few(mass), ["ix", "iy"]).join(phi, "tau")
    return rows.groupBy(*by).agg(*[F.sum(F.col(f"_m{s}") * F.col(f"_p{b}") * F.col("g")).alias(f"h{s}_{b}") for s, b in columns])


def cell_response(kernel_: DataFrame, basis: DataFrame) -> DataFrame:
    """``sensor_idx, ix, iy, basis_idx, pull``: the same kernel rows summed by cell instead of by source."""
    return kernel_.join(basis.where("phi <> 0").withColumnRenamed("t_idx", "tau"), "tau").groupBy("sensor_idx", "ix", "iy", "basis_idx").agg(F.sum(F.col("phi") * F.col("g")).alias("pull"))


def footprints(pull: DataFrame, inventory: DataFrame, coefficients: DataFrame) -> DataFrame:
    """``sensor_idx, ix, iy, geometric, fitted``: all basis pulls of a cell, and its part of the fitted signal."""
    geometric = pull.groupBy("sensor_idx", "ix", "iy").agg(F.sum("pull").alias("geometric"))
    fitted = pull.join(few(inventory), ["ix", "iy"]).join(few(coefficients), ["source_idx", "basis_idx"]).groupBy("sensor_idx", "ix", "iy").agg(F.sum(F.col("mass") * F.col("c") * F.col("pull")).alias("fitted"))
    return geometric.join(fitted, ["sensor_idx", "ix", "iy"], "left").withColumn("fitted", F.coalesce("fitted", F.lit(0.0)))


def localization(footprint: DataFrame, truth: DataFrame, radius: float) -> DataFrame:
    """Distance of the mass centroid to the nearest true source, and the mass share within ``radius`` of one, at most 1."""
    own = footprint.where("fitted > 0")
    center = own.groupBy("sensor_idx").agg((F.sum(F.col("fitted") * F.col("ix")) / F.sum("fitted")).alias("cx"), (F.sum(F.col("fitted") * F.col("iy")) / F.sum("fitted")).alias("cy"))
    gap = center.join(few(truth)).groupBy("sensor_idx").agg(F.min(F.hypot(F.col("cx") - F.col("sx"), F.col("cy") - F.col("sy"))).alias("distance"))
    near = own.join(few(truth)).groupBy("sensor_idx", "ix", "iy", "fitted").agg(F.min(F.hypot(F.col("ix") - F.col("sx"), F.col("iy") - F.col("sy"))).alias("d"))
    share = near.groupBy("sensor_idx").agg(F.least(F.lit(1.0), F.sum(F.when(F.col("d") <= radius, F.col("fitted")).otherwise(0.0)) / F.sum("fitted")).alias("mass_within"))
    return gap.join(share, "sensor_idx")


#: Nodes of the quadrature in a cell, along each axis.
NODES = (-0.4, -0.2, 0.0, 0.2, 0.4)


def retained(puffs_: DataFrame, nx: int, ny: int, truncation: float = 4.0, along: float = 0.7, across: float = 0.25, least_age: float = 0.25) -> DataFrame:
    """Puffs with ``raw``: the part of each density that falls on the grid, by 5 x 5 nodes in every cell of the box of ``truncation`` deviations around it.

    Opt-in, since a puff costs some thousand values. It is a sum over nodes, so it may exceed 1 a little.
    """
    import numpy as np

    def run(batches):
        nodes = np.array(NODES)
        for pdf in batches:
            raw = np.zeros(len(pdf))
            for lag, part in pdf.groupby("lag", sort=False):
                old = max(float(lag), least_age)
                vp, vq = along * along * old, across * across * old
                radius = truncation * max(vp, vq) ** 0.5
                reach = np.arange(int(np.ceil(2 * radius)) + 3)
                at = pdf.index.get_indexer(part.index)
                for lo in range(0, len(at), 256):
                    some = at[lo : lo + 256]
                    x, y, wx, wy = (pdf[c].to_numpy()[some] for c in ("x", "y", "wx", "wy"))
                    norm = np.hypot(wx, wy)
                    still = norm <= 1e-8
                    ex, ey = np.where(still, 1.0, wx / np.where(still, 1.0, norm)), np.where(still, 0.0, wy / np.where(still, 1.0, norm))
                    axes = []
                    for c, n in ((x, nx), (y, ny)):
                        cell = np.floor(c - radius)[:, None] + reach
                        ok = (cell >= 0) & (cell <= n - 1) & (cell <= np.ceil(c + radius)[:, None])
                        axes.append(((cell[:, :, None] + nodes - c[:, None, None]).reshape(len(c), -1), np.repeat(ok, len(nodes), axis=1)))
                    (dx, ox), (dy, oy) = axes
                    a = dx[:, :, None] * ex[:, None, None] + dy[:, None, :] * ey[:, None, None]
                    b = -dx[:, :, None] * ey[:, None, None] + dy[:, None, :] * ex[:, None, None]
                    g = np.exp(-0.5 * (a * a / vp + b * b / vq)) / (2 * np.pi * (vp * vq) ** 0.5)
                    raw[some] = (g * ox[:, :, None] * oy[:, None, :]).sum(axis=(1, 2)) / len(nodes) ** 2
            yield pdf.assign(raw=raw)

    own = puffs_.select("ix", "iy", "tau", "lag", "x", "y", "wx", "wy")
    return own.mapInPandas(run, "ix long, iy long, tau long, lag long, x double, y double, wx double, wy double, raw double")


def mass_accounting(retained_: DataFrame, hours: DataFrame, inventory: DataFrame, basis: DataFrame, trim: int = 0, threshold: float = 1e-6) -> DataFrame:
    """``source_idx, basis_idx, emitted, retained, dropped, n_kernels, n_clipped, largest``: kernel mass of each column; nothing is renormalized.

    Every puff counts at each hour it arrives in. A part beyond 0 to 1 is clipped and counted.
    """
    rows = retained_.withColumn("t_idx", F.col("tau") + F.col("lag")).where(F.col("t_idx") >= trim).join(hours.select("t_idx"), "t_idx", "left_semi").drop("t_idx")
    rows = rows.join(few(inventory.where(F.col("mass") > threshold)), ["ix", "iy"]).join(basis.withColumnRenamed("t_idx", "tau"), "tau")
    amount = F.col("mass") * F.col("phi")
    part = F.least(F.greatest(F.col("raw"), F.lit(0.0)), F.lit(1.0))
    return rows.where(amount > 0).groupBy("source_idx", "basis_idx").agg(
        F.sum(amount).alias("emitted"), F.sum(amount * part).alias("retained"), F.sum(amount * (1 - part)).alias("dropped"), F.count("*").alias("n_kernels"),
        F.count_if((F.col("raw") < 0) | (F.col("raw") > 1)).alias("n_clipped"), F.max("raw").alias("largest"),
    )


def exit_accounting(exits: DataFrame, inventory: DataFrame, basis: DataFrame) -> DataFrame:
    """Releases that leave the domain, and their mass, by column."""
    return exits.join(few(inventory.where("mass > 0")), ["ix", "iy"]).join(basis.where("phi <> 0").withColumnRenamed("t_idx", "tau"), "tau").groupBy("source_idx", "basis_idx").agg(F.count("*").alias("n_exits"), F.sum(F.col("mass") * F.col("phi")).alias("mass"))


def lag_convergence(kernel_: DataFrame, inventory: DataFrame, basis: DataFrame, lags: list[int], tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(``lag, delta``, ``chosen``): relative Frobenius change from each lag to the next, and the smallest within tolerance, else the largest."""
    spark = kernel_.sparkSession
    terms = kernel_.join(few(inventory), ["ix", "iy"]).join(basis.withColumnRenamed("t_idx", "tau"), "tau").select("t_idx", "sensor_idx", "source_idx", "basis_idx", "lag", (F.col("mass") * F.col("phi") * F.col("g")).alias("v"))
    grids = terms.join(F.broadcast(spark.createDataFrame([(x,) for x in lags], "cut long"))).groupBy("t_idx", "sensor_idx", "source_idx", "basis_idx", "cut").agg(F.sum(F.when(F.col("lag") < F.col("cut"), F.col("v")).otherwise(0.0)).alias("h"))
    nxt = F.lead("h").over(Window.partitionBy("t_idx", "sensor_idx", "source_idx", "basis_idx").orderBy("cut"))
    deltas = grids.withColumn("next", nxt).where("next is not null").groupBy(F.col("cut").alias("lag")).agg((F.sqrt(F.sum((F.col("next") - F.col("h")) ** 2)) / F.greatest(F.sqrt(F.sum(F.col("next") ** 2)), F.lit(1e-12))).alias("delta"))
    chosen = deltas.agg(F.coalesce(F.min(F.when(F.col("delta") <= tolerance, F.col("lag"))), F.lit(max(lags)).cast("long")).alias("chosen"))
    return deltas, chosen


def moments(rows: DataFrame) -> DataFrame:
    """``t_idx, var_x, var_y``: second central moments of ``rows(t_idx, sx, sy, v)`` over sensor positions; an hour without mass is an error."""
    m = F.sum("v")
    out = rows.groupBy("t_idx").agg(*[(F.sum(F.col("v") * F.col(c) ** 2) / F.nullif(m, F.lit(0.0)) - (F.sum(F.col("v") * F.col(c)) / F.nullif(m, F.lit(0.0))) ** 2).alias(f"var_{c[1]}") for c in ("sx", "sy")], m.alias("mass"))
    none = F.raise_error(F.concat(F.lit("no plume mass at hour "), F.col("t_idx").cast("string"))).cast("double")
    return out.select("t_idx", *[F.when(F.col("mass") > 0, F.col(c)).otherwise(none).alias(c) for c in ("var_x", "var_y")])


def aligned(response_: DataFrame, observed: DataFrame, sensors: DataFrame) -> DataFrame:
    """Response keys with their observation, matched by sensor number, else by sensor id."""
    named = observed.join(few(sensors.select("sensor_id", F.col("sensor_idx").alias("_at"))), "sensor_id", "left").withColumn("sensor_idx", F.coalesce("sensor_idx", "_at")).select("t_idx", "sensor_idx", "y")
    return response_.select("t_idx", "sensor_idx").distinct().join(named, ["t_idx", "sensor_idx"], "left")


def gridded(releases: DataFrame, field: DataFrame, sample: Callable, lag: int, nx: int, ny: int, per_hour: int = 4, window: int = 168, most: int = 100_000) -> DataFrame:
    """Puffs under a wind that differs in space: ``releases(ix, iy, tau)`` advected in tasks by ``sample(t, x, y)``.

    ``sample`` is any callable on arrays (see :func:`bilinear`). Releases and ``field(t_idx,
    ix, iy, dx, dy)`` are cogrouped by windows of hours; a window's field goes on for
    ``lag`` hours, so puffs fly on past its end and the rows are those of one window over
    all hours. Hours between the field's ends that it lacks are calm; beyond its ends the
    nearest hour's wind holds. A window whose grid could hold more than ``most`` releases is
    split by cells, and each part has the window's field. The rows are what kernel() takes:
    each puff has an orientation of its own.
    """
    import numpy as np

    parts = -(-nx * ny * window // most)

    def run(key: tuple, pdf: pd.DataFrame, wind: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pdf[["ix", "iy", "tau"]].assign(lag=0, x=0.0, y=0.0, wx=0.0, wy=0.0)
        wind = wind.drop(columns=["_at", "_of"]).rename(columns=lambda c: c[1:])
        lo, hi = max(pdf._lo.iloc[0], key[0] * window), min(pdf._hi.iloc[0], (key[0] + 1) * window - 1 + lag)
        calm = pd.DataFrame({"t_idx": sorted({lo, hi} - set(wind.t_idx)), "ix": 0, "iy": 0, "dx": 0.0, "dy": 0.0})
        at, pdf = sample(pd.concat([wind, calm]) if len(calm) else wind, nx, ny), pdf[["ix", "iy", "tau"]]
        x, y, tau = pdf.ix.to_numpy(float), pdf.iy.to_numpy(float), pdf.tau.to_numpy(float)
        inside, x0, y0, out = np.ones(len(pdf), bool), x.copy(), y.copy(), []
        for lag_ in range(lag):
            vx, vy = at(tau + lag_, x, y) if lag_ == 0 else ((x - x0) / lag_, (y - y0) / lag_)
            out.append(pdf.assign(lag=lag_, x=x, y=y, wx=vx, wy=vy)[inside])
            for k in range(per_hour):
                ux, uy = at(tau + lag_ + k / per_hour, x, y)
                x, y = np.where(inside, x + ux / per_hour, x), np.where(inside, y + uy / per_hour, y)
                inside &= (x >= -0.5) & (x <= nx - 0.5) & (y >= -0.5) & (y <= ny - 0.5)
        return pd.concat(out)

    ends = field.agg(F.min("t_idx").alias("_lo"), F.max("t_idx").alias("_hi"))
    of = lambda t: F.floor(t / window)
    own = releases.join(F.broadcast(ends)).withColumn("_window", of(F.greatest("_lo", F.least("_hi", "tau"))))
    own = own.withColumn("_part", F.pmod(F.xxhash64("ix", "iy"), F.lit(parts)).cast("int"))
    winds = field.select(*[F.col(c).alias(f"_{c}") for c in ("t_idx", "ix", "iy", "dx", "dy")], F.explode(F.sequence(of(F.col("t_idx") - lag), of(F.col("t_idx")))).alias("_at"))
    winds = winds.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return own.groupBy("_window", "_part").cogroup(winds.groupBy("_at", "_of")).applyInPandas(run, "ix long, iy long, tau long, lag long, x double, y double, wx double, wy double")


def bilinear(field: pd.DataFrame, nx: int, ny: int) -> Callable:
    """Bilinear in space (clamped), linear in time, of ``field(t_idx, ix, iy, dx, dy)``."""
    import numpy as np

    t0, t1 = int(field.t_idx.min()), int(field.t_idx.max())
    grid = np.zeros((t1 - t0 + 1, nx, ny, 2))
    grid[field.t_idx - t0, field.ix, field.iy] = field[["dx", "dy"]]

    def sample(t, x, y):
        t, x, y = np.clip(t - t0, 0, t1 - t0), np.clip(x, 0, nx - 1), np.clip(y, 0, ny - 1)
        a, i, j = (np.minimum(np.floor(v).astype(int), n) for v, n in ((t, max(0, t1 - t0 - 1)), (x, max(0, nx - 2)), (y, max(0, ny - 2))))
        out = 0.0
        for da, di, dj in np.ndindex(2, 2, 2):
            part = (t - a if da else 1 - t + a) * (x - i if di else 1 - x + i) * (y - j if dj else 1 - y + j)
            out = out + part[:, None] * grid[np.minimum(a + da, t1 - t0), np.minimum(i + di, nx - 1), np.minimum(j + dj, ny - 1)]
        return out[:, 0], out[:, 1]

    return sample

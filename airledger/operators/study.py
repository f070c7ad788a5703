"""Studies: grids of settings in one job, gates, comparisons, whole windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import factor as fa
from . import fit as fi
from . import groups as gr
from . import response as rs
from .bounded import few


def sweep(spark, **settings: list) -> DataFrame:
    """``config_id`` and a column for each setting: all combinations, as rows in front of one job."""
    out = spark.createDataFrame([(0,)], "_ int")
    for name, values in settings.items():
        out = out.join(spark.createDataFrame([(v,) for v in values], [name]))
    return out.drop("_").withColumn("config_id", F.row_number().over(Window.orderBy(*settings)).cast("long") - 1)


def identifiable(scenarios: DataFrame) -> DataFrame:
    """Adds ``unidentifiable``: merged, a weak column, low visibility, absorbed, a vanishing singular value or coherent columns."""
    bad = F.col("merged") | F.col("weak") | (F.col("visibility") <= 0.1) | (F.col("absorption") >= 0.9) | (F.col("sigma_j") <= 1e-6) | (F.col("coherence") >= 0.99)
    return scenarios.withColumn("unidentifiable", F.coalesce(bad, F.lit(False)))


def penalties(corrections: DataFrame) -> DataFrame:
    """``energy, smoothness, largest`` of hourly corrections ``(key, t_idx, dx, dy)``."""
    w = Window.partitionBy("key").orderBy("t_idx")
    step = (F.col("dx") - F.lag("dx").over(w)) ** 2 + (F.col("dy") - F.lag("dy").over(w)) ** 2
    return corrections.withColumn("_s", step).groupBy("key").agg(F.sum(F.col("dx") ** 2 + F.col("dy") ** 2).alias("energy"), F.coalesce(F.sum("_s"), F.lit(0.0)).alias("smoothness"), F.max(F.greatest(F.abs("dx"), F.abs("dy"))).alias("largest"))


def gate(candidates: DataFrame, eta: float = 0.05, rho: float = 0.99, eps: float = 0.25, box: float = 1.0) -> DataFrame:
    """Adds ``accepted`` and ``reasons``: a corrected candidate must keep identifiability, coherence, bounds and data fit."""
    rules = [
        ("sigma_fell", F.col("sigma_j") < (1 - eta) * F.col("sigma_j0")), ("coherent", F.col("coherence") > rho), ("correction_too_large", F.col("largest") > eps),
        ("outside_box", F.abs("psi") > box), ("fit_worse", F.col("needs_fit") & (F.col("data") > F.col("data0"))),
    ]
    reasons = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda r: r.isNotNull())
    return candidates.withColumn("reasons", F.concat_ws(",", reasons)).withColumn("accepted", F.size(reasons) == 0)


def refine(start: DataFrame, score, step: float = 0.05, shrink: float = 0.5, rounds: int = 40, floor: float = 1e-3, moved: list[str] | None = None, carried: list[str] | None = None, gain: float = 0.0) -> DataFrame:
    """Coordinate search over rows ``(key, p0, p1, ...)``: each round scores all ± candidates of all keys in one job and keeps each key's best; a key that doesn't gain shortens its step.

    ``score`` maps candidates to the same rows with ``value`` (less is better) and may move them
    into what is feasible; ``carried`` names further columns of its own that are kept. Only
    ``moved`` parameters (all by default) are searched. Ends when every step is below ``floor``.
    """
    names, extra = [c for c in start.columns if c != "key"], carried or []
    best = gr.durable(score(start).select("key", *names, *extra, "value").withColumn("step", F.lit(step)))
    for _ in range(rounds):
        moves = [F.struct(*[(F.col(n) + (F.col("step") * s if n == m else 0.0)).alias(n) for n in names]) for m in moved or names for s in (1.0, -1.0)]
        tried = score(best.where(F.col("step") >= floor).select("key", F.explode(F.array(*moves)).alias("c")).select("key", "c.*"))
        found = tried.groupBy("key").agg(F.min_by(F.struct(*names, *extra, "value"), F.struct("value", *names)).alias("b"))
        better = F.coalesce(F.col("b.value") < F.col("value") - gain, F.lit(False))
        kept = [F.when(better, F.col(f"b.{n}")).otherwise(F.col(n)).alias(n) for n in [*names, *extra, "value"]]
        best = gr.durable(best.join(found, "key", "left").select("key", *kept, F.when(better, F.col("step")).otherwise(F.col("step") * shrink).alias("step")))
        if best.where(F.col("step") >= floor).isEmpty():
            break
    return best


#: Corrections of a wind that a window may have: names of the parameters of its time basis (constant, then linear over the window), each for x and y.
CORRECTIONS = {"constant": ("ax0", "ay0"), "constant_linear": ("ax0", "ay0", "ax1", "ay1")}
#: Dispersion parameters: along, across, least age.
PSI = ("along", "across", "least_age")


def refined(
    city: DataFrame, cells: DataFrame, sensors: DataFrame, inventory: DataFrame, basis: DataFrame, rows: DataFrame, background: list[str], columns: list[tuple[int, int]], nx: int, ny: int, lag: int, *,
    window: int = 168, correction: str = "constant", dispersion: bool = True, psi0: tuple[float, float, float] = (0.7, 0.25, 0.25), lower: tuple = (0.1, 0.05, 0.05), upper: tuple = (3.0, 2.0, 5.0),
    eps: float = 0.25, eta: float = 0.05, rho: float = 0.99, needs_fit: bool = False, weight: float = 1.0, weight_psi: float = 1.0, smooth: float = 0.0, lam: float = 0.0, step: float = 0.05, rounds: int = 40, floor: float = 1e-4,
) -> DataFrame:
    """Constrained refinement of wind and dispersion around the fixed response, for every window at once.

    ``rows(t_idx, sensor_idx, y, background...)`` are observed rows; a window is a study of its
    own, of ``window`` hours. Each round's candidates (one step up or down in one parameter) of
    all windows are rows of one job: their winds are moved, puffs fly once for each different
    wind, the response is projected and fitted, and each window keeps its best candidate by
    data + penalties. Corrections are scaled back into ``eps`` and dispersion is held in its
    box before a candidate is tried, so all are feasible. The result is accepted if the
    smallest singular value keeps 1 - ``eta`` of its own and no pair's coherence exceeds
    ``rho`` (and, where asked or with a smoothness penalty, the data fit isn't worse); the
    fixed response stays the answer otherwise. Nothing is drawn, so runs agree.

    ``window_id``, the parameters, ``data, total, data0, total0, sigma_j, sigma_j0, coherence,
    largest, accepted, reasons``.
    """
    wind = CORRECTIONS[correction]
    names, moved = [*CORRECTIONS["constant_linear"], *PSI], [*wind, *(PSI if dispersion else ())]
    spans = city.groupBy(F.floor(F.col("t_idx") / window).alias("key")).agg(F.min("t_idx").alias("_lo"), F.count("*").alias("_T"))
    spans = gr.durable(spans)
    hours = gr.durable(city.withColumn("key", F.floor(F.col("t_idx") / window)).join(F.broadcast(spans), "key").withColumn("lin", F.when(F.col("_T") > 1, (F.col("t_idx") - F.col("_lo")) / (F.col("_T") - 1) - 0.5).otherwise(0.0)))
    peak = lambda a: F.greatest(F.abs(F.col(f"{a}0") - 0.5 * F.col(f"{a}1")), F.abs(F.col(f"{a}0") + 0.5 * F.col(f"{a}1")))  # noqa: E731  a correction linear in time is largest at an end
    seen = gr.durable(rows.withColumn("key", F.floor(F.col("t_idx") / window)))
    labels = [f"h{s}_{b}" for s, b in columns]
    ids = ["key", *names]

    def feasible(df: DataFrame) -> DataFrame:
        largest = F.greatest(peak("ax"), peak("ay"))
        df = df.withColumn("_f", F.when(largest > eps, eps / largest).otherwise(1.0)).withColumns({c: F.col(c) * F.col("_f") for c in CORRECTIONS["constant_linear"]}).drop("_f")
        return df.withColumns({c: F.least(F.greatest(F.col(c), F.lit(float(lo))), F.lit(float(hi))) for c, lo, hi in zip(PSI, lower, upper)})

    def score(candidates: DataFrame) -> DataFrame:
        tried = feasible(candidates).select(*ids, *[c for c in candidates.columns if c not in ids]).dropDuplicates(ids)
        number = Window.partitionBy("key").orderBy(*names)
        tried = gr.durable(tried.withColumns({"config_id": F.col("key") * 64 + F.row_number().over(number), "wind_id": F.col("key") * 64 + F.dense_rank().over(Window.partitionBy("key").orderBy(*CORRECTIONS["constant_linear"]))}))
        winds = tried.select("key", "wind_id", *CORRECTIONS["constant_linear"]).distinct().join(hours, "key")
        d = {"dx": F.col("ax0") + F.col("ax1") * F.col("lin"), "dy": F.col("ay0") + F.col("ay1") * F.col("lin")}
        winds = winds.withColumns(d).select("key", "wind_id", F.col("t_idx").alias("hour"), (F.col("wind_id") * STRIDE + F.col("t_idx")).alias("t_idx"), (F.col("vx") + F.col("dx")).alias("vx"), (F.col("vy") + F.col("dy")).alias("vy"), "dx", "dy")
        flying, _ = rs.puffs(cells, winds.select("t_idx", "vx", "vy"), lag, nx, ny)
        each = flying.withColumn("wind_id", config_of("tau")).join(few(tried.select("wind_id", "config_id", *PSI)), "wind_id")
        pulls = rs.kernel(each, sensors, winds, keep=["config_id"], **{c: F.col(c) for c in PSI})
        pulls = pulls.withColumns({"tau": F.col("tau") % STRIDE, "t_idx": F.col("t_idx") % STRIDE})
        wide = rs.wide_response(pulls, inventory, basis, columns, ["config_id", "t_idx", "sensor_idx"])
        factors = gr.durable(fa.factor(wide.join(seen, ["t_idx", "sensor_idx"]), "config_id", [*background, *labels, "y"]))
        n_q, n_h = len(background), len(labels)
        fitted = fi.fit(factors, "config_id", n_q, labels, lam=lam).groupBy("config_id").agg((F.first("residual_norm") ** 2).alias("data"), (lam * F.sum(F.col("c") ** 2)).alias("ridge"))
        spectra = fa.diagnostics(factors, "config_id", n_q, n_h).select("config_id", "sigma_j")
        pairs = fa.coherence(fa.projected_gram(factors, "config_id", n_q, n_h), "config_id").groupBy("config_id").agg(F.max("coherence").alias("coherence"))
        after = Window.partitionBy("wind_id").orderBy("hour")
        jump = (F.col("vx") - F.lag("vx").over(after)) ** 2 + (F.col("vy") - F.lag("vy").over(after)) ** 2
        costs = winds.withColumn("_jump", jump).groupBy("wind_id").agg((weight * F.sum(F.col("dx") ** 2 + F.col("dy") ** 2) + smooth * F.coalesce(F.sum("_jump"), F.lit(0.0))).alias("_w"), F.max(F.greatest(F.abs("dx"), F.abs("dy"))).alias("largest"))
        psi = sum(((F.col(c) - p) ** 2 for c, p in zip(PSI, psi0)), F.lit(0.0)) * weight_psi
        out = tried.join(fitted, "config_id").join(spectra, "config_id").join(pairs, "config_id", "left").join(costs, "wind_id")
        return out.withColumn("value", F.col("data") + F.col("ridge") + F.col("_w") + psi).drop("config_id", "wind_id", "ridge", "_w")

    zero = [F.lit(0.0).alias(c) for c in CORRECTIONS["constant_linear"]]
    start = seen.select("key").distinct().select("key", *zero, *[F.lit(float(p)).alias(c) for c, p in zip(PSI, psi0)])
    extra = ["data", "sigma_j", "coherence", "largest"]
    first = gr.durable(score(start).select("key", F.col("data").alias("data0"), F.col("value").alias("total0"), F.col("sigma_j").alias("sigma_j0")))
    best = refine(start, score, step, 0.5, rounds, floor, moved=moved, carried=extra, gain=1e-10)
    needed = needs_fit or smooth > 0
    found = best.join(first, "key").withColumns({"psi": F.lit(0.0), "needs_fit": F.lit(needed), "data0": F.col("data0") + 1e-9})
    gated = gate(found, eta, rho, eps + 1e-9)
    return gated.select(F.col("key").alias("window_id"), *names, "data", F.col("value").alias("total"), (F.col("data0") - 1e-9).alias("data0"), "total0", "sigma_j", "sigma_j0", "coherence", "largest", "accepted", "reasons")


def transport_ensemble(
    members: DataFrame, hours: DataFrame, cells: DataFrame, sensors: DataFrame, inventory: DataFrame, basis: DataFrame, rows: DataFrame, background: list[str], columns: list[tuple[int, int]], nx: int, ny: int, lag: int, scale: float = 1.0,
) -> DataFrame:
    """``member_id, ensemble_kind, name, c, std, residual_norm``: every drawn wind's own response and fit, all members in one job.

    ``members(member_id, t_idx, ux, vy, ensemble_kind)`` are drawn stations (spatial.ensemble());
    a member's wind is their mean of the hour times ``scale``, calm where none was drawn.
    ``rows(t_idx, sensor_idx, y, background...)``. Members of another kind than transport are an
    error, since their spread means something else.
    """
    kinds = [r.ensemble_kind for r in members.select("ensemble_kind").distinct().limit(2).collect()]
    if kinds and kinds != ["transport"]:
        raise ValueError("the members of a transport ensemble are all of that kind")
    drawn = members.groupBy("member_id", "t_idx").agg((F.avg("ux") * scale).alias("vx"), (F.avg("vy") * scale).alias("vy"))
    every = few(members.select("member_id").distinct()).join(hours.select("t_idx"))
    winds = every.join(drawn, ["member_id", "t_idx"], "left").na.fill(0.0, ["vx", "vy"]).select((F.col("member_id") * STRIDE + F.col("t_idx")).alias("t_idx"), "vx", "vy")
    winds = gr.durable(winds)
    flying, _ = rs.puffs(cells, winds, lag, nx, ny)
    pulls = rs.kernel(flying, sensors, winds).withColumn("member_id", config_of("tau")).withColumns({"tau": F.col("tau") % STRIDE, "t_idx": F.col("t_idx") % STRIDE})
    wide = rs.wide_response(pulls, inventory, basis, columns, ["member_id", "t_idx", "sensor_idx"]).join(rows, ["t_idx", "sensor_idx"])
    labels = [f"h{s}_{b}" for s, b in columns]
    fitted = fi.fit(fa.factor(wide, "member_id", [*background, *labels, "y"]), "member_id", len(background), labels)
    return fitted.select("member_id", F.lit("transport").alias("ensemble_kind"), "name", "c", "std", "residual_norm")


def best_assignment(correlations: DataFrame) -> DataFrame:
    """``factor, grp`` of the one-to-one assignment with the largest total (ties to the first), for few factors, by joins of partial assignments."""
    factors = [r.factor for r in correlations.select("factor").distinct().orderBy("factor").collect()]  # seven at most
    out = correlations.sparkSession.createDataFrame([(0.0, [])], "total double, used array<long>")
    for f in factors:
        own = correlations.where(F.col("factor") == f).select("grp", "corr")
        out = out.join(own, ~F.array_contains("used", F.col("grp"))).select((F.col("total") + F.col("corr")).alias("total"), F.concat("used", F.array("grp")).alias("used"))
    top = out.orderBy(F.col("total").desc(), "used").limit(1)
    return top.select(F.posexplode("used").alias("at", "grp")).withColumn("factor", F.element_at(F.array(*[F.lit(f) for f in factors]), F.col("at") + 1).cast("long")).select("factor", "grp")


def nonnegative_factors(matrix: DataFrame, k: int, seed: int = 0, rounds: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(time factors, sensor factors, shares) of ``matrix(t_idx, sensor_idx, v)`` by alternating nonnegative least squares of the library."""
    from pyspark.ml.recommendation import ALS

    model = ALS(rank=k, maxIter=rounds, regParam=1e-3, nonnegative=True, seed=seed, userCol="t_idx", itemCol="sensor_idx", ratingCol="v").fit(matrix.select(F.col("t_idx").cast("int"), F.col("sensor_idx").cast("int"), F.col("v").cast("float")))
    long = lambda df, name: df.select(F.col("id").cast("long").alias(name), F.posexplode("features").alias("factor", "w"))
    times, sensors = long(model.userFactors, "t_idx"), long(model.itemFactors, "sensor_idx")
    mass = times.groupBy("factor").agg(F.sum("w").alias("a")).join(sensors.groupBy("factor").agg(F.sum("w").alias("b")), "factor").withColumn("m", F.col("a") * F.col("b"))
    return times, sensors, mass.select("factor", (F.col("m") / F.sum("m").over(Window.partitionBy())).alias("share"))


def reconstruction_error(matrix: DataFrame, times: DataFrame, sensors: DataFrame) -> DataFrame:
    fitted = times.join(sensors.withColumnRenamed("w", "u"), "factor").groupBy("t_idx", "sensor_idx").agg(F.sum(F.col("w") * F.col("u")).alias("f"))
    return matrix.join(fitted, ["t_idx", "sensor_idx"]).agg((F.sqrt(F.sum((F.col("v") - F.col("f")) ** 2)) / F.sqrt(F.sum(F.col("v") ** 2))).alias("relative_error"))


def initial_baseline(observed: DataFrame, sites: DataFrame, cells: DataFrame, length: float) -> DataFrame:
    """``ix, iy, mass``: the first hour with at least three observed stations, interpolated (weights floored) and clipped at 0: one impulse to release."""
    first = observed.groupBy("t_idx").agg(F.count("*").alias("n")).where("n >= 3").agg(F.min("t_idx").alias("t_idx"))
    seen = observed.join(F.broadcast(first), "t_idx").join(few(sites), "station_id")
    weight = F.greatest(F.exp(-0.5 * ((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2) / (length * length)), F.lit(1e-12))
    return seen.join(few(cells)).withColumn("w", weight).groupBy("ix", "iy").agg(F.greatest(F.lit(0.0), F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mass"))


def released(impulse: DataFrame, kernel_: DataFrame, tau: DataFrame) -> DataFrame:
    """``t_idx, sensor_idx, baseline``: the impulse ``(ix, iy, mass)`` released at the one hour ``tau(tau)`` and carried by the kernel's rows."""
    own = kernel_.join(F.broadcast(tau), "tau", "left_semi").join(few(impulse), ["ix", "iy"])
    return own.groupBy("t_idx", "sensor_idx").agg(F.sum(F.col("mass") * F.col("g")).alias("baseline"))


def without_baseline(observed: DataFrame, baseline: DataFrame) -> DataFrame:
    """``observed(t_idx, sensor_idx, y)`` less the baseline, which is 0 where it has no row."""
    return observed.join(baseline, ["t_idx", "sensor_idx"], "left").withColumn("y", F.col("y") - F.coalesce("baseline", F.lit(0.0))).drop("baseline")


#: Hours between the first hours of two settings that stand in one table.
STRIDE = 10_000_000


def spread(hourly: DataFrame, configs: DataFrame, hour: str = "t_idx") -> DataFrame:
    """Rows of every setting, each at hours of its own: ``hour`` is moved on by STRIDE for each number, so operators keyed by hours treat all settings in one job."""
    return hourly.join(few(configs)).withColumn(hour, F.col(hour) + F.col("config_id") * STRIDE)


def config_of(hour: str = "t_idx"):
    return F.floor(F.col(hour) / STRIDE)


def swept_response(city: DataFrame, cells: DataFrame, sensors: DataFrame, inventory: DataFrame, basis: DataFrame, configs: DataFrame, nx: int, ny: int) -> DataFrame:
    """``config_id, t_idx, sensor_idx, source_idx, basis_idx, h`` under every setting ``configs(config_id, turn, speed, along, across, lag, dx, dy)``.

    The wind is turned by ``turn`` degrees and scaled by ``speed``; puffs spread by
    ``along`` and ``across`` and count up to ``lag`` hours; the map is moved by (dx, dy)
    cells, and what leaves the grid is lost. Settings are rows; the response is one job.
    """
    most = configs.agg(F.max("lag")).first()[0]
    a = F.radians("turn")
    winds = spread(city, configs).select("t_idx", (F.col("speed") * (F.col("vx") * F.cos(a) - F.col("vy") * F.sin(a))).alias("vx"), (F.col("speed") * (F.col("vx") * F.sin(a) + F.col("vy") * F.cos(a))).alias("vy"))
    flying, _ = rs.puffs(cells, winds, most, nx, ny)
    own = flying.withColumn("config_id", config_of("tau")).join(few(configs.select("config_id", "along", "across", F.col("lag").alias("_lag"))), "config_id").where("lag < _lag")
    pulls = rs.kernel(own, sensors, winds, along=F.col("along"), across=F.col("across"))
    moves = configs.select("config_id", "dx", "dy")
    back = pulls.withColumn("config_id", config_of("tau")).join(few(moves), "config_id").withColumns({"ix": F.col("ix") - F.col("dx"), "iy": F.col("iy") - F.col("dy")}).drop("dx", "dy", "config_id")
    out = rs.response(back, inventory, spread(basis, configs.select("config_id")).drop("config_id"))
    return out.withColumn("config_id", config_of("t_idx")).withColumn("t_idx", F.col("t_idx") - F.col("config_id") * STRIDE)


def sweep_fits(swept: DataFrame, truth: DataFrame, noise: DataFrame, columns: list[tuple[int, int]]) -> DataFrame:
    """One row for each (setting, column): spectrum and fit where the data come from setting 0 and the columns from the setting.

    ``truth(source_idx, basis_idx, c)``; ``noise(config_id, noise)``: the relative size of
    the hash-drawn noise. Columns ``h<source>_<basis>``.
    """
    names = [f"h{s}_{b}" for s, b in columns]
    col = F.concat(F.lit("h"), F.col("source_idx").cast("string"), F.lit("_"), F.col("basis_idx").cast("string"))
    wide = swept.withColumn("col", col).groupBy("config_id", "t_idx", "sensor_idx").pivot("col", names).agg(F.first("h")).na.fill(0.0, names)
    y = swept.where("config_id = 0").join(few(truth), ["source_idx", "basis_idx"]).groupBy("t_idx", "sensor_idx").agg(F.sum(F.col("h") * F.col("c")).alias("y"))
    u = F.pmod(F.xxhash64(F.lit("sweep"), "t_idx", "sensor_idx"), F.lit(1 << 20)) / float(1 << 20)
    rows = wide.join(y, ["t_idx", "sensor_idx"]).join(few(noise), "config_id").withColumn("y", F.col("y") * (1 + F.col("noise") * (2 * u - 1))).withColumn("one", F.lit(1.0))
    factors = gr.durable(fa.factor(rows, "config_id", ["one", *names, "y"]))
    found = fa.diagnostics(factors, "config_id", 1, len(names)).select("config_id", "n_rows", "rank", "sigma_j", "condition")
    return fi.fit(factors, "config_id", 1, names).join(found, "config_id")


def observed_chain(response_: DataFrame, observed: DataFrame, hours: DataFrame, columns: list[tuple[int, int]], window: int = 168, limit: float = 0.99, weak: float = 1e-9) -> dict[str, DataFrame]:
    """The observed study of all windows in one job: observed rows, background, spectrum, fit, groups, shares and contributions.

    ``response_(t_idx, sensor_idx, source_idx, basis_idx, h)``; ``observed(t_idx,
    sensor_idx, y)``, of which null or NaN rows are left out and never imputed;
    ``hours(t_idx, ts)``. Windows are ``window`` hours long. Background: constant, elapsed
    time, first daily pair. Nothing is scored against a truth, and the status is
    ``uncalibrated`` (or ``insufficient_observed_rows``, without a fit).
    """
    key, q = "window_id", ["one", "time_1", "sin_1", "cos_1"]
    names = [f"h{s}_{b}" for s, b in columns]
    spark = response_.sparkSession
    index = spark.createDataFrame([(i, s, b, n) for i, ((s, b), n) in enumerate(zip(columns, names))], "col_idx int, source_idx long, basis_idx long, name string")
    wide = response_.join(few(index), ["source_idx", "basis_idx"]).groupBy("t_idx", "sensor_idx").pivot("name", names).agg(F.first("h")).na.fill(0.0, names)
    angle = 2 * F.pi() * (F.hour("ts") + F.minute("ts") / 60.0) / 24.0
    rows = wide.join(observed, ["t_idx", "sensor_idx"], "left").join(hours.select("t_idx", "ts"), "t_idx").withColumns({
        key: F.floor(F.col("t_idx") / window), "one": F.lit(1.0), "time_1": (F.col("t_idx") % window) / float(window), "sin_1": F.sin(angle), "cos_1": F.cos(angle),
    }).drop("ts")
    rows = gr.durable(rows)
    summary, coefficients, pairs, factors = observed_study(rows, key, q, names, "y")
    summary, pairs = gr.durable(summary), gr.durable(pairs.withColumn("ambiguous", F.coalesce(F.col("coherence") > limit, F.lit(False))))
    coefficients = gr.durable(coefficients.join(few(index), "name"))
    weakness = fa.projected_gram(factors, key, len(q), len(names)).where("i = j").select(key, "i", (F.sqrt("g") <= weak).alias("weak"))
    weakness = gr.durable(weakness.join(few(index.select(F.col("col_idx").alias("i"), "source_idx", "name")), "i"))
    faint = weakness.where("weak").select(key, "i")
    strong = pairs.join(faint, [key, "i"], "left_anti").join(faint.withColumnRenamed("i", "j"), [key, "j"], "left_anti")
    edges = gr.durable(gr.source_edges(strong, index, key, limit))
    nodes = summary.select(key).join(few(index.select(F.col("source_idx").alias("node")).distinct()))
    comps = gr.components(nodes, edges, key)
    diagnosed = summary.where("status = 'uncalibrated'").select(key, "rank", F.lit(len(names)).alias("n_columns"))
    all_weak = weakness.groupBy(key, F.col("source_idx").alias("source")).agg(F.bool_and("weak").alias("all_weak"))
    pull = F.array(*[F.struct(F.lit(int(s)).cast("long").alias("source_idx"), F.lit(int(b)).cast("long").alias("basis_idx"), F.col(n).alias("h"), F.col(f"{n}_t").alias("h_t")) for (s, b), n in zip(columns, names)])
    seen = rows.where("y is not null and not isnan(y)").join(summary.where("status = 'uncalibrated'").select(key), key, "left_semi")
    projected = fa.project(seen, key, q, [*names, "y"], factors)  # the one pass over rows after their factor
    long = projected.select(key, "t_idx", "sensor_idx", F.explode(pull).alias("x")).select(key, "t_idx", "sensor_idx", "x.*")
    shares, contributions = gr.group_signals(long, coefficients.select(key, "source_idx", "basis_idx", "c"), comps, key)
    return {
        "rows": rows, "summary": summary, "coefficients": coefficients, "pairs": pairs, "edges": edges, "components": comps, "weakness": weakness,
        "resolution": gr.resolution(diagnosed, edges, comps, all_weak, key), "shares": shares, "contributions": contributions,
    }


def synthetic_coefficients(columns: DataFrame, seed: str, low: float = 0.3, high: float = 1.2, zeroed: float = 0.0) -> DataFrame:
    """``source_idx, basis_idx, c``: a number in [low, high] for each column from a hash of the seed and the column; a hash-drawn share of the columns is 0."""
    unit = lambda what: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(what), F.col("source_idx").cast("string"), F.col("basis_idx").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return columns.select("source_idx", "basis_idx", F.when(unit("zero") < zeroed, 0.0).otherwise(low + (high - low) * unit("value")).alias("c"))


def observed_study(rows: DataFrame, key: str, background: list[str], columns: list[str], target: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(summary, coefficients, pairs, factors) of all windows in one job: observed rows alone, background removed, diagnosed, fitted, paired.

    Rows are read twice, to be counted and to be reduced to factors; all else comes from these.

    The target is never imputed: rows without it are left out. Windows with too few
    rows have the status ``insufficient_observed_rows`` and no fit; the rest are
    ``uncalibrated``, since no noise model is declared.
    """
    seen = rows.where(F.col(target).isNotNull() & ~F.isnan(target))
    counts = rows.groupBy(key).agg(F.count("*").alias("n_total"), F.count(target).alias("n_observed"))
    status = counts.withColumn("status", F.when(F.col("n_observed") < len(columns) + 1, "insufficient_observed_rows").otherwise("uncalibrated"))
    enough = seen.join(status.where("status = 'uncalibrated'").select(key), key, "left_semi")
    factors = gr.durable(fa.factor(enough, key, [*background, *columns, target]))
    found = fa.diagnostics(factors, key, len(background), len(columns))
    summary = status.join(found.drop("n_rows"), key, "left")
    pairs = fa.coherence(fa.projected_gram(factors, key, len(background), len(columns)), key)
    return summary, fi.fit(factors, key, len(background), columns), pairs, factors


def compare_methods(factors: DataFrame, key: str, n_q: int, columns: list[str], truth: DataFrame, lam: float = 0.0) -> DataFrame:
    """One row for each (key, method) with recovery scores: the chain (background removed, penalty ``lam``), plain (the same without penalty) and raw (background not removed)."""
    own = [fi.fit(factors, key, n_q, columns, lam=lam).withColumn("method", F.lit("chain")), fi.fit(factors, key, n_q, columns).withColumn("method", F.lit("plain")), fi.fit(factors, key, n_q, columns, raw=True).withColumn("method", F.lit("raw"))]
    return fi.recovery(reduce(DataFrame.unionByName, own).select(key, "method", "name", "c"), truth, key, "method")

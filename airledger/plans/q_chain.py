"""Queries of whole chains: background reports, ensembles, groups, sweeps through the response, the observed study."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bases as ba
from ..operators import factor as fa
from ..operators import fit as fi
from ..operators import groups as gr
from ..operators import inventory as inv
from ..operators import readings as rd
from ..operators import response as rs
from ..operators import results as out
from ..operators import spatial as sp
from ..operators import study as st
from ..sources import tables as tb
from .q_fits import COH, DEM, GRAM, HS, RES, TWO, columns, pairs, r4, residuals, s4
from .q_inventory import BASIS, CITY, H, KERNEL, PATHS, SENSORS, SMALL, WHOLE, L, basis, city, hours, kernel, lagged, sensors, small
from .q_readings import panel
from .q_spatial import GRID, HELD, PREDICTED, SCORES, held, placed
from .q_studies import scratch
from .registry import BASE, DESIGN, GRID_STATIONS, INVENTORY, base, design, query, r6, s6, with_


@query(with_(DESIGN, GRAM, COH) + f"SELECT window_id, {s6('max(coherence)')} AS coherence, arg_max(i, coherence) AS i, arg_max(j, coherence) AS j, arg_min(i, sqrt(1 - coherence * coherence)) AS near_i, arg_min(j, sqrt(1 - coherence * coherence)) AS near_j FROM coh WHERE i < 2 AND j >= 2 GROUP BY 1")
def t2_strongest_cross_source_pair(spark, sf):
    """h1 and h2 are of one source, h3 and h4 of another."""
    return fa.strongest_across(pairs(spark, sf), columns(spark), "window_id").withColumn("coherence", r6(F.col("coherence")))


UNIT = "('0x' || substr(md5('f18:' || '{}' || ':' || source_idx || ':' || basis_idx), 1, 8))::BIGINT / 4294967296.0"


@query(f"SELECT source_idx, basis_idx, {s6('CASE WHEN ' + UNIT.format('zero') + ' < 0.25 THEN 0.0 ELSE 0.3 + (1.2 - 0.3) * ' + UNIT.format('value') + ' END')} AS c FROM (SELECT DISTINCT l_linenumber AS source_idx, l_suppkey % 24 AS basis_idx FROM lineitem)")
def f18_synthetic_coefficients(spark, sf):
    own = base(spark, sf, "lineitem").select(F.col("l_linenumber").alias("source_idx"), (F.col("l_suppkey") % 24).alias("basis_idx")).distinct()
    return st.synthetic_coefficients(own, "f18", zeroed=0.25).withColumn("c", r6(F.col("c")))


# Every third window has h4 = 2 h3, both of one source, and so a rank of three; columns of norm 330 or less are weak.
DEFICIENT = DESIGN.replace("l_extendedprice / 1e4 AS h4", "CASE WHEN month(l_shipdate) % 3 = 0 THEN l_tax * 200 ELSE l_extendedprice / 1e4 END AS h4")
STRONG = "coh AS (SELECT g.window_id, g.i, g.j, CASE WHEN sqrt(a.g) > 330 AND sqrt(b.g) > 330 THEN least(1.0, abs(g.g) / (sqrt(a.g) * sqrt(b.g))) END AS coherence FROM gram g JOIN gram a ON a.window_id = g.window_id AND a.i = g.i AND a.j = g.i JOIN gram b ON b.window_id = g.window_id AND b.i = g.j AND b.j = g.j WHERE g.i < g.j)"
MET = "met AS (SELECT window_id, coalesce(bool_or(coherence > 0.757 AND i < 2 AND j >= 2), false) AS met FROM coh GROUP BY 1), weak AS (SELECT window_id, 'h' || (i + 1) AS name, i // 2 AS source, sqrt(g) <= 330 AS weak FROM gram WHERE i = j), rk AS (SELECT window_id, CASE WHEN window_id % 3 = 0 THEN 3 ELSE 4 END AS rank FROM met)"


def deficient(spark, sf):
    rows = design(spark, sf)
    return rows.withColumn("h4", F.when(F.col("window_id") % 3 == 0, 2 * F.col("h3")).otherwise(F.col("h4")))


def ensemble(spark, sf):
    """(diagnosed, pairs, weak columns, edges, components) of the windows of deficient()."""
    rows, key = deficient(spark, sf), "window_id"
    diagnosed = gr.durable(fa.diagnostics(fa.factor(rows, key, [*HS, "y"]), key, 0, 4, 400.0).withColumn("n_columns", F.lit(4)))
    grams = gr.durable(fa.gram(rows, key, HS))
    own = gr.durable(fa.coherence(grams, key, 330.0, 0.757))
    weak = grams.where("i = j").select(key, "i", (F.sqrt("g") <= 330.0).alias("weak")).join(F.broadcast(columns(spark).select(F.col("col_idx").alias("i"), F.col("source_idx").alias("source"), "name")), "i")
    edges = gr.durable(gr.source_edges(own, columns(spark), key, 0.757))
    nodes = diagnosed.select(key).join(F.broadcast(columns(spark).select(F.col("source_idx").alias("node")).distinct()))
    return diagnosed, own, weak, edges, gr.components(nodes, edges, key)


def reported(spark, sf):
    diagnosed, own, weak, _, comps = ensemble(spark, sf)
    names = columns(spark).select("source_idx", F.concat(F.lit("s"), F.col("source_idx").cast("string")).alias("source_name")).distinct()
    named = gr.group_names(comps, names, "window_id").withColumnRenamed("group", "grp")
    return gr.ensemble_report(diagnosed, own, weak, named, columns(spark), "window_id")


@query(with_(DEFICIENT, GRAM, STRONG, MET) + f"SELECT {s6('avg(CASE WHEN rank = 4 THEN 1.0 ELSE 0.0 END)')} AS p_full_rank, count(*) AS n FROM rk")
def a16_full_rank_probability(spark, sf):
    return reported(spark, sf)[0].select(r6(F.col("p_full_rank")).alias("p_full_rank"), "n")


@query()
def a16_ensemble_spectra(spark, sf):
    """Quantiles of the smallest singular value, and how often the rank and the effective rank are full."""
    return reported(spark, sf)[0]


@query(with_(DEFICIENT, GRAM, STRONG, MET) + f"SELECT name, {s6('count(DISTINCT window_id) / (SELECT count(*) FROM rk)')} AS p FROM weak WHERE weak GROUP BY 1")
def a16_weak_probability(spark, sf):
    return reported(spark, sf)[1].withColumn("p", r6(F.col("p")))


@query(with_(DEFICIENT, GRAM, STRONG, MET) + f"SELECT i, j, {s6('count(DISTINCT window_id) / (SELECT count(*) FROM rk)')} AS p FROM coh WHERE coherence > 0.757 AND i < 2 AND j >= 2 GROUP BY 1, 2")
def a16_ambiguous_pairs(spark, sf):
    return reported(spark, sf)[2].withColumn("p", r6(F.col("p")))


@query(with_(DEFICIENT, GRAM, STRONG, MET) + f"SELECT grp, {s6('count(*) / (SELECT count(*) FROM rk)')} AS p FROM (SELECT unnest(CASE WHEN met THEN ['s0+s1'] ELSE ['s0', 's1'] END) AS grp FROM met) GROUP BY 1")
def a16_component_frequency(spark, sf):
    return reported(spark, sf)[3].withColumn("p", r6(F.col("p")))


@query(with_(DEFICIENT, GRAM, STRONG, MET) + "SELECT window_id, CASE WHEN met THEN 1 ELSE 2 END::BIGINT AS n_components, met::INTEGER::BIGINT AS n_edges, met AS merged, rank < 4 AND NOT met AS global_unresolved, "
  "(SELECT coalesce(string_agg(source, '+' ORDER BY source), '') FROM (SELECT w.window_id, source FROM weak w GROUP BY 1, 2 HAVING bool_and(weak)) s WHERE s.window_id = met.window_id) AS weak_sources FROM met JOIN rk USING (window_id)")
def m6_resolution(spark, sf):
    diagnosed, _, weak, edges, comps = ensemble(spark, sf)
    all_weak = weak.groupBy("window_id", "source").agg(F.bool_and("weak").alias("all_weak"))
    out = gr.resolution(diagnosed, edges, comps, all_weak, "window_id")
    return out.withColumn("weak_sources", F.concat_ws("+", F.transform("weak_sources", lambda x: x.cast("string"))))


@query("SELECT 'run=' || replace(o_orderpriority, ' ', '_') AS run_dir, CASE WHEN o_orderpriority LIKE '1%' THEN 'observed_week' ELSE 'exp01' END AS experiment, CASE WHEN o_orderpriority LIKE '1%' THEN 'observed' ELSE 'controlled' END AS kind, "
  f"count(*) AS n, {s6('avg(o_totalprice) / 1e6')} AS mean, [min(o_orderkey), max(o_orderkey)]::VARCHAR AS keys FROM orders GROUP BY o_orderpriority")
def c6_nested_run_results(spark, sf):
    """One JSON object a file, nested, in a folder for each run."""
    path = scratch(spark)
    own = base(spark, sf, "orders").groupBy(F.translate("o_orderpriority", " ", "_").alias("run")).agg(
        F.when(F.first("o_orderpriority").startswith("1"), "observed_week").otherwise("exp01").alias("experiment"),
        F.struct(F.count("*").alias("n"), (F.avg("o_totalprice") / 1e6).alias("mean")).alias("diagnostics"), F.array(F.min("o_orderkey"), F.max("o_orderkey")).alias("keys"),
    )
    own.write.partitionBy("run").json(path)
    runs = tb.read_runs(spark, path, "experiment string, diagnostics struct<n: long, mean: double>, keys array<long>")
    return runs.select("run_dir", "experiment", "kind", "diagnostics.n", r6(F.col("diagnostics.mean")).alias("mean"), F.concat(F.lit("["), F.concat_ws(", ", F.transform("keys", lambda k: k.cast("string"))), F.lit("]")).alias("keys"))


@query(with_(DESIGN) + "SELECT window_id, 2 AS rank, 'twice' AS dependent, true AS within_cap, false AS within_one, true AS within_one_with_stress, true AS orthogonal, true AS idempotent FROM design GROUP BY 1")
def m2_background_report(spark, sf):
    """Of a constant, h3 and twice h3 the last depends on the others; a cap of one direction holds if h3 counts as stress."""
    q = ["one", "h3", "twice"]
    rows = design(spark, sf).withColumns({"one": F.lit(1.0), "twice": 2 * F.col("h3")})
    of = lambda *a: fa.background_report(rows, "window_id", q, ["h1", "h2", "y"], *a)
    whole = of().select("window_id", "rank", F.concat_ws("+", "dependent").alias("dependent"), "within_cap", (F.col("orthogonality") < 1e-9).alias("orthogonal"), (F.col("idempotence") < 1e-9).alias("idempotent"))
    one = of(1).select("window_id", F.col("within_cap").alias("within_one"))
    stress = of(1, ("h3",)).select("window_id", F.col("within_cap").alias("within_one_with_stress"))
    return whole.join(one, "window_id").join(stress, "window_id")


@query(with_(DESIGN, DEM, TWO.format("dem")) + f"SELECT window_id, name, {s4('c')} AS c FROM (SELECT window_id, 'h1' AS name, greatest(0.0, (p + 200 * 0.4) / (a + 200)) AS c FROM two UNION ALL SELECT window_id, 'h2', 0.0 FROM two)")
def x4_prior_and_fixed_zero(spark, sf):
    """h2 is held at 0, h1 is drawn to 0.4 with a weight of 200."""
    own = fa.factor(design(spark, sf).withColumn("one", F.lit(1.0)), "window_id", ["one", "h1", "h2", "y"])
    return fi.fit(own, "window_id", 1, ["h1", "h2"], lam=200.0, prior=[0.4, 0.0], zeros=[1]).select("window_id", "name", r4(F.col("c")).alias("c"))


@query(with_(DESIGN) + f", s AS (SELECT window_id, sum(h1 * h1) AS a, sum(h1 * y) AS p, sum(y * y) AS yy, count(*) AS n FROM design GROUP BY 1) SELECT window_id, {s6('sqrt((yy - p * p / a) / (n - 1) / a)')} AS naive, {s6('sqrt(0.25 / a)')} AS given FROM s")
def a39_naive_deviation(spark, sf):
    """From the rows less the active columns, and from a given noise of 0.5."""
    own = gr.durable(fa.factor(design(spark, sf), "window_id", ["h1", "y"]))
    naive = fi.fit(own, "window_id", 0, ["h1"], raw=True).select("window_id", r6(F.col("std_naive")).alias("naive"))
    return naive.join(fi.fit(own, "window_id", 0, ["h1"], raw=True, noise=0.5).select("window_id", r6(F.col("std_naive")).alias("given")), "window_id")


SITES = "sites AS (SELECT station_id AS sensor_idx, x AS sx, y AS sy FROM placed), st AS (SELECT avg(sx) AS mx, stddev_pop(sx) AS dx, avg(sy) AS my, stddev_pop(sy) AS dy FROM panel JOIN sites ON sensor_idx = station_id WHERE pm25 IS NOT NULL)"


@query(with_(BASE, GRID_STATIONS, SITES) + f"SELECT t_idx, sensor_idx, name, {s6('q')} AS q FROM (SELECT t_idx, sensor_idx, 'x_trend' AS name, (sx - mx) / dx AS q FROM panel JOIN sites ON sensor_idx = station_id, st WHERE pm25 IS NOT NULL UNION ALL SELECT t_idx, sensor_idx, 'y_trend', (sy - my) / dy FROM panel JOIN sites ON sensor_idx = station_id, st WHERE pm25 IS NOT NULL)")
def f9_spatial_trends(spark, sf):
    seen = panel(spark, sf).where("pm25_valid").select("t_idx", F.col("station_id").alias("sensor_idx"))
    sites = placed(spark, sf).select(F.col("station_id").alias("sensor_idx"), "sx", "sy")
    return fa.trends(seen, sites).withColumn("q", r6(F.col("q")))


@query(with_(BASE) + """, b AS (SELECT *, lag(ts) OVER (PARTITION BY station_id ORDER BY t_idx) AS before FROM panel)
  SELECT 'time_grows' AS check_name, count(*) FILTER (ts <= before)::BIGINT AS n_violations, count(*) FILTER (ts <= before) = 0 AS passed FROM b UNION ALL SELECT 'metadata', 1, false UNION ALL SELECT 'station_count', abs(count(DISTINCT station_id) - 32)::BIGINT, count(DISTINCT station_id) = 32 FROM panel""")
def c5_product_times_and_metadata(spark, sf):
    """The declared metadata lack the grid."""
    return rd.declared_checks(panel(spark, sf), {"convention": "transport", "hours": "local"}, ("convention", "hours", "grid"), 32)


@query(with_(INVENTORY, BASE) + """, a AS (SELECT value AS theta FROM events) SELECT check_name, n_violations::BIGINT AS n_violations FROM (SELECT 'activity_finite_nonnegative' AS check_name, count(*) FILTER (theta IS NULL OR isnan(theta) OR theta < 0) AS n_violations FROM a
  UNION ALL SELECT 'dt_positive', 0 UNION ALL SELECT 'lag_positive', 1 UNION ALL SELECT 'dispersion_positive', 0)""")
def c10_settings_contract(spark, sf):
    """The declared lag is not positive."""
    return inv.setting_checks(base(spark, sf, "events").select(F.col("value").alias("theta")), dt=1.0, lag=0, dispersion=(0.7, 0.25))


CELLS = "grid AS (SELECT i AS ix, j AS iy FROM range(10) a(i), range(10) b(j))"
IMPULSE = """tau0 AS (SELECT min(t_idx) AS tau FROM (SELECT t_idx FROM panel WHERE pm25 IS NOT NULL GROUP BY t_idx HAVING count(*) >= 3)),
  iw AS (SELECT g.ix, g.iy, greatest(exp(-0.5 * ((g.ix - x * 9 / 7) * (g.ix - x * 9 / 7) + (g.iy - y * 9 / 7) * (g.iy - y * 9 / 7)) / 4.0), 1e-12) AS w, pm25 FROM panel JOIN tau0 ON t_idx = tau JOIN placed USING (station_id) CROSS JOIN grid g WHERE pm25 IS NOT NULL),
  impulse AS (SELECT ix, iy, greatest(0.0, sum(w * pm25) / sum(w)) AS mass FROM iw GROUP BY 1, 2), baseline AS (SELECT k.t_idx, sensor_idx, sum(mass * g) AS baseline FROM kern k JOIN tau0 USING (tau) JOIN impulse USING (ix, iy) GROUP BY 1, 2),
  corrected AS (SELECT p.t_idx, p.station_id AS sensor_idx, pm25 - coalesce(baseline, 0.0) AS y FROM panel p LEFT JOIN baseline b ON b.t_idx = p.t_idx AND b.sensor_idx = p.station_id WHERE pm25 IS NOT NULL AND p.station_id < 4)"""
CORRECTED = f"{WHOLE}, {GRID_STATIONS}, {CELLS}, {IMPULSE} "


def corrected(spark, sf, carried=None):
    """Readings of the four sensors, which stand for the stations of their numbers, less the released first field."""
    seen = panel(spark, sf).where("pm25_valid").select("t_idx", "station_id", F.col("pm25").alias("v"))
    sites = placed(spark, sf).select("station_id", (F.col("sx") * 9 / 7).alias("sx"), (F.col("sy") * 9 / 7).alias("sy"))
    impulse = st.initial_baseline(seen, sites, sp.cells(spark, 10, 10), 2.0)
    first = seen.groupBy("t_idx").agg(F.count("*").alias("n")).where("n >= 3").agg(F.min("t_idx").alias("tau"))
    observed = seen.join(F.broadcast(sensors(spark).select(F.col("sensor_idx").alias("station_id"))), "station_id").select("t_idx", F.col("station_id").alias("sensor_idx"), F.col("v").alias("y"))
    return st.without_baseline(observed, st.released(impulse, kernel(spark, sf)[0] if carried is None else carried, first))


@query(CORRECTED + f"SELECT t_idx, sensor_idx, {s6('y')} AS y FROM corrected")
def j14_released_baseline(spark, sf):
    return corrected(spark, sf).withColumn("y", r6(F.col("y")))


COLUMNS = [(s, b) for s in range(4) for b in range(2)]


def chain(spark, sf):
    return st.observed_chain(lagged(spark, sf), corrected(spark, sf), hours(spark, sf), COLUMNS, 168, 0.97)


@query(CORRECTED + ", keys AS (SELECT DISTINCT t_idx, sensor_idx FROM resp), n AS (SELECT t_idx // 168 AS window_id, count(*) AS n_total, count(y) AS n_observed FROM keys LEFT JOIN corrected USING (t_idx, sensor_idx) GROUP BY 1) SELECT *, CASE WHEN n_observed < 9 THEN 'insufficient_observed_rows' ELSE 'uncalibrated' END AS status FROM n")
def m11_chain_status(spark, sf):
    return chain(spark, sf)["summary"].select("window_id", "n_total", "n_observed", "status")


@query()
def m11_chain_coefficients(spark, sf):
    own = chain(spark, sf)
    return own["coefficients"].join(own["summary"].select("window_id", "rank", "sigma_j"), "window_id").select("window_id", "source_idx", "basis_idx", "c", "std", "residual_norm", "rank", "sigma_j", "warning")


@query()
def m11_chain_shares(spark, sf):
    own = chain(spark, sf)
    return own["shares"].join(own["resolution"], "window_id", "left")


@query()
def m11_chain_contributions(spark, sf):
    return chain(spark, sf)["contributions"]


def gridded_kernel(spark, sf):
    """Kernel rows under the wind field interpolated from all stations: 18 km to a cell, so a tenth of a metre a second is 0.02 cells an hour."""
    sites = placed(spark, sf).select("station_id", (F.col("sx") * 9 / 7).alias("sx"), (F.col("sy") * 9 / 7).alias("sy"))
    field = sp.wind_field(panel(spark, sf), sites, 10, 10, dx_m=18000.0).select("t_idx", "ix", "iy", "dx", "dy")
    own = hours(spark, sf)
    releases = own.select(F.col("t_idx").alias("tau")).join(F.broadcast(sp.cells(spark, 10, 10).select("ix", "iy")))
    return rs.kernel(rs.gridded(releases, field, rs.bilinear, L, 10, 10), sensors(spark), own)


def gridded_chain(spark, sf):
    own = gridded_kernel(spark, sf)
    return st.observed_chain(rs.response(own, small(spark, sf), basis(spark, sf)), corrected(spark, sf, own), hours(spark, sf), COLUMNS, 168, 0.97)


@query(CORRECTED + ", keys AS (SELECT DISTINCT t_idx, sensor_idx FROM resp), n AS (SELECT t_idx // 168 AS window_id, count(*) AS n_total, count(y) AS n_observed FROM keys LEFT JOIN corrected USING (t_idx, sensor_idx) GROUP BY 1) SELECT *, CASE WHEN n_observed < 9 THEN 'insufficient_observed_rows' ELSE 'uncalibrated' END AS status FROM n")
def m11_gridded_status(spark, sf):
    """Which rows are seen doesn't depend on the wind, so the SQL is that of the city's."""
    return gridded_chain(spark, sf)["summary"].select("window_id", "n_total", "n_observed", "status")


@query()
def m11_gridded_report(spark, sf):
    """Each column's coefficient with its window's spectrum, its group, the group's share and the resolution, under the gridded wind."""
    own = gridded_chain(spark, sf)
    found = own["summary"].select("window_id", "status", "rank", "sigma_j", "condition")
    grouped = own["coefficients"].join(own["components"].withColumnRenamed("node", "source_idx"), ["window_id", "source_idx"])
    named = grouped.join(own["shares"].select("window_id", "component", "share"), ["window_id", "component"], "left")
    return found.join(named.select("window_id", "source_idx", "basis_idx", "c", "std", "residual_norm", "warning", "component", "share"), "window_id", "left").join(own["resolution"], "window_id", "left")


@query()
def m11_gridded_contributions(spark, sf):
    return gridded_chain(spark, sf)["contributions"]


# Settings of a sweep: as it is, turned, faster, wider, shorter, and with the map moved.
SETTINGS = [(0, 0.0, 1.0, 0.7, 0.25, 6, 0, 0, 0.0), (1, 20.0, 1.0, 0.7, 0.25, 6, 0, 0, 0.0), (2, 0.0, 1.5, 0.7, 0.25, 6, 0, 0, 0.05), (3, 0.0, 1.0, 1.0, 0.5, 6, 0, 0, 0.0), (4, 0.0, 1.0, 0.7, 0.25, 3, 0, 0, 0.0), (5, 0.0, 1.0, 0.7, 0.25, 6, 2, -1, 0.2)]
SETTING_COLUMNS = ("config_id", "turn", "speed", "along", "across", "lag", "dx", "dy", "noise")
CONFIGS = "cfg(config_id, turn, speed, along, across, most, dx, dy) AS (VALUES " + ", ".join("({}::BIGINT, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}::BIGINT, {}::BIGINT, {}::BIGINT)".format(*row[:8]) for row in SETTINGS) + ")"
STRIDE = st.STRIDE
SWEPT = with_(
    BASE, INVENTORY, SMALL, SENSORS, CONFIGS, CITY.replace("city AS", "city0 AS"),
    f"city AS (SELECT config_id * {STRIDE} + t_idx AS t_idx, speed * (vx * cos(radians(turn)) - vy * sin(radians(turn))) AS vx, speed * (vx * sin(radians(turn)) + vy * cos(radians(turn))) AS vy FROM city0, cfg)",
    PATHS.replace("OVER (ORDER BY t_idx)", f"OVER (PARTITION BY t_idx // {STRIDE} ORDER BY t_idx)"),
    KERNEL.replace("FROM puffs p CROSS JOIN sensors s", f"FROM puffs p JOIN cfg ON cfg.config_id = p.tau // {STRIDE} AND p.lag < cfg.most CROSS JOIN sensors s").replace("0.49 *", "along * along *").replace("0.0625 *", "across * across *").replace("p.ix, p.iy,", "p.ix - cfg.dx AS ix, p.iy - cfg.dy AS iy,"),
    BASIS.replace("basis AS", "basis0 AS"), f"basis AS (SELECT config_id * {STRIDE} + t_idx AS t_idx, basis_idx, phi FROM basis0, cfg)", H,
)


def swept(spark, sf):
    configs = spark.createDataFrame(SETTINGS, "config_id long, turn double, speed double, along double, across double, lag long, dx long, dy long, noise double")
    own = small(spark, sf)
    return configs, st.swept_response(city(spark, sf), own.select("ix", "iy").distinct(), sensors(spark), own, basis(spark, sf), configs.drop("noise"), 10, 10)


@query(SWEPT + f"SELECT t_idx // {STRIDE} AS config_id, t_idx % {STRIDE} AS t_idx, sensor_idx, source_idx, basis_idx, {s6('h')} AS h FROM resp")
def m8_swept_response(spark, sf):
    return swept(spark, sf)[1].select("config_id", "t_idx", "sensor_idx", "source_idx", "basis_idx", r6(F.col("h")).alias("h"))


@query()
def m8_swept_fits(spark, sf):
    """The data are of the first setting, the columns of each."""
    configs, own = swept(spark, sf)
    truth = st.synthetic_coefficients(own.select("source_idx", "basis_idx").distinct(), "truth")
    return st.sweep_fits(gr.durable(own), truth, configs.select("config_id", "noise"), COLUMNS).join(F.broadcast(configs.drop("noise")), "config_id")


def background_hours(spark, sf, window=168):
    """``t_idx, one, time_1, sin_1, cos_1`` of each hour: the primary background of a window."""
    angle = 2 * F.pi() * (F.hour("ts") + F.minute("ts") / 60.0) / 24.0
    return hours(spark, sf).select("t_idx", F.lit(1.0).alias("one"), ((F.col("t_idx") % window) / float(window)).alias("time_1"), F.sin(angle).alias("sin_1"), F.cos(angle).alias("cos_1"))


@query()
def m10_refined_response(spark, sf):
    """Each week's wind and dispersion, moved by at most two rounds of steps under the gate."""
    own = small(spark, sf)
    rows = corrected(spark, sf).join(background_hours(spark, sf), "t_idx")
    return st.refined(
        city(spark, sf), own.select("ix", "iy").distinct(), sensors(spark), own, basis(spark, sf), rows, ["one", "time_1", "sin_1", "cos_1"], COLUMNS, 10, 10, 4,
        eps=0.4, weight=0.01, weight_psi=0.01, rho=0.999, rounds=2,
    )


def historical(spark, sf):
    """(windows, factors) of 20 windows of a week, evenly spread over the record and overlapping where it is short; columns of the response beside a constant."""
    own = kernel(spark, sf)[0]
    rows = rs.wide_response(own, small(spark, sf), basis(spark, sf), COLUMNS, ["t_idx", "sensor_idx"]).withColumns({"one": F.lit(1.0), "y": F.lit(0.0)})
    windows = rd.even_windows(spark, hours(spark, sf).count(), 168, 20)
    return windows, gr.durable(fa.window_factors(rows, "t_idx", ["one", *[f"h{s}_{b}" for s, b in COLUMNS], "y"], windows, 168))


@query()
def a16_historical_windows(spark, sf):
    windows, factors = historical(spark, sf)
    return windows.join(fa.diagnostics(factors, "window_id", 1, len(COLUMNS), 100.0), "window_id")


@query()
def a16_historical_ensemble(spark, sf):
    """Quantiles of the smallest singular value of the windows, and how often ranks are full."""
    _, factors = historical(spark, sf)
    key, n = "window_id", len(COLUMNS)
    index = spark.createDataFrame([(i, s, f"h{s}_{b}") for i, (s, b) in enumerate(COLUMNS)], "col_idx int, source_idx long, name string")
    found = fa.diagnostics(factors, key, 1, n, 100.0).withColumn("n_columns", F.lit(n))
    grams = gr.durable(fa.projected_gram(factors, key, 1, n))
    own = gr.durable(fa.coherence(grams, key, 1e-9, 0.97))
    weak = grams.where("i = j").select(key, "i", (F.sqrt("g") <= 1e-9).alias("weak")).join(F.broadcast(index.select(F.col("col_idx").alias("i"), F.col("source_idx").alias("source"), "name")), "i")
    nodes = found.select(key).join(F.broadcast(index.select(F.col("source_idx").alias("node")).distinct()))
    comps = gr.components(nodes, gr.durable(gr.source_edges(own, index, key, 0.97)), key)
    names = index.select("source_idx", F.concat(F.lit("s"), F.col("source_idx").cast("string")).alias("source_name")).distinct()
    return gr.ensemble_report(found, own, weak, gr.group_names(comps, names, key).withColumnRenamed("group", "grp"), index, key)[0]


@query()
def a32_quadrature(spark, sf):
    """Kernel mass of every column: emitted, retained on the grid, dropped."""
    own = city(spark, sf)
    flying, _ = rs.puffs(small(spark, sf).select("ix", "iy").distinct(), own, 3, 10, 10)
    return rs.mass_accounting(rs.retained(flying, 10, 10), own, small(spark, sf), basis(spark, sf))


GROUPS = [(0, "traffic"), (1, "industries"), (2, "population_density"), (3, "brick_kilns")]
NEAR = "least(abs(hour(ts) - {0}), 24 - abs(hour(ts) - {0}))"
NAMED = ("named AS (SELECT t_idx, basis_idx, phi::DOUBLE AS phi FROM (" + " UNION ALL ".join([
    "SELECT t_idx, 0::BIGINT AS basis_idx, CASE WHEN hour(ts) <= 3 OR hour(ts) >= 21 THEN 1.0 ELSE 0.0 END AS phi FROM hours", *[f"SELECT t_idx, {i}, CASE WHEN hour(ts) BETWEEN {a} AND {b} THEN 1.0 ELSE 0.0 END FROM hours" for i, a, b in ((1, 4, 9), (2, 10, 15), (3, 16, 20))],
    "SELECT t_idx, 4, CASE WHEN (t_idx // 12) % 2 = 0 THEN 0.60 ELSE 0.25 END FROM hours", "SELECT t_idx, 5, CASE WHEN hour(ts) BETWEEN 7 AND 19 THEN 1.0 ELSE 0.35 END FROM hours",
    "SELECT t_idx, 6, least(1.0, 0.2 + " + " + ".join(f"0.8 * exp(-0.5 * ({NEAR.format(p)} / 1.25) * ({NEAR.format(p)} / 1.25))" for p in (7, 13, 19)) + ") FROM hours",
]) + ")), may(source_idx, basis_idx) AS (VALUES (0::BIGINT, 0::BIGINT), (0, 1), (0, 2), (0, 3), (1, 5), (2, 6), (3, 4))")


@query(WHOLE + ", " + NAMED + f" SELECT t_idx, basis_idx, {s6('phi')} AS phi FROM named")
def f11_declared_basis(spark, sf):
    return ba.declared_basis(hours(spark, sf)).select("t_idx", "basis_idx", r6(F.col("phi")).alias("phi"))


@query(WHOLE + ", " + NAMED + f" SELECT k.t_idx, sensor_idx, s.source_idx, b.basis_idx, {s6('sum(mass * phi * g)')} AS h FROM kern k JOIN small s ON s.ix = k.ix AND s.iy = k.iy AND mass > 1e-6 JOIN may m ON m.source_idx = s.source_idx JOIN named b ON b.basis_idx = m.basis_idx AND b.t_idx = k.tau AND phi <> 0 GROUP BY 1, 2, 3, 4")
def f11_admissible_response(spark, sf):
    """The response of each group under its own components alone; masked columns are never computed."""
    own, maps, named = city(spark, sf), small(spark, sf), ba.declared_basis(hours(spark, sf)).select("t_idx", "basis_idx", "phi")
    may = ba.admissible(spark.createDataFrame(GROUPS, "source_idx long, source_name string"))
    flying, _ = rs.puffs(maps.select("ix", "iy").distinct(), own, L, 10, 10)
    pulls = rs.kernel(rs.emitting(flying, maps, named, may), sensors(spark), own)
    return rs.response(pulls, maps, named, admissible=may).withColumn("h", r6(F.col("h")))


@query(with_(DESIGN, RES) + f"SELECT CASE WHEN grouping(sensor_idx) = 0 THEN 'monitor' WHEN grouping(t_idx) = 0 THEN 'hour' ELSE 'window' END AS \"table\", window_id, sensor_idx, t_idx, {s6('sqrt(avg(r * r))')} AS rms, count(*) AS n FROM res GROUP BY GROUPING SETS ((window_id), (window_id, sensor_idx), (window_id, t_idx))")
def m12_residual_tables(spark, sf):
    return out.residual_tables(residuals(spark, sf)).withColumn("rms", r6(F.col("rms")))


@query(with_(GRID, HELD, PREDICTED) + f", s AS (SELECT {SCORES} FROM predicted) SELECT metric, value FROM (SELECT unnest(['vector_rmse', 'direction_mae', 'speed_mae', 'n']) AS metric, unnest([{s6('vector_rmse')}, {s6('direction_mae')}, {s6('speed_mae')}, n::DOUBLE]) AS value FROM s)")
def m12_wind_validation(spark, sf):
    scores = sp.scores(sp.predict_held_out(panel(spark, sf), placed(spark, sf), held(spark, sf).where("held_out")))
    return out.metric_rows(scores.select(*[r6(F.col(c)).alias(c) for c in ("vector_rmse", "direction_mae", "speed_mae")], "n"), "vector_rmse", "direction_mae", "speed_mae", "n")


def group_of(own, spark):
    names = spark.createDataFrame([(s, f"s{s}") for s in range(4)], "source_idx long, source_name string")
    return gr.group_names(own["components"], names, "window_id").withColumnRenamed("group", "grp")


@query()
def m12_identifiability_table(spark, sf):
    own = chain(spark, sf)
    return out.identifiability(own["summary"], own["pairs"], own["weakness"], group_of(own, spark), "window_id")


@query()
def m12_monitor_table(spark, sf):
    """Projected contributions of each source's group to each monitor; a group stands under the number of its first source."""
    own = chain(spark, sf)
    named = own["contributions"].withColumn("grp", F.concat(F.lit("g"), F.col("component").cast("string")))
    return out.monitors(named, [f"g{s}" for s in range(4)])


def drawn_fits(spark, sf, method, n=5, scale=0.3):
    """Fits of every drawn wind to what the city's wind carries of known coefficients, so that their spread is that of the wind alone."""
    members = sp.ensemble(panel(spark, sf), placed(spark, sf), n, method, "a29", scale)
    own, wind = small(spark, sf), city(spark, sf)
    cells = own.select("ix", "iy").distinct()
    truth = {f"h{r.source_idx}_{r.basis_idx}": r.c for r in st.synthetic_coefficients(spark.createDataFrame(COLUMNS, "source_idx long, basis_idx long"), "truth").collect()}
    carried = rs.wide_response(rs.kernel(rs.puffs(cells, wind, 3, 10, 10)[0], sensors(spark), wind), own, basis(spark, sf), COLUMNS, ["t_idx", "sensor_idx"])
    made = carried.select("t_idx", "sensor_idx", sum((F.col(c) * v for c, v in truth.items()), F.lit(0.0)).alias("y"))
    rows = gr.durable(made.join(background_hours(spark, sf), "t_idx"))
    return st.transport_ensemble(members, hours(spark, sf), cells, sensors(spark), own, basis(spark, sf), rows, ["one", "time_1", "sin_1", "cos_1"], COLUMNS, 10, 10, 3, 0.2)


@query()
def t7_a29_bootstrap_intervals(spark, sf):
    """Quantiles of every coefficient over winds of stations drawn with replacement."""
    return fi.ensemble_intervals(drawn_fits(spark, sf, "bootstrap"), "name")


@query()
def t7_a29_perturbed_intervals(spark, sf):
    """The same over winds with Gaussian errors at every station and hour."""
    return fi.ensemble_intervals(drawn_fits(spark, sf, "perturb"), "name")

"""Queries of inventories, activities and the lagged response."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..functions import wind as w
from ..operators import inventory as inv
from ..operators import readings as rd
from ..operators import response as rs
from . import q_readings as qr
from .q_readings import hours, panel
from .registry import BASE, HOURS, INVENTORY, READINGS, inventory, query, r6, s6, with_

DENSE = "dense AS (SELECT s.source_idx, g.i AS ix, h.j AS iy, coalesce(v.mass, 0.0) AS mass FROM (SELECT DISTINCT source_idx FROM inventory) s CROSS JOIN range(40) g(i) CROSS JOIN range(40) h(j) LEFT JOIN inventory v ON v.source_idx = s.source_idx AND v.ix = g.i AND v.iy = h.j)"
SMALL = "small AS (SELECT source_idx, ix // 4 AS ix, iy // 4 AS iy, sum(mass) / 16 AS mass FROM inventory GROUP BY 1, 2, 3)"
NAMES = "names(source_idx, source_name) AS (VALUES (0::BIGINT, 'traffic_06'), (1::BIGINT, 'industries'), (2::BIGINT, 'population_density'), (3::BIGINT, 'brick_kilns'))"
EVERY = ("brick_kilns", "industries", "population_density", "traffic_00", "traffic_06", "traffic_12", "traffic_18", "fires")
EVERY_NAME = "names(source_idx, source_name) AS (VALUES " + ", ".join(f"({i}::BIGINT, '{n}')" for i, n in enumerate(EVERY)) + ")"
D = "least(abs(hour(ts) - {0}.0), 24.0 - abs(hour(ts) - {0}.0))"
COOK = " + ".join(f"0.8 * exp(-0.5 * ({D.format(p)} / 1.25) * ({D.format(p)} / 1.25))" for p in (7, 13, 19))
ACTIVITY = f"""activity AS (SELECT t_idx, ts, source_idx, source_name, CASE source_name WHEN 'traffic_00' THEN (hour(ts) <= 3 OR hour(ts) >= 21)::INTEGER WHEN 'traffic_06' THEN (hour(ts) BETWEEN 4 AND 9)::INTEGER
  WHEN 'traffic_12' THEN (hour(ts) BETWEEN 10 AND 15)::INTEGER WHEN 'traffic_18' THEN (hour(ts) BETWEEN 16 AND 20)::INTEGER
  WHEN 'industries' THEN CASE WHEN hour(ts) >= 7 AND hour(ts) <= 19 THEN 1.0 ELSE 0.5125 END WHEN 'population_density' THEN least(0.2 + {COOK}, 1.0)
  WHEN 'brick_kilns' THEN CASE WHEN ((t_idx + {clock.phase()}) // 12) % 2 = 0 THEN 0.60 ELSE 0.25 END ELSE 0.0 END::DOUBLE AS theta FROM hours CROSS JOIN names)"""


def names(spark):
    return spark.createDataFrame([(0, "traffic_06"), (1, "industries"), (2, "population_density"), (3, "brick_kilns")], "source_idx long, source_name string")


def small(spark, sf):
    return inv.coarsen(inventory(spark, sf), 40, 40, 10, 10)


def activity(spark, sf):
    return inv.profiles(hours(spark, sf), names(spark))


@query(with_(INVENTORY, DENSE) + f", p AS (SELECT source_idx, quantile_cont(mass, 0.99) AS p99 FROM dense GROUP BY 1) SELECT source_idx, ix, iy, {s6('CASE WHEN p99 <= 1e-8 THEN 0.0 ELSE mass / (p99 + 1e-8) END')} AS mass, {s6('CASE WHEN p99 <= 1e-8 THEN 1.0 ELSE p99 END')} AS scale FROM inventory JOIN p USING (source_idx)")
def a3_normalized_sources(spark, sf):
    return inv.normalized(inventory(spark, sf), 40, 40).select("source_idx", "ix", "iy", r6(F.col("mass")).alias("mass"), r6(F.col("scale")).alias("scale"))


@query(with_(INVENTORY, DENSE) + f"SELECT source_idx, min(mass) AS least, max(mass) AS most, {s6('quantile_cont(mass, 0.99)')} AS p99, count(*) FILTER (mass <> 0) AS nonzero, max(abs(mass)) = 0 AS all_zero FROM dense GROUP BY 1")
def a4_source_statistics(spark, sf):
    return inv.profile(inventory(spark, sf), 40, 40).withColumn("p99", r6(F.col("p99")))


@query(with_(INVENTORY) + "SELECT source_idx, ix - 21 AS ix, iy - 16 AS iy, mass FROM inventory WHERE ix >= 21 AND ix < 36 AND iy >= 16 AND iy < 40")
def p5_crop(spark, sf):
    return inv.crop(inventory(spark, sf), 21, 36, 16, 40)


@query(with_(INVENTORY, SMALL) + f"SELECT source_idx, ix, iy, {s6('mass')} AS mass FROM small")
def a6_block_mean(spark, sf):
    return small(spark, sf).withColumn("mass", r6(F.col("mass")))


@query(with_(INVENTORY) + ", px AS (SELECT i AS tx, CAST(round_even(i * (39 / 11.0), 0) AS BIGINT) AS ix FROM range(12) r(i)) SELECT source_idx, a.tx AS ix, b.tx AS iy, mass FROM inventory v JOIN px a ON a.ix = v.ix JOIN px b ON b.ix = v.iy")
def a6_nearest_cells(spark, sf):
    return inv.coarsen(inventory(spark, sf), 40, 40, 12, 12)


@query(with_(INVENTORY) + f"SELECT CASE WHEN source_idx < 2 THEN 0::BIGINT ELSE source_idx - 1 END AS group_idx, ix, iy, {s6('sum(mass) / CASE WHEN max(source_idx) < 2 THEN 2 ELSE 1 END')} AS mass FROM inventory GROUP BY 1, 2, 3")
def a7_category_groups(spark, sf):
    groups = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 2)], "source_idx long, group_idx long")
    return inv.grouped(inventory(spark, sf), groups).select("group_idx", "ix", "iy", r6(F.col("mass")).alias("mass"))


@query(with_(READINGS, HOURS, INVENTORY, SMALL, NAMES, ACTIVITY) + f"SELECT t_idx, ix, iy, {s6('sum(theta * mass)')} AS emission FROM activity JOIN small USING (source_idx) GROUP BY 1, 2, 3")
def a8_emission_field(spark, sf):
    return inv.emissions(small(spark, sf), activity(spark, sf)).withColumn("emission", r6(F.col("emission")))


BASIS = "basis AS (SELECT t_idx, 0::BIGINT AS basis_idx, 1.0::DOUBLE AS phi FROM hours UNION ALL SELECT t_idx, 1, 1.0 + sin(2 * pi() * hour(ts) / 24.0) FROM hours)"
COEF = "coefficients AS (SELECT CAST(s AS BIGINT) AS source_idx, CAST(b AS BIGINT) AS basis_idx, 0.25 * (1 + s) + 0.5 * b AS c FROM range(4) t(s), range(2) u(b))"


def basis(spark, sf):
    own = hours(spark, sf)
    one = own.select("t_idx", F.lit(0).cast("long").alias("basis_idx"), F.lit(1.0).alias("phi"))
    return one.unionByName(own.select("t_idx", F.lit(1).cast("long").alias("basis_idx"), (1.0 + F.sin(2 * F.pi() * F.hour("ts") / 24.0)).alias("phi")))


def coef(spark):
    from .registry import coefficients

    return coefficients(spark)


@query(with_(READINGS, HOURS, BASIS, COEF) + f"SELECT t_idx, source_idx, {s6('sum(phi * c)')} AS theta FROM basis JOIN coefficients USING (basis_idx) GROUP BY 1, 2")
def a9_activity_from_basis(spark, sf):
    return inv.activity_from_basis(basis(spark, sf), coef(spark)).withColumn("theta", r6(F.col("theta")))


@query(with_(READINGS, HOURS, EVERY_NAME, ACTIVITY) + f"SELECT t_idx, source_name, {s6('theta')} AS theta FROM activity")
def f10_activity_profiles(spark, sf):
    """Of every source that has a profile, and of one that has none."""
    every = spark.createDataFrame(list(enumerate(EVERY)), "source_idx long, source_name string")
    return inv.profiles(hours(spark, sf), every).select("t_idx", "source_name", r6(F.col("theta")).alias("theta"))


@query(with_(READINGS, HOURS, NAMES, ACTIVITY) + f", m AS (SELECT *, max(theta) OVER (PARTITION BY source_idx) AS top FROM activity) SELECT source_idx, {s6('sum(theta)')} AS total, {s6('avg(CASE WHEN top > 0 AND theta > 0.5 * top THEN 1.0 ELSE 0.0 END)')} AS active_fraction FROM m GROUP BY 1")
def a17_a18_contribution(spark, sf):
    return inv.contribution(activity(spark, sf)).select("source_idx", r6(F.col("total")).alias("total"), r6(F.col("active_fraction")).alias("active_fraction"))


@query(with_(READINGS, HOURS, NAMES, ACTIVITY) + f"SELECT source_idx, h AS hour, {s6('coalesce(avg(theta), 0.0)')} AS theta FROM names CROSS JOIN range(24) r(h) LEFT JOIN activity USING (source_idx) WHERE hour(ts) = h OR ts IS NULL GROUP BY 1, 2")
def a19_diurnal_profile(spark, sf):
    return inv.diurnal(activity(spark, sf)).withColumn("theta", r6(F.col("theta")))


@query(with_(READINGS, HOURS, NAMES, ACTIVITY) + f"SELECT source_idx, CAST(ts AS DATE) AS day, {s6('sum(theta)')} AS theta FROM activity GROUP BY 1, 2")
def a20_daily_totals(spark, sf):
    return inv.daily(activity(spark, sf)).withColumn("theta", r6(F.col("theta")))


@query(with_(INVENTORY) + "SELECT source_idx, ix + 3 AS ix, iy - 2 AS iy, mass FROM inventory WHERE ix + 3 BETWEEN 0 AND 39 AND iy - 2 BETWEEN 0 AND 39")
def f12_shift(spark, sf):
    return inv.shift(inventory(spark, sf), 3, -2, 40, 40)


@query(with_(INVENTORY) + ", c AS (SELECT source_idx, sum(mass * ix) / sum(mass) AS cx, sum(mass * iy) / sum(mass) AS cy FROM inventory GROUP BY 1), b AS (SELECT source_idx, i AS tx, j AS ty, CAST(round_even(cx + (i - cx) / 1.3, 0) AS BIGINT) AS ix, CAST(round_even(cy + (j - cy) / 1.3, 0) AS BIGINT) AS iy FROM c, range(40) a(i), range(40) d(j)) SELECT source_idx, tx AS ix, ty AS iy, mass FROM b JOIN inventory USING (source_idx, ix, iy)")
def f12_rescale(spark, sf):
    return inv.rescale(inventory(spark, sf), 1.3, 40, 40)


@query(with_(INVENTORY) + "SELECT CASE source_idx WHEN 0 THEN 2 WHEN 2 THEN 0 ELSE source_idx END AS source_idx, ix, iy, mass FROM inventory")
def f12_swap(spark, sf):
    return inv.swap(inventory(spark, sf), 0, 2)


@query(with_(INVENTORY) + "SELECT source_idx, ix, iy, mass FROM inventory WHERE mass > 60")
def p6_active_cells(spark, sf):
    return inv.above(inventory(spark, sf), 60.0)


@query(with_(INVENTORY) + "SELECT count(DISTINCT (ix, iy)) AS n_cells, count(DISTINCT (ix, iy)) <= 1500 AS ok FROM inventory WHERE mass > 60")
def t3_cell_cap(spark, sf):
    return inv.cell_count_guard(inventory(spark, sf), 60.0, 1500)


@query(with_(INVENTORY, NAMES) + "SELECT 'maps_finite_nonnegative' AS check_name, count(*) FILTER (mass IS NULL OR isnan(mass) OR mass < 0) AS n_violations FROM inventory UNION ALL SELECT 'names_unique', count(*) - count(DISTINCT source_name) FROM names UNION ALL SELECT 'names_nonempty', count(*) FILTER (coalesce(trim(source_name), '') = '') FROM names UNION ALL SELECT 'sensors_inside', 1")
def c10_input_contract(spark, sf):
    sensors = spark.createDataFrame([(0, 2.0, 2.0), (1, 9.6, 3.0)], "sensor_idx long, x double, y double")
    return inv.input_checks(inventory(spark, sf), names(spark), sensors, 10, 10)


@query("SELECT event_id FROM events WHERE value / 10 BETWEEN -0.5 AND 9.5 AND event_id % 12 - 1 BETWEEN -0.5 AND 9.5")
def p10_inside_domain(spark, sf):
    from .registry import base

    return base(spark, sf, "events").where(w.inside(F.col("value") / 10, (F.col("event_id") % 12 - 1).cast("double"), 10, 10)).select("event_id")


# The response of four sensors on a 10 x 10 grid, six lags, under the city's wind scaled down.
L = 6
SENSORS = "sensors(sensor_idx, sx, sy) AS (VALUES (0::BIGINT, 2.0::DOUBLE, 2.0::DOUBLE), (1::BIGINT, 7.0, 2.0), (2::BIGINT, 2.0, 7.0), (3::BIGINT, 7.0, 7.0))"
CITY = f"city AS (SELECT t_idx, coalesce(avg(CASE WHEN ok THEN ux END), 0.0) * 0.2 AS vx, coalesce(avg(CASE WHEN ok THEN vy END), 0.0) * 0.2 AS vy FROM panel GROUP BY t_idx)"
PATHS = f"""nxt AS (SELECT t_idx, vx, vy, coalesce(lead(vx) OVER (ORDER BY t_idx), vx) AS vx1, coalesce(lead(vy) OVER (ORDER BY t_idx), vy) AS vy1 FROM city),
  steps AS (SELECT t_idx, k, (vx * (1 - k / 4.0) + vx1 * (k / 4.0)) / 4 AS sx, (vy * (1 - k / 4.0) + vy1 * (k / 4.0)) / 4 AS sy FROM nxt, range(4) r(k)),
  way AS (SELECT c.t_idx AS tau, l * 4 + k + 1 AS j, sum(s.sx) OVER w AS px, sum(s.sy) OVER w AS py FROM city c CROSS JOIN range({L - 1}) q(l) JOIN steps s ON s.t_idx = c.t_idx + l WINDOW w AS (PARTITION BY c.t_idx ORDER BY l * 4 + k ROWS UNBOUNDED PRECEDING)),
  cells AS (SELECT DISTINCT ix, iy FROM small),
  exits AS (SELECT ix, iy, tau, min(j) AS exit_j FROM way, cells WHERE NOT (ix + px BETWEEN -0.5 AND 9.5 AND iy + py BETWEEN -0.5 AND 9.5) GROUP BY 1, 2, 3),
  ends AS (SELECT tau, j // 4 AS lag, px, py, px / (j / 4.0) AS wx, py / (j / 4.0) AS wy FROM way WHERE j % 4 = 0 UNION ALL SELECT t_idx, 0, 0.0, 0.0, vx, vy FROM city),
  puffs AS (SELECT c.ix, c.iy, e.tau, lag, c.ix + px AS x, c.iy + py AS y, wx, wy FROM ends e CROSS JOIN cells c LEFT JOIN exits q ON q.ix = c.ix AND q.iy = c.iy AND q.tau = e.tau WHERE exit_j IS NULL OR lag * 4 < exit_j)"""
KERNEL = """rot AS (SELECT p.tau + p.lag AS t_idx, p.tau, p.lag, s.sensor_idx, s.sx, s.sy, p.ix, p.iy, s.sx - p.x AS dx, s.sy - p.y AS dy, CASE WHEN sqrt(wx * wx + wy * wy) <= 1e-8 THEN 1.0 ELSE wx / sqrt(wx * wx + wy * wy) END AS ex,
  CASE WHEN sqrt(wx * wx + wy * wy) <= 1e-8 THEN 0.0 ELSE wy / sqrt(wx * wx + wy * wy) END AS ey, 0.49 * greatest(p.lag, 0.25) AS vp, 0.0625 * greatest(p.lag, 0.25) AS vq FROM puffs p CROSS JOIN sensors s WHERE p.tau + p.lag IN (SELECT t_idx FROM city)),
  kern AS (SELECT t_idx, tau, lag, sensor_idx, sx, sy, ix, iy, exp(-0.5 * ((dx * ex + dy * ey) * (dx * ex + dy * ey) / vp + (-dx * ey + dy * ex) * (-dx * ey + dy * ex) / vq)) / (2 * pi() * sqrt(vp * vq)) AS g FROM rot)"""
H = "resp AS (SELECT k.t_idx, sensor_idx, source_idx, basis_idx, sum(mass * phi * g) AS h FROM kern k JOIN small s ON s.ix = k.ix AND s.iy = k.iy AND mass > 1e-6 JOIN basis b ON b.t_idx = k.tau AND phi <> 0 GROUP BY 1, 2, 3, 4)"
WHOLE = with_(BASE, INVENTORY, SMALL, SENSORS, CITY, PATHS, KERNEL, BASIS, H)


def by_hour(sql, whole_sql=True):
    """Registers a query over every hour of events."""
    def add(f):
        def run(spark, sf):
            return f(spark, sf, None)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        query(WHOLE + sql if whole_sql else None)(run)
        return f

    return add


def sensors(spark):
    return spark.createDataFrame([(0, 2.0, 2.0), (1, 7.0, 2.0), (2, 2.0, 7.0), (3, 7.0, 7.0)], "sensor_idx long, sx double, sy double")


def city(spark, sf, last=None):
    rows = panel(spark, sf) if last is None else panel(spark, sf).where(F.col("t_idx") < last)
    return rd.city_mean(rows).select("t_idx", (F.col("vx") * 0.2).alias("vx"), (F.col("vy") * 0.2).alias("vy"))


def kernel(spark, sf, last=None):
    own = city(spark, sf, last)
    flying, exits = rs.puffs(small(spark, sf).select("ix", "iy").distinct(), own, L, 10, 10)
    return rs.kernel(flying, sensors(spark), own), exits


def lagged(spark, sf, last=None):
    return rs.response(kernel(spark, sf, last)[0], small(spark, sf), basis(spark, sf))


@by_hour(f"SELECT tau, j, {s6('px')} AS px, {s6('py')} AS py FROM way")
def j7_puff_paths(spark, sf, last):
    return rs.paths(city(spark, sf, last), L).select("tau", F.col("j").cast("long").alias("j"), r6(F.col("px")).alias("px"), r6(F.col("py")).alias("py"))


@by_hour("SELECT ix, iy, tau, lag, sensor_idx, t_idx FROM kern", whole_sql=False)  # a row for each kernel row
def j6_lagged_pairs(spark, sf, last):
    return kernel(spark, sf, last)[0].select("ix", "iy", "tau", "lag", "sensor_idx", "t_idx")


@query()
def f8_puff_density(spark, sf):
    return kernel(spark, sf)[0].select("t_idx", "ix", "iy", "tau", "lag", "sensor_idx", r6(F.col("g")).alias("g"))


@by_hour(f"SELECT t_idx, sensor_idx, source_idx, basis_idx, {s6('h')} AS h FROM resp")
def j9_lagged_response(spark, sf, last):
    return lagged(spark, sf, last).withColumn("h", r6(F.col("h")))


@by_hour(f"SELECT t_idx, sensor_idx, source_idx, basis_idx, {s6('h')} AS h FROM resp WHERE t_idx >= {L - 1}")
def p12_trimmed_response(spark, sf, last):
    return rs.response(kernel(spark, sf, last)[0], small(spark, sf), basis(spark, sf), trim=L - 1).withColumn("h", r6(F.col("h")))


@by_hour(f", p AS (SELECT sensor_idx, ix, iy, b.basis_idx, sum(phi * g) AS pull FROM kern k JOIN basis b ON b.t_idx = k.tau AND phi <> 0 GROUP BY 1, 2, 3, 4), {COEF}, f AS (SELECT sensor_idx, p.ix, p.iy, sum(mass * c * pull) AS fitted FROM p JOIN small s ON s.ix = p.ix AND s.iy = p.iy JOIN coefficients k ON k.source_idx = s.source_idx AND k.basis_idx = p.basis_idx GROUP BY 1, 2, 3), "
  f"g AS (SELECT sensor_idx, ix, iy, sum(pull) AS geometric FROM p GROUP BY 1, 2, 3) SELECT sensor_idx, ix, iy, {s6('geometric')} AS geometric, {s6('coalesce(fitted, 0.0)')} AS fitted FROM g LEFT JOIN f USING (sensor_idx, ix, iy)")
def a23_footprints(spark, sf, last):
    out = rs.footprints(rs.cell_response(kernel(spark, sf, last)[0], basis(spark, sf)), small(spark, sf), coef(spark))
    return out.select("sensor_idx", "ix", "iy", r6(F.col("geometric")).alias("geometric"), r6(F.col("fitted")).alias("fitted"))


@by_hour(f"SELECT source_idx, basis_idx, count(*) AS n_exits, {s6('sum(mass * phi)')} AS mass FROM exits e JOIN small s ON s.ix = e.ix AND s.iy = e.iy AND mass > 0 JOIN basis b ON b.t_idx = e.tau AND phi <> 0 GROUP BY 1, 2")
def a33_exit_accounting(spark, sf, last):
    return rs.exit_accounting(kernel(spark, sf, last)[1], small(spark, sf), basis(spark, sf)).withColumn("mass", r6(F.col("mass")))


TERMS = ", terms AS (SELECT k.t_idx, sensor_idx, source_idx, basis_idx, lag, mass * phi * g AS v FROM kern k JOIN small s ON s.ix = k.ix AND s.iy = k.iy JOIN basis b ON b.t_idx = k.tau), "
DELTAS = "g AS (SELECT t_idx, sensor_idx, source_idx, basis_idx, cut, sum(CASE WHEN lag < cut THEN v ELSE 0.0 END) AS h FROM terms, (SELECT unnest([2, 4, 6])::BIGINT AS cut) GROUP BY 1, 2, 3, 4, 5), n AS (SELECT *, lead(h) OVER (PARTITION BY t_idx, sensor_idx, source_idx, basis_idx ORDER BY cut) AS nx FROM g), d AS (SELECT cut AS lag, sqrt(sum((nx - h) * (nx - h))) / greatest(sqrt(sum(nx * nx)), 1e-12) AS delta FROM n WHERE nx IS NOT NULL GROUP BY 1)"


@by_hour(TERMS + DELTAS + f" SELECT lag, {s6('delta')} AS delta FROM d")
def a34_lag_convergence(spark, sf, last):
    return rs.lag_convergence(kernel(spark, sf, last)[0], small(spark, sf), basis(spark, sf), [2, 4, 6], 0.3)[0].withColumn("delta", r6(F.col("delta")))


@by_hour(TERMS + DELTAS + " SELECT coalesce(min(CASE WHEN delta <= 0.3 THEN lag END), 6) AS chosen FROM d")
def t5_chosen_lag(spark, sf, last):
    return rs.lag_convergence(kernel(spark, sf, last)[0], small(spark, sf), basis(spark, sf), [2, 4, 6], 0.3)[1]


@by_hour(f", q AS (SELECT t_idx, sx, sy, sum(g) AS v FROM kern GROUP BY 1, 2, 3) SELECT t_idx, {s6('sum(v * sx * sx) / sum(v) - (sum(v * sx) / sum(v)) * (sum(v * sx) / sum(v))')} AS var_x, {s6('sum(v * sy * sy) / sum(v) - (sum(v * sy) / sum(v)) * (sum(v * sy) / sum(v))')} AS var_y FROM q GROUP BY 1")
def a41_plume_moments(spark, sf, last):
    rows = kernel(spark, sf, last)[0].groupBy("t_idx", "sensor_idx").agg(F.sum("g").alias("v")).join(F.broadcast(sensors(spark)), "sensor_idx")
    return rs.moments(rows).select("t_idx", r6(F.col("var_x")).alias("var_x"), r6(F.col("var_y")).alias("var_y"))


@by_hour("SELECT source_idx, basis_idx, tau, k.ix, k.iy, k.t_idx, sensor_idx FROM kern k JOIN small s ON s.ix = k.ix AND s.iy = k.iy AND mass > 1e-6 JOIN basis b ON b.t_idx = k.tau AND phi <> 0 ORDER BY source_idx, basis_idx, tau, ix, iy, t_idx, sensor_idx LIMIT 500")
def t1_first_kernel_records(spark, sf, last):
    rows = kernel(spark, sf, last)[0].join(F.broadcast(small(spark, sf).where("mass > 1e-6")), ["ix", "iy"]).join(basis(spark, sf).where("phi <> 0").withColumnRenamed("t_idx", "tau"), "tau")
    keys = ["source_idx", "basis_idx", "tau", "ix", "iy", "t_idx", "sensor_idx"]
    return rows.orderBy(*keys).limit(500).select(*keys)


@by_hour(f", o AS (SELECT t_idx, CASE WHEN station_id = 1 THEN NULL ELSE station_id END AS idx, 's' || station_id AS sid, pm25 FROM panel WHERE station_id < 4) SELECT r.t_idx, r.sensor_idx, {s6('o.pm25')} AS y FROM (SELECT DISTINCT t_idx, sensor_idx FROM resp) r LEFT JOIN o ON o.t_idx = r.t_idx AND coalesce(o.idx, CAST(substr(o.sid, 2) AS BIGINT)) = r.sensor_idx")
def j15_aligned_observations(spark, sf, last):
    observed = panel(spark, sf).where("station_id < 4").select("t_idx", F.when(F.col("station_id") != 1, F.col("station_id")).alias("sensor_idx"), F.concat(F.lit("s"), F.col("station_id").cast("string")).alias("sensor_id"), F.col("pm25").alias("y"))
    ids = sensors(spark).select("sensor_idx", F.concat(F.lit("s"), F.col("sensor_idx").cast("string")).alias("sensor_id"))
    return rs.aligned(lagged(spark, sf, last), observed, ids).select("t_idx", "sensor_idx", r6(F.col("y")).alias("y"))


@query()
def j8_gridded_advection(spark, sf):
    from ..operators import spatial as sp
    from .q_spatial import placed

    field = sp.wind_field(panel(spark, sf), placed(spark, sf), 8, 8, dx_m=20000.0).select("t_idx", "ix", "iy", "dx", "dy")
    releases = hours(spark, sf).select(F.col("t_idx").alias("tau")).join(F.broadcast(sp.cells(spark, 8, 8).select("ix", "iy")))
    return rs.gridded(releases, field, rs.bilinear, 4, 8, 8)


@query(with_(BASE) + "SELECT t_idx, station_id AS sensor_idx FROM panel WHERE pm25 IS NOT NULL")
def p8_observed_rows(spark, sf):
    return panel(spark, sf).where("pm25_valid").select("t_idx", F.col("station_id").alias("sensor_idx"))

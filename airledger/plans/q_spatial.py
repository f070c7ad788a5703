"""Queries of interpolation, neighbours and held-out scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import readings as rd
from ..operators import spatial as sp
from .q_readings import panel
from .registry import BASE, GRID_STATIONS, query, r6, s6, stations, with_

GRID = BASE + ", " + GRID_STATIONS
WEIGHT = "exp(-0.5 * ((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)) / 16.0)"
CELLS = "cells AS (SELECT i AS ix, j AS iy, CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y FROM range(8) a(i), range(8) b(j))"
FIELD = CELLS + f""", kern AS (SELECT v.t_idx, c.ix, c.iy, {WEIGHT} AS w, v.ux, v.vy FROM panel v JOIN placed p ON v.station_id = p.station_id AND v.ok CROSS JOIN cells c),
  field AS (SELECT t_idx, ix, iy, CASE WHEN sum(w) > 1e-12 THEN sum(w * ux) / sum(w) ELSE avg(ux) END AS ux, CASE WHEN sum(w) > 1e-12 THEN sum(w * vy) / sum(w) ELSE avg(vy) END AS vy FROM kern GROUP BY 1, 2, 3)"""
HELD = "held AS (SELECT station_id FROM (SELECT station_id, row_number() OVER (ORDER BY md5('7' || station_id)) <= least(count(*) OVER () - 1, greatest(1, round_even(count(*) OVER () * 0.2, 0))) AS h FROM stations) WHERE h)"
PREDICTED = f"""pairs AS (SELECT c.t_idx, c.station_id, c.ux AS ox, c.vy AS oy, {WEIGHT} AS w, v.ux, v.vy FROM (SELECT a.*, q.x, q.y FROM panel a JOIN placed q USING (station_id) WHERE ok AND a.station_id IN (SELECT station_id FROM held)) c
  JOIN panel v ON v.t_idx = c.t_idx AND v.ok AND v.station_id NOT IN (SELECT station_id FROM held) JOIN placed p ON p.station_id = v.station_id),
  predicted AS (SELECT t_idx, station_id, ox, oy, CASE WHEN sum(w) > 1e-12 THEN sum(w * ux) / sum(w) ELSE avg(ux) END AS ux, CASE WHEN sum(w) > 1e-12 THEN sum(w * vy) / sum(w) ELSE avg(vy) END AS vy FROM pairs GROUP BY 1, 2, 3, 4)"""


def placed(spark, sf):
    return sp.place(stations(spark, sf), 8, 8)


def held(spark, sf):
    return rd.hold_out(stations(spark, sf), 0.2, "7")


@query(with_(GRID, FIELD) + f"SELECT t_idx, ix, iy, {s6('ux')} AS ux, {s6('vy')} AS vy, {s6('ux * 3.6')} AS dx, {s6('vy * 3.6')} AS dy FROM field")
def j4_j5_wind_field(spark, sf):
    return sp.wind_field(panel(spark, sf), placed(spark, sf), 8, 8).select("t_idx", "ix", "iy", *[r6(F.col(c)).alias(c) for c in ("ux", "vy", "dx", "dy")])


@query(with_(GRID) + ", c AS (SELECT station_id, CAST(least(greatest(round_even(x, 0), 0), 7) AS BIGINT) AS ix, CAST(least(greatest(round_even(y, 0), 0), 7) AS BIGINT) AS iy FROM placed), "
  "k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY station_id) AS r FROM c) WHERE r = 1), n AS (SELECT *, row_number() OVER (ORDER BY station_id) - 1 AS sensor_idx FROM k) "
  f"SELECT t_idx, sensor_idx, ix, iy, {s6('pm25')} AS pm25 FROM panel JOIN n USING (station_id) WHERE pm25 IS NOT NULL")
def j3_stations_to_cells(spark, sf):
    kept = sp.first_per_cell(placed(spark, sf)).select("station_id", "sensor_idx", "ix", "iy")
    return panel(spark, sf).where("pm25_valid").join(F.broadcast(kept), "station_id").select("t_idx", "sensor_idx", "ix", "iy", r6(F.col("pm25")).alias("pm25"))


@query(with_(GRID, HELD, PREDICTED) + f"SELECT t_idx, station_id, {s6('ux')} AS ux, {s6('vy')} AS vy, {s6('ox')} AS obs_ux, {s6('oy')} AS obs_vy FROM predicted")
def j11_held_out_prediction(spark, sf):
    out = sp.predict_held_out(panel(spark, sf), placed(spark, sf), held(spark, sf).where("held_out"))
    return out.select("t_idx", "station_id", *[r6(F.col(c)).alias(c) for c in ("ux", "vy", "obs_ux", "obs_vy")])


DIRECTION = "((degrees(atan2(-{0}, -{1})) % 360) + 360) % 360"
SCORES = f"""sqrt(avg((ux - ox) * (ux - ox) + (vy - oy) * (vy - oy))) AS vector_rmse,
  avg(least(abs({DIRECTION.format('ux', 'vy')} - {DIRECTION.format('ox', 'oy')}) % 360, 360 - abs({DIRECTION.format('ux', 'vy')} - {DIRECTION.format('ox', 'oy')}) % 360)) AS direction_mae,
  avg(abs(sqrt(ux * ux + vy * vy) - sqrt(ox * ox + oy * oy))) AS speed_mae, count(*) AS n"""


@query(with_(GRID, HELD, PREDICTED) + f", s AS (SELECT {SCORES} FROM predicted) SELECT {s6('vector_rmse')} AS vector_rmse, {s6('direction_mae')} AS direction_mae, {s6('speed_mae')} AS speed_mae, n FROM s")
def a31_held_out_scores(spark, sf):
    out = sp.scores(sp.predict_held_out(panel(spark, sf), placed(spark, sf), held(spark, sf).where("held_out")))
    return out.select(*[r6(F.col(c)).alias(c) for c in ("vector_rmse", "direction_mae", "speed_mae")], "n")


@query(with_(GRID, HELD, PREDICTED) + """, city AS (SELECT t_idx, avg(ux) AS ux, avg(vy) AS vy FROM panel WHERE ok AND station_id NOT IN (SELECT station_id FROM held) GROUP BY 1),
  r AS (SELECT sqrt(avg((ux - ox) * (ux - ox) + (vy - oy) * (vy - oy))) AS kernel FROM predicted), c AS (SELECT sqrt(avg((c.ux - ox) * (c.ux - ox) + (c.vy - oy) * (c.vy - oy))) AS mean FROM predicted p JOIN city c USING (t_idx))"""
  + f" SELECT {s6('kernel')} AS candidate, {s6('mean')} AS best_baseline, kernel < mean AS adopted FROM r, c")
def u4_imputer_comparison(spark, sf):
    kernel = sp.predict_held_out(panel(spark, sf), placed(spark, sf), held(spark, sf).where("held_out"))
    rest = panel(spark, sf).join(held(spark, sf).where("not held_out"), "station_id", "left_semi").where("vector_valid")
    city = kernel.drop("ux", "vy").join(rest.groupBy("t_idx").agg(F.avg("ux").alias("ux"), F.avg("vy").alias("vy")), "t_idx")
    both = kernel.withColumn("method", F.lit("kernel")).unionByName(city.withColumn("method", F.lit("city_mean")))
    return sp.adopted(sp.scores(both, "method"), "kernel").select(r6(F.col("candidate")).alias("candidate"), r6(F.col("best_baseline")).alias("best_baseline"), "adopted")


@query(with_(BASE) + """, rows AS MATERIALIZED (SELECT station_id, t_idx, ok FROM panel), hi AS MATERIALIZED (SELECT max(t_idx) AS hi FROM rows), near AS MATERIALIZED (SELECT DISTINCT r.station_id, r.t_idx, greatest(0, least(hi, r.t_idx + d)) AS n_t FROM rows r, hi, (SELECT unnest(range(-2, 3)) AS d)),
  p AS MATERIALIZED (SELECT n.station_id, n.t_idx, s.station_id AS n_station, n.n_t, row_number() OVER (PARTITION BY n.station_id, n.t_idx ORDER BY s.station_id, n.n_t) AS slot FROM near n JOIN rows s ON s.t_idx = n.n_t AND s.ok AND NOT (s.station_id = n.station_id AND s.t_idx = n.t_idx)),
  g AS (SELECT r.station_id, r.t_idx, CAST(k AS INTEGER) AS slot FROM rows r, range(1, 6) x(k))
  SELECT g.station_id, g.t_idx, g.slot, coalesce(p.n_station, f.n_station) AS n_station, coalesce(p.n_t, f.n_t) AS n_t FROM g LEFT JOIN p USING (station_id, t_idx, slot) LEFT JOIN p f ON f.station_id = g.station_id AND f.t_idx = g.t_idx AND f.slot = 1""")
def j10_space_time_neighbours(spark, sf):
    return sp.neighbours(panel(spark, sf).select("station_id", "t_idx", F.col("vector_valid").alias("allowed")), 2, 5)


@query(with_(BASE, HELD) + f""", lim AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM stations), n AS (SELECT max(t_idx) + 1 AS n FROM panel)
  SELECT p.station_id * n + t_idx AS linear_id, {s6('(lon - x0) / greatest(x1 - x0, 1e-9)')} AS x, {s6('(lat - y0) / greatest(y1 - y0, 1e-9)')} AS y, {s6('t_idx / greatest(n - 1, 1)')} AS t,
  CASE WHEN p.station_id IN (SELECT station_id FROM held) THEN 'validation' ELSE 'train' END AS part FROM panel p JOIN stations USING (station_id), lim, n WHERE ok""")
def m13_training_table(spark, sf):
    out = sp.supervision(panel(spark, sf), stations(spark, sf), held(spark, sf))
    return out.select("linear_id", *[r6(F.col(c)).alias(c) for c in ("x", "y", "t")], "part")


@query()
def t7_wind_ensemble(spark, sf):
    members = sp.ensemble(panel(spark, sf), placed(spark, sf), 4, "bootstrap", "s")
    points = members.select("member_id", "t_idx").distinct().join(F.broadcast(sp.cells(spark, 4, 4)))
    return sp.interpolate(points, members.drop("ensemble_kind"), ["member_id", "t_idx"], ["ux", "vy"])


@query()
def x1_user_imputer(spark, sf):
    def mean_of_hour(pdf):
        pdf["ux"] = pdf.ux.where(pdf.vector_valid, pdf.ux[pdf.vector_valid].mean())
        return pdf[["station_id", "t_idx", "ux"]]

    return sp.with_imputer(panel(spark, sf).select("station_id", "t_idx", "ux", "vector_valid"), mean_of_hour, "station_id long, t_idx long, ux double")


@query(with_(GRID, FIELD) + f", c AS (SELECT station_id, CAST(least(greatest(round_even(x, 0), 0), 7) AS BIGINT) AS ix, CAST(least(greatest(round_even(y, 0), 0), 7) AS BIGINT) AS iy FROM placed) SELECT t_idx, station_id, {s6('ux')} AS ux FROM field JOIN c USING (ix, iy)")
def j16_field_at_stations(spark, sf):
    field = sp.wind_field(panel(spark, sf), placed(spark, sf), 8, 8)
    return field.join(F.broadcast(placed(spark, sf).select("station_id", "ix", "iy")), ["ix", "iy"]).select("t_idx", "station_id", r6(F.col("ux")).alias("ux"))

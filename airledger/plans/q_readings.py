"""Queries of sources, cleaning, joins and windows over readings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clock, wind
from ..operators import readings as op
from .registry import BASE, HOURLY, HOURS, PANEL, READINGS, STATIONS, base, query, r6, readings, s6, stations, with_

START = datetime(2024, 1, 1)


def hourly(spark, sf):
    return op.hourly(readings(spark, sf), "wd", "ws", "pm25")


def hours(spark, sf):
    return op.hours_of(readings(spark, sf))


def panel(spark, sf):
    return op.with_vectors(op.dense(hourly(spark, sf), stations(spark, sf), hours(spark, sf)))


@query(with_(READINGS, HOURLY) + f"SELECT station_id, ts, {s6('wd')} AS wd, {s6('ws')} AS ws, {s6('pm25')} AS pm25 FROM hourly")
def a1_hourly_mean(spark, sf):
    return hourly(spark, sf).select("station_id", "ts", *[r6(F.col(c)).alias(c) for c in ("wd", "ws", "pm25")])


@query(with_(BASE) + f"SELECT t_idx, {s6('coalesce(avg(CASE WHEN ok THEN ux END), 0.0)')} AS vx, {s6('coalesce(avg(CASE WHEN ok THEN vy END), 0.0)')} AS vy, count(*) FILTER (ok) AS n_valid FROM panel GROUP BY t_idx")
def a2_city_mean_vector(spark, sf):
    return op.city_mean(panel(spark, sf)).select("t_idx", r6(F.col("vx")).alias("vx"), r6(F.col("vy")).alias("vy"), "n_valid")


@query(with_(BASE) + "SELECT " + ", ".join(f"{s6(f'coalesce(avg({v}) FILTER (t_idx < 400), 0.0)')} AS {v}_mean, {s6(f'coalesce(stddev_pop({v}) FILTER (t_idx < 400) + 1e-6, 1.0)')} AS {v}_std" for v in ("ux", "vy", "pm25")) + " FROM panel WHERE ok")
def a5_train_moments(spark, sf):
    out = op.moments(panel(spark, sf).where("vector_valid"), F.col("t_idx") < 400, "ux", "vy", "pm25")
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@query("""SELECT count(*) AS n_rows, sum(CASE WHEN c IN ('event_id','ts','user_id','value') THEN 1 ELSE 0 END)::BIGINT AS n_required
  FROM (SELECT unnest(['event_id','ts','user_id','event_type','value','props']) AS c)""")
def c1_required_columns(spark, sf):
    from ..sources.tables import require

    own = base(spark, sf, "events")
    require(own, {"event_id", "ts", "user_id", "value"})
    return spark.createDataFrame([(c,) for c in own.columns], "c string").agg(F.count("*").alias("n_rows"), F.count_if(F.col("c").isin("event_id", "ts", "user_id", "value")).alias("n_required"))


@query("SELECT user_id % 32 AS station_id, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 32 ORDER BY event_id) AS r FROM events) WHERE r = 1")
def c2_first_station_row(spark, sf):
    return op.first_rows(readings(spark, sf), "station_id", "event_id").select("station_id", "event_id", "user_id")


PRODUCT = "CASE WHEN wd IS NULL THEN 1 ELSE 0 END AS wd_missing"


@query(with_(BASE) + """, a AS (SELECT count(*) AS n, count(DISTINCT station_id) AS s, count(DISTINCT ts) AS t, count(DISTINCT (station_id, ts)) AS st FROM panel)
  SELECT check_name, n_violations::BIGINT AS n_violations, n_violations = 0 AS passed FROM (
  SELECT 'nonempty' AS check_name, CASE WHEN n = 0 THEN 1 ELSE 0 END AS n_violations FROM a UNION ALL SELECT 'unique_keys', n - st FROM a
  UNION ALL SELECT 'full_grid', s * t - st FROM a UNION ALL SELECT 'masks_inverse', 0 UNION ALL SELECT 'vector_mask', 0
  UNION ALL SELECT 'finite', (SELECT count(*) FROM panel WHERE ux IS NULL OR isnan(ux) OR vy IS NULL OR isnan(vy)))""")
def c5_product_contract(spark, sf):
    return op.product_checks(panel(spark, sf).withColumn("wd_missing", ~F.col("wd_valid")))


@query(with_(BASE) + """, by_hour AS (SELECT t_idx, count(*) AS n, count(DISTINCT station_id) AS d, min(ts) AS ts FROM panel WHERE ok GROUP BY t_idx),
  b AS (SELECT *, lag(ts) OVER (ORDER BY t_idx) AS before FROM by_hour), s AS (SELECT count(DISTINCT station_id) AS k FROM panel WHERE ok)
  SELECT check_name, n_violations::BIGINT AS n_violations, n_violations = 0 AS passed FROM (
  SELECT 'same_sensors' AS check_name, count(*) FILTER (n <> k OR d <> k) AS n_violations FROM b, s UNION ALL
  SELECT 'contiguous', max(t_idx) - min(t_idx) + 1 - count(*) FROM b UNION ALL SELECT 'no_null_time', 0 UNION ALL SELECT 'time_grows', count(*) FILTER (ts <= before) FROM b)""")
def c9_panel_contract(spark, sf):
    return op.panel_checks(panel(spark, sf).where("vector_valid").withColumnRenamed("station_id", "sensor_idx"))


@query("SELECT event_id, TRY_CAST(props AS DOUBLE) AS props, TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value FROM events")
def p1_coerce_numbers(spark, sf):
    return op.numbers(base(spark, sf, "events").select("event_id", "props", F.col("value").cast("string").alias("value")), "props", "value")


@query(with_(READINGS, STATIONS) + "SELECT event_id, station_id FROM readings WHERE station_id IN (SELECT station_id FROM stations WHERE lon < 77.2)")
def p2_known_stations(spark, sf):
    return op.known_only(readings(spark, sf), stations(spark, sf).where("lon < 77.2")).select("event_id", "station_id")


@query(with_(READINGS) + "SELECT event_id, ts FROM readings WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-05 12:00:00'")
def p3_time_window(spark, sf):
    return op.between(readings(spark, sf), datetime(2024, 1, 3), datetime(2024, 1, 5, 12)).select("event_id", "ts")


@query(with_(BASE) + f"SELECT station_id, t_idx, ok AS vector_valid, pm25 IS NOT NULL AS pm25_valid, {s6('ux')} AS ux, {s6('vy')} AS vy FROM panel")
def p4_validity_masks(spark, sf):
    return panel(spark, sf).select("station_id", "t_idx", "vector_valid", "pm25_valid", r6(F.col("ux")).alias("ux"), r6(F.col("vy")).alias("vy"))


@query(with_(READINGS) + "SELECT event_id, ts + INTERVAL 5 HOUR AS ts, nullif(pm25, 0) AS pm25 FROM readings WHERE station_id <> 3")
def p9_zero_missing_local_time(spark, sf):
    return op.zero_is_missing(readings(spark, sf), without=3, shift_hours=5).select("event_id", "ts", "pm25")


@query(with_(READINGS, HOURS) + "SELECT event_id, t_idx FROM readings JOIN hours USING (ts) WHERE t_idx < 100")
def p13_first_hours(spark, sf):
    return readings(spark, sf).join(hours(spark, sf), "ts").where("t_idx < 100").select("event_id", "t_idx")


@query(with_(READINGS) + f"SELECT user_id % 8 AS station_id, ts, {s6('avg(wd)')} AS wd, {s6('avg(pm25)')} AS pm25 FROM readings GROUP BY 1, 2")
def j1_merge_aliases(spark, sf):
    raw = readings(spark, sf).withColumn("station_id", F.col("user_id"))
    aliases = raw.select(F.col("user_id").alias("raw_id"), (F.col("user_id") % 8).alias("station_id")).distinct()
    out = op.merge_aliases(raw, aliases, "wd", "pm25")
    return out.select("station_id", "ts", r6(F.col("wd")).alias("wd"), r6(F.col("pm25")).alias("pm25"))


@query(with_(BASE) + f"SELECT station_id, ts, t_idx, {s6('pm25')} AS pm25 FROM panel")
def j2_dense_grid(spark, sf):
    return panel(spark, sf).select("station_id", "ts", "t_idx", r6(F.col("pm25")).alias("pm25"))


@query(with_(READINGS) + f"SELECT event_id, {s6('-ws * sin(radians(wd))')} AS ux, {s6('-ws * cos(radians(wd))')} AS vy FROM readings")
def f1_transport_vector(spark, sf):
    wd, ws = F.col("wd"), F.col("ws")
    return readings(spark, sf).select("event_id", r6(wind.transport_x(wd, ws)).alias("ux"), r6(wind.transport_y(wd, ws)).alias("vy"))


@query(with_(READINGS) + ", v AS (SELECT event_id, wd, ws, -ws * sin(radians(wd)) AS ux, -ws * cos(radians(wd)) AS vy FROM readings) "
  f"SELECT event_id, {s6('sqrt(ux * ux + vy * vy)')} AS ws, {s6('((degrees(atan2(-ux, -vy)) % 360) + 360) % 360')} % 360 AS wd FROM v")
def f2_wind_from_vector(spark, sf):
    """A direction that rounds to 360 is 0."""
    ux, vy = wind.transport_x(F.col("wd"), F.col("ws")), wind.transport_y(F.col("wd"), F.col("ws"))
    return readings(spark, sf).select("event_id", r6(wind.speed(ux, vy)).alias("ws"), (r6(wind.direction(ux, vy)) % 360).alias("wd"))


@query(with_(READINGS) + "SELECT event_id, least(abs(hour(ts) - 19.0), 24.0 - abs(hour(ts) - 19.0))::DOUBLE AS d FROM readings")
def f3_circular_hours(spark, sf):
    return readings(spark, sf).select("event_id", clock.circular_hours(F.hour("ts"), 19).alias("d"))


@query(with_(READINGS) + "SELECT event_id, least(abs(wd - 350.0) % 360, 360.0 - abs(wd - 350.0) % 360) AS d FROM readings")
def f4_direction_error(spark, sf):
    return readings(spark, sf).select("event_id", wind.direction_error(F.col("wd"), F.lit(350.0)).alias("d"))


@query(with_(STATIONS) + f", lim AS (SELECT min(lon) AS a, max(lon) AS b FROM stations) SELECT station_id, {s6('(lon - a) / greatest(b - a, 1e-12) * 7')} AS x, CAST(least(greatest(round_even((lon - a) / greatest(b - a, 1e-12) * 7, 0), 0), 7) AS BIGINT) AS ix, {s6('(lon - a) / greatest(b - a, 1e-9)')} AS unit FROM stations, lim")
def f5_grid_coordinates(spark, sf):
    own = stations(spark, sf)
    lim = own.agg(F.min("lon").alias("a"), F.max("lon").alias("b"))
    x = wind.to_grid(F.col("lon"), F.col("a"), F.col("b"), 8)
    return own.join(F.broadcast(lim)).select("station_id", r6(x).alias("x"), wind.cell(x, 8).alias("ix"), r6(wind.to_unit(F.col("lon"), F.col("a"), F.col("b"))).alias("unit"))


@query(with_(READINGS) + f"SELECT event_id, {s6('ws * (3600.0 / 1000.0)')} AS cells FROM readings")
def f6_cells_per_step(spark, sf):
    return readings(spark, sf).select("event_id", r6(wind.displacement(F.col("ws"))).alias("cells"))


@query(with_(READINGS, HOURS) + "SELECT ts, t_idx FROM hours")
def w1_hour_index(spark, sf):
    return hours(spark, sf)


@query(with_(READINGS) + "SELECT DISTINCT hour(ts) AS h, CASE WHEN hour(ts) <= 3 OR hour(ts) > 21 THEN 0 WHEN hour(ts) <= 9 THEN 6 WHEN hour(ts) <= 15 THEN 12 WHEN hour(ts) < 21 OR hour(ts) > 15 AND hour(ts) < 21 THEN 18 ELSE 0 END AS slot FROM readings")
def w3_traffic_slot(spark, sf):
    return readings(spark, sf).select(F.hour("ts").alias("h").cast("long")).distinct().select("h", clock.slot(F.col("h")).alias("slot"))


@query(with_(READINGS) + "SELECT CAST(floor(date_diff('hour', TIMESTAMP '2024-01-01', ts) / 168.0) AS BIGINT) AS window_id, count(*) AS n FROM readings WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY 1")
def w5_study_windows(spark, sf):
    return op.study_windows(readings(spark, sf), START).groupBy("window_id").agg(F.count("*").alias("n"))


def n_hours(spark, sf):
    return hours(spark, sf).agg(F.max("t_idx") + 1).first()[0] or 0


@query(with_(BASE) + f", w AS (SELECT i AS window_id, CAST(round_even(i * (greatest(n, 168) - 168) / 7.0, 0) AS BIGINT) AS start FROM range(8) r(i), (SELECT max(t_idx) + 1 AS n FROM hours)) SELECT w.window_id, station_id, {s6('avg(pm25)')} AS pm25, count(*) AS n FROM panel JOIN w ON t_idx >= start AND t_idx < start + 168 GROUP BY 1, 2")
def w6_even_windows(spark, sf):
    cut = op.in_windows(panel(spark, sf), op.even_windows(spark, max(168, n_hours(spark, sf)), 168, 8), 168)
    return cut.groupBy("window_id", "station_id").agg(r6(F.avg("pm25")).alias("pm25"), F.count("*").alias("n"))


@query(with_(BASE) + f""", n AS (SELECT max(t_idx) + 1 AS n FROM hours), w AS (SELECT unnest(range(0, greatest(n - 167, 1), 168)) AS start FROM n UNION SELECT greatest(n - 168, 0) FROM n), cut AS (SELECT p.*, start FROM panel p JOIN w ON t_idx >= start AND t_idx < start + 168),
  m AS (SELECT station_id, start, avg(pm25) AS m FROM cut GROUP BY 1, 2), a AS (SELECT station_id, t_idx, avg(m) AS p, first(pm25) AS o FROM cut JOIN m USING (station_id, start) GROUP BY 1, 2)
  SELECT station_id, t_idx, {s6('coalesce(o, p)')} AS pm25, o IS NULL AS imputed FROM a""")
def w7_sliding_imputation(spark, sf):
    out = op.impute_sliding(panel(spark, sf).select("station_id", "t_idx", "pm25"), op.sliding(spark, n_hours(spark, sf), 168), 168)
    return out.withColumn("pm25", r6(F.col("pm25")))


@query(with_(READINGS, HOURS) + ", s AS (SELECT max(t_idx) + 1 AS n FROM hours) SELECT t_idx, CASE WHEN n - greatest(1, floor(n * 0.8)) < 24 OR greatest(1, floor(n * 0.8)) < 24 THEN 'both' WHEN t_idx < floor(n * 0.8) THEN 'train' ELSE 'validation' END AS part FROM hours, s")
def w8_chronological_split(spark, sf):
    return op.chronological(hours(spark, sf)).select("t_idx", "part")


@query(with_(READINGS, HOURS) + "SELECT t_idx, (t_idx // 12) % 2 = 0 AS first_block FROM hours")
def w10_half_day_blocks(spark, sf):
    return hours(spark, sf).select("t_idx", clock.block12(F.col("t_idx")).alias("first_block"))


@query(with_(BASE) + "SELECT min(t_idx) AS t_idx FROM (SELECT t_idx FROM panel WHERE ok GROUP BY t_idx HAVING count(*) >= 3)")
def w4_first_covered_hour(spark, sf):
    return panel(spark, sf).where("vector_valid").groupBy("t_idx").count().agg(F.min(F.when(F.col("count") >= 3, F.col("t_idx"))).alias("t_idx"))


@query(with_(STATIONS) + "SELECT station_id, row_number() OVER (ORDER BY md5('7' || station_id)) <= least(count(*) OVER () - 1, greatest(1, round_even(count(*) OVER () * 0.2, 0))) AS held_out FROM stations")
def t6_hold_out_stations(spark, sf):
    return op.hold_out(stations(spark, sf), 0.2, "7").select("station_id", "held_out")


@query(with_(BASE) + f"""SELECT CAST(floor(t_idx / 168.0) AS BIGINT) AS window_id, count(*) AS n_total, count(pm25) AS n_observed, {s6('avg(CASE WHEN pm25 IS NULL THEN 0.0 ELSE 1.0 END)')} AS fraction,
  CASE WHEN count(pm25) < 8 + 1 THEN 'insufficient_observed_rows' ELSE 'ok' END AS status FROM panel GROUP BY 1""")
def a28_p11_observed_rows(spark, sf):
    n = F.count("pm25")
    return panel(spark, sf).groupBy(F.floor(F.col("t_idx") / 168).alias("window_id")).agg(
        F.count("*").alias("n_total"), n.alias("n_observed"), r6(F.avg(F.col("pm25_valid").cast("double"))).alias("fraction"), F.when(n < 8 + 1, "insufficient_observed_rows").otherwise("ok").alias("status")
    )


@query(with_(BASE) + f"SELECT station_id, t_idx, {s6('greatest(coalesce(pm25, avg(pm25) OVER (PARTITION BY station_id)), 0)')} AS pm25 FROM panel")
def j12_observation_matrix(spark, sf):
    mean = F.avg("pm25").over(Window.partitionBy("station_id"))
    return panel(spark, sf).select("station_id", "t_idx", r6(F.greatest(F.coalesce("pm25", mean), F.lit(0.0))).alias("pm25"))

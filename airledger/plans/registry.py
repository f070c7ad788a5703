"""Queries over the base tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = " ".join(sql.split())
        return f

    return add


def r6(c: Column) -> Column:
    """Six digits, and no negative zero. Sums in another order differ in their last bits, so ties are moved off first."""
    out = F.round(c + 1e-9, 6)
    return F.when(out == 0, F.lit(0.0)).otherwise(out)


def s6(sql: str) -> str:
    return f"(CASE WHEN round(({sql}) + 1e-9, 6) = 0 THEN 0.0 ELSE round(({sql}) + 1e-9, 6) END)"


#: SQL views over the base tables, matched by the functions below.
READINGS = """readings AS (SELECT user_id % 32 AS station_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts,
  CAST((event_id * 37) % 360 AS DOUBLE) AS wd, CAST(1 + k % 10 AS DOUBLE) AS ws,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS pm25, event_id, user_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
STATIONS = """stations AS (SELECT DISTINCT user_id % 32 AS station_id, 77.0 + CAST((7 * (user_id % 32)) % 32 AS DOUBLE) / 80.0 AS lon,
  28.4 + CAST((11 * (user_id % 32)) % 32 AS DOUBLE) / 80.0 AS lat FROM events)"""
HOURLY = """hourly AS (SELECT station_id, ts, avg(wd) AS wd, avg(ws) AS ws, avg(pm25) AS pm25 FROM readings GROUP BY station_id, ts)"""
HOURS = """hours AS (SELECT ts, dense_rank() OVER (ORDER BY ts) - 1 AS t_idx FROM (SELECT DISTINCT ts FROM readings))"""
PANEL = """panel AS (SELECT s.station_id, h.ts, h.t_idx, r.wd, r.ws, r.pm25, r.wd IS NOT NULL AND r.ws IS NOT NULL AS ok,
  CASE WHEN r.wd IS NOT NULL AND r.ws IS NOT NULL THEN -r.ws * sin(radians(r.wd)) ELSE 0.0 END AS ux,
  CASE WHEN r.wd IS NOT NULL AND r.ws IS NOT NULL THEN -r.ws * cos(radians(r.wd)) ELSE 0.0 END AS vy
  FROM stations s CROSS JOIN hours h LEFT JOIN hourly r ON r.station_id = s.station_id AND r.ts = h.ts)"""
GRID_STATIONS = """lim AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM stations),
  placed AS (SELECT station_id, (lon - x0) / greatest(x1 - x0, 1e-12) * 7 AS x, (lat - y0) / greatest(y1 - y0, 1e-12) * 7 AS y FROM stations, lim)"""
INVENTORY = """inventory AS (SELECT CAST(l_linenumber % 4 AS BIGINT) AS source_idx, l_partkey % 40 AS ix, l_suppkey % 40 AS iy, sum(l_quantity) AS mass
  FROM lineitem GROUP BY 1, 2, 3)"""
DESIGN = """design AS (SELECT CAST(month(l_shipdate) AS BIGINT) AS window_id, l_orderkey * 10 + l_linenumber AS row_id, l_quantity AS h1, l_discount * 100 AS h2, l_tax * 100 AS h3, l_extendedprice / 1e4 AS h4,
  0.5 * l_quantity + 30 * l_discount + 2.0 AS y FROM lineitem)"""
#: A response of 4 sensors x hours: rows of lineitem dealt to (t_idx, sensor_idx), two columns.
RESPONSE = """response AS (SELECT l_orderkey % 48 AS t_idx, l_partkey % 4 AS sensor_idx, CAST(l_linenumber % 4 AS BIGINT) AS source_idx, CAST(l_suppkey % 2 AS BIGINT) AS basis_idx, sum(l_quantity) / 1000.0 AS h
  FROM lineitem GROUP BY 1, 2, 3, 4),
  coefficients AS (SELECT CAST(s AS BIGINT) AS source_idx, CAST(b AS BIGINT) AS basis_idx, 0.25 * (1 + s) + 0.5 * b AS c FROM range(4) t(s), range(2) u(b))"""
BASE = ", ".join((READINGS, STATIONS, HOURLY, HOURS, PANEL))


def with_(*views: str) -> str:
    return "WITH " + ", ".join(views) + " "


def base(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Raw readings from events: hour, wind from the id and the properties, value as concentration."""
    k = F.get_json_object("props", "$.k").cast("long")
    return base(spark, sf, "events").select(
        (F.col("user_id") % 32).alias("station_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
        ((F.col("event_id") * 37) % 360).cast("double").alias("wd"), (1 + k % 10).cast("double").alias("ws"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("pm25"), "event_id", "user_id",
    )


def stations(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("station_id")
    return base(spark, sf, "events").select((F.col("user_id") % 32).alias("station_id")).distinct().select(
        "station_id", (77.0 + (7 * i % 32).cast("double") / 80.0).alias("lon"), (28.4 + (11 * i % 32).cast("double") / 80.0).alias("lat")
    )


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf, "lineitem").groupBy((F.col("l_linenumber") % 4).cast("long").alias("source_idx"), (F.col("l_partkey") % 40).alias("ix"), (F.col("l_suppkey") % 40).alias("iy")).agg(F.sum("l_quantity").alias("mass"))


def design(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf, "lineitem").select(
        F.month("l_shipdate").cast("long").alias("window_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.col("l_quantity").alias("h1"), (F.col("l_discount") * 100).alias("h2"), (F.col("l_tax") * 100).alias("h3"),
        (F.col("l_extendedprice") / 1e4).alias("h4"), (0.5 * F.col("l_quantity") + 30 * F.col("l_discount") + 2.0).alias("y"),
    )


def response(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf, "lineitem").groupBy(
        (F.col("l_orderkey") % 48).alias("t_idx"), (F.col("l_partkey") % 4).alias("sensor_idx"), (F.col("l_linenumber") % 4).cast("long").alias("source_idx"), (F.col("l_suppkey") % 2).cast("long").alias("basis_idx")
    ).agg((F.sum("l_quantity") / 1000.0).alias("h"))


def coefficients(spark: SparkSession) -> DataFrame:
    return spark.range(4).select(F.col("id").alias("source_idx")).join(spark.range(2).select(F.col("id").alias("basis_idx"))).withColumn("c", 0.25 * (1 + F.col("source_idx")) + 0.5 * F.col("basis_idx"))

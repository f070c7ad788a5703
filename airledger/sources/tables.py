"""Reading and writing tables: CSV with a declared schema, rasters, the wind product, runs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READINGS_SCHEMA = "monitor_id string, timestamp_round string, WD string, WS string, pm25 string"
STATIONS_SCHEMA = "`Monitor ID` string, Latitude double, Longitude double, Location string"


def require(df: DataFrame, columns: set[str]) -> DataFrame:
    """The same table; an error names the columns that are missing."""
    if missing := sorted(columns - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """Readings CSV as ``station_id, ts, wd, ws, pm25``; what is no number becomes null."""
    raw = require(spark.read.csv(path, header=True), {"monitor_id", "timestamp_round", "WD", "WS", "pm25"})
    return raw.select(
        F.col("monitor_id").alias("station_id"), F.col("timestamp_round").try_cast("timestamp").alias("ts"),
        *[F.col(c).try_cast("double").alias(c.lower()) for c in ("WD", "WS", "pm25")],
    )


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Stations CSV; the first row of an id (by place in its file) wins."""
    from ..operators.readings import first_rows

    raw = require(spark.read.csv(path, header=True), {"Monitor ID", "Latitude", "Longitude", "Location"})
    rows = raw.select(
        F.col("Monitor ID").alias("station_id"), F.col("Longitude").try_cast("double").alias("lon"), F.col("Latitude").try_cast("double").alias("lat"),
        F.col("Location").alias("location"), F.monotonically_increasing_id().alias("_place"),
    )
    return first_rows(rows, "station_id", "_place").drop("_place")


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """Long rasters ``source, ix, iy, intensity`` from Parquet."""
    return require(spark.read.parquet(path), {"source", "ix", "iy", "intensity"})


def write_product(product: DataFrame, path: str, meta: dict[str, str]) -> None:
    """The completed wind product by date, and its conventions as a one-row table beside it."""
    product.withColumn("date", F.to_date("ts")).write.mode("overwrite").partitionBy("date").parquet(f"{path}/data")
    product.sparkSession.createDataFrame([tuple(meta.values())], list(meta)).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_product(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    return spark.read.parquet(f"{path}/data").drop("date"), spark.read.json(f"{path}/meta").first().asDict()


def write_run(rows: DataFrame, path: str, experiment: str, seed: int, config: dict[str, object]) -> None:
    """One partition of runs with its configuration and a digest of it."""
    text = ";".join(f"{k}={config[k]}" for k in sorted(config))
    out = rows.withColumns({"experiment": F.lit(experiment), "seed": F.lit(seed), "config": F.lit(text), "config_sha256": F.sha2(F.lit(text), 256)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment", "seed").parquet(path)


def read_runs(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Run results (JSON, one object a file) of all folders below, with ``run_dir`` and ``kind``."""
    reader = spark.read.option("recursiveFileLookup", True).option("multiLine", True)
    raw = (reader.schema(schema) if schema else reader).json(path)
    run_dir = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return raw.withColumn("run_dir", run_dir).withColumn("kind", F.when(F.col("experiment").startswith("observed"), "observed").otherwise("controlled"))


def write_report(report: DataFrame, path: str) -> None:
    """A report as CSV and JSON; a NaN is refused."""
    doubles = [c for c, t in report.dtypes if t in ("double", "float")]
    if doubles and not report.where(" or ".join(f"isnan(`{c}`)" for c in doubles)).isEmpty():
        raise ValueError("a report holds NaN")
    report.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    report.write.mode("overwrite").json(f"{path}/json")

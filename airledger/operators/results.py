"""Result tables: flattening, rounding, hashing, merging and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flattened(df: DataFrame, key: str, json: str, prefix: str = "") -> DataFrame:
    """``key, name, value`` of a JSON object: nested objects to dotted names (two levels), lists of up to eight as text, longer ones dropped."""
    top = df.select(key, F.explode(F.from_json(json, "map<string,string>")).alias("k", "v"))
    nested = top.where("v like '{%'").select(key, "k", F.explode(F.from_json("v", "map<string,string>")).alias("k2", "v2")).select(key, F.concat_ws(".", "k", "k2").alias("name"), F.col("v2").alias("value"))
    flat = top.where("v is null or v not like '{%'").select(key, F.col("k").alias("name"), F.col("v").alias("value")).unionByName(nested)
    return flat.where("value is null or value not like '[%' or size(from_json(value, 'array<string>')) <= 8")


def rounded(c: Column, digits: int = 6) -> Column:
    """NaN to null, then rounded."""
    return F.round(F.when(~F.isnan(c), c), digits)


def rounded_list(c: Column, digits: int = 6) -> Column:
    return F.transform(c, lambda x: rounded(x, digits))


def content_hash(df: DataFrame, *columns: str) -> DataFrame:
    """One digest of a table, whatever its row order: rows' digests are folded by their counts modulo buckets, so no list of all rows is gathered."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns]), 256)
    parts = [F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return df.select(row.alias("_h")).agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts), 256).alias("sha256"))


def merged(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """Tables of one label by name, with ``run`` where there are several."""
    if len(tables) == 1:
        return tables[0][1]
    out = None
    for run, df in tables:
        df = df.withColumn("run", F.lit(run))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def notes_in_order(notes: DataFrame) -> DataFrame:
    return notes.groupBy("note").agg(F.min("pos").alias("pos"))


def share_cell(admissible: Column, share: Column) -> Column:
    """``unsupported`` where a group has no admissible component, else its share."""
    return F.when(F.size(admissible) == 0, F.lit("unsupported")).otherwise(F.round(share, 6).cast("string"))


def apportionment(shares: DataFrame, groups: list[str]) -> DataFrame:
    """One row a window, a column a group; windows in order, nulls last."""
    return shares.groupBy("window_id").pivot("grp", groups).agg(F.first("share")).orderBy(F.col("window_id").asc_nulls_last())


def run_index(runs: DataFrame) -> DataFrame:
    return runs.groupBy("experiment").agg(F.sort_array(F.collect_list("run")).alias("runs"), F.count("*").alias("n"))


def residual_tables(residuals: DataFrame) -> DataFrame:
    """``table, window_id, sensor_idx, t_idx, rms, n`` of ``residuals(window_id, t_idx, sensor_idx, r)``: by window, by monitor and by hour of a window.

    Hours are nearly as many as rows, so rows dealt by window and hour (bounded.spread()) are
    grouped where they are; windows and monitors are few and summed from the same shuffle.
    """
    own = [F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rms"), F.count(F.lit(1)).alias("n")]
    columns = ["table", "window_id", "sensor_idx", "t_idx", "rms", "n"]
    none = lambda c: F.lit(None).cast(residuals.schema[c].dataType)
    sets = [[F.col("window_id")], [F.col("window_id"), F.col("sensor_idx")]]
    which = F.when(F.grouping("sensor_idx") == 0, "monitor").otherwise("window")
    few = residuals.groupingSets(sets, F.col("window_id"), F.col("sensor_idx")).agg(which.alias("table"), *own).withColumn("t_idx", none("t_idx"))
    hours = residuals.groupBy("window_id", "t_idx").agg(*own).withColumns({"table": F.lit("hour"), "sensor_idx": none("sensor_idx")})
    return few.select(columns).unionByName(hours.select(columns))


def metric_rows(scores: DataFrame, *metrics: str) -> DataFrame:
    """``metric, value``: one row of scores as a table; a row ``status`` without a value where there is none."""
    rows = scores.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("x.*")
    none = scores.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("status").alias("metric"), F.lit(None).cast("double").alias("value"))
    return rows.unionByName(none)


def monitors(contributions: DataFrame, groups: list[str]) -> DataFrame:
    """One row for each window and monitor, a column of projected contributions for each group; ``contributions(window_id, sensor_idx, grp, projected)``."""
    return contributions.groupBy("window_id", "sensor_idx").pivot("grp", groups).agg(F.sum("projected"))


def identifiability(summary: DataFrame, pairs: DataFrame, weakness: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """One row for each window: spectrum, largest coherence, weak columns, ambiguous pairs and report groups as sorted lists.

    ``pairs(key, i, j, coherence, ambiguous)``, ``weakness(key, name, weak)``, ``named(key, component, grp)``.
    """
    most = pairs.groupBy(key).agg(F.max("coherence").alias("max_coherence"), F.array_sort(F.collect_list(F.when(F.col("ambiguous"), F.concat_ws("-", "i", "j")))).alias("ambiguous_pairs"))
    weak = weakness.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("weak"), F.col("name")))).alias("weak_set"))
    groups = named.groupBy(key).agg(F.array_sort(F.collect_list("grp")).alias("report_components"))
    sigma = summary.withColumn("sigma_1", F.get("spectrum", F.lit(0)))
    return sigma.select(key, "status", "n_observed", "n_total", "sigma_1", "sigma_j", "rank", "effective_rank", "condition", "visibility").join(most, key, "left").join(weak, key, "left").join(groups, key, "left")

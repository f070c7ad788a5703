"""Ambiguity graphs, components, and contributions of groups."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bounded import few


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder of the session; a folder of our own only on one machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint(eager=True)


def source_edges(pairs: DataFrame, columns: DataFrame, key: str, limit: float = 0.99) -> DataFrame:
    """Edges between sources with a column pair above ``limit``: the pair of highest coherence (first on ties), and the least ray distance."""
    named = lambda side: few(columns.select(F.col("col_idx").alias(side), F.col("source_idx").alias(f"s{side}")))
    cross = pairs.where(F.col("coherence") > limit).join(named("i"), "i").join(named("j"), "j").where("si <> sj")
    return cross.groupBy(key, F.least("si", "sj").alias("a"), F.greatest("si", "sj").alias("b")).agg(
        F.max_by(F.struct("i", "j", "coherence"), F.struct("coherence", -F.col("i"), -F.col("j"))).alias("t"), F.min("ray_distance").alias("ray_distance")
    ).select(key, "a", "b", "t.i", "t.j", "t.coherence", "ray_distance")


def components(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``key, node, component``: least reachable node of each window; labels spread and jump until none changes."""
    both = durable(edges.select(key, "a", "b").unionByName(edges.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(nodes.select(key, "node", F.col("node").alias("component")))
    while True:
        near = both.join(labels.select(key, F.col("node").alias("b"), "component"), [key, "b"]).groupBy(key, F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        step = labels.join(near, [key, "node"], "left").select(key, "node", F.col("component").alias("_old"), F.least("component", "_near").alias("_mid"))
        hop = labels.select(key, F.col("node").alias("_mid"), F.col("component").alias("_far"))
        moved = durable(step.join(hop, [key, "_mid"], "left").select(key, "node", "_old", F.least("_mid", "_far").alias("component")))
        labels = moved.drop("_old")
        if moved.where("component <> _old").isEmpty():
            return labels


def group_names(components_: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``key, component, group``: members' names joined by ``+`` in order of their numbers."""
    own = components_.join(few(names.select(F.col("source_idx").alias("node"), "source_name")), "node")
    return own.groupBy(key, "component").agg(F.concat_ws("+", F.transform(F.array_sort(F.collect_list(F.struct("node", "source_name"))), lambda x: x.source_name)).alias("group"))


def group_sums(values: DataFrame, components_: DataFrame, key: str, *by: str) -> DataFrame:
    """Sums of members' values; never a refit. ``values(key, node, by..., v)``."""
    return values.join(components_, [key, "node"]).groupBy(key, "component", *by).agg(F.sum("v").alias("v"))


def per_sensor(rows: DataFrame, coefficients: DataFrame) -> DataFrame:
    """``sensor_idx, source_idx, projected, raw``: sums of ``h_t`` and ``h`` times coefficients."""
    own = rows.join(few(coefficients), ["source_idx", "basis_idx"])
    return own.groupBy("sensor_idx", "source_idx").agg(F.sum(F.col("h_t") * F.col("c")).alias("projected"), F.sum(F.col("h") * F.col("c")).alias("raw"))


def signal_shares(rows: DataFrame, coefficients: DataFrame) -> DataFrame:
    """L1 of each source's fitted signal over that of all; a total of 0 divides by 1."""
    signal = rows.join(few(coefficients), ["source_idx", "basis_idx"]).groupBy("t_idx", "sensor_idx", "source_idx").agg(F.sum(F.col("h") * F.col("c")).alias("s"))
    sums = signal.groupBy("source_idx").agg(F.sum(F.abs("s")).alias("l1"))
    total = F.sum("l1").over(Window.partitionBy())
    return sums.select("source_idx", "l1", (F.col("l1") / F.when(total > 0, total).otherwise(1.0)).alias("share"))


def window_ensemble(summaries: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Over windows: quantiles of sigma_j and chances of full rank; and for each unordered cross-source pair the share of windows where it is ambiguous (once a window)."""
    n = summaries.agg(F.count("*").alias("_n"))
    q = F.expr("percentile(sigma_j, array(0.05, 0.5, 0.95))")
    over = summaries.agg(q.alias("q"), F.avg((F.col("rank") == F.col("n_columns")).cast("double")).alias("p_full_rank"), F.count("*").alias("n")).select(F.col("q")[0].alias("q05"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q95"), "p_full_rank", "n")
    seen = pairs.where("ambiguous").groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.count_distinct("window_id").alias("k"))
    return over, seen.join(F.broadcast(n)).select("i", "j", (F.col("k") / F.col("_n")).alias("p_ambiguous"))


def resolution(diagnosed: DataFrame, edges: DataFrame, components_: DataFrame, weak: DataFrame, key: str) -> DataFrame:
    """``key, n_components, n_edges, merged, global_unresolved, weak_sources`` of each window.

    ``diagnosed(key, rank, n_columns)``; ``weak(key, source, all_weak)``. A window is
    unresolved as a whole if its columns are rank-deficient and yet no pair is an edge, so
    that no merge can help. Pairs of weak columns have no coherence and make no edge.
    """
    n_edges = edges.groupBy(key).agg(F.count("*").alias("n_edges"))
    sizes = components_.groupBy(key).agg(F.count_distinct("component").alias("n_components"), F.count("*").alias("_nodes"))
    names = weak.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("all_weak"), F.col("source")))).alias("weak_sources"))
    out = diagnosed.select(key, "rank", "n_columns").join(sizes, key, "left").join(n_edges, key, "left").join(names, key, "left")
    count = F.coalesce("n_edges", F.lit(0).cast("long"))
    return out.select(
        key, F.coalesce("n_components", F.lit(0).cast("long")).alias("n_components"), count.alias("n_edges"), F.coalesce(F.col("n_components") < F.col("_nodes"), F.lit(False)).alias("merged"),
        ((F.col("rank") < F.col("n_columns")) & (count == 0)).alias("global_unresolved"), "weak_sources",
    )


def ensemble_report(summaries: DataFrame, pairs: DataFrame, weak: DataFrame, components_: DataFrame, columns: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Four tables over a set of windows: spectra, weak columns, ambiguous pairs, groups.

    ``summaries(key, sigma_j, rank, effective_rank, n_columns)``; ``pairs(key, i, j,
    ambiguous)``; ``weak(key, name, weak)``; ``components_(key, component, grp)``;
    ``columns(col_idx, source_idx)``. All windows must have the same number of columns.
    Pairs are unordered and of different sources, and count once a window.
    """
    if summaries.select("n_columns").distinct().count() > 1:
        raise ValueError("windows of an ensemble must share their columns")
    n = summaries.agg(F.count("*").alias("_n"))
    q = F.expr("percentile(sigma_j, array(0.05, 0.5, 0.95))")
    share = lambda c: F.avg((F.col(c) == F.col("n_columns")).cast("double"))
    spectra = summaries.agg(q.alias("q"), share("rank").alias("p_full_rank"), share("effective_rank").alias("p_full_effective_rank"), F.count("*").alias("n")).select(
        *[F.col("q")[i].alias(x) for i, x in enumerate(("q05", "q50", "q95"))], "p_full_rank", "p_full_effective_rank", "n"
    )
    of = lambda df, by, count: df.groupBy(*by).agg(count.alias("_k")).join(F.broadcast(n)).select(*by, (F.col("_k") / F.col("_n")).alias("p"))
    named = lambda side: few(columns.select(F.col("col_idx").alias(side), F.col("source_idx").alias(f"_s{side}")))
    cross = pairs.where("ambiguous").join(named("i"), "i").join(named("j"), "j").where("_si <> _sj").select(key, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return spectra, of(weak.where("weak"), ["name"], F.count_distinct(key)), of(cross, ["i", "j"], F.count_distinct(key)), of(components_.select(key, "grp").distinct(), ["grp"], F.count("*"))


def group_signals(rows: DataFrame, coefficients: DataFrame, components_: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(shares, contributions) of the groups of each window, from members' fitted signals; never a refit.

    ``rows(key, t_idx, sensor_idx, source_idx, basis_idx, h, h_t)``; ``coefficients(key,
    source_idx, basis_idx, c)``. Shares ``key, component, l1, share``: L1 of a group's
    signal over that of all (a total of 0 divides by 1). Contributions ``key, sensor_idx,
    component, projected, raw``.
    """
    own = rows.join(few(coefficients), [key, "source_idx", "basis_idx"]).join(components_.withColumnRenamed("node", "source_idx"), [key, "source_idx"])
    signal = own.groupBy(key, "t_idx", "sensor_idx", "component").agg(F.sum(F.col("h_t") * F.col("c")).alias("projected"), F.sum(F.col("h") * F.col("c")).alias("raw"))
    by_sensor = signal.groupBy(key, "sensor_idx", "component").agg(F.sum("projected").alias("projected"), F.sum("raw").alias("raw"), F.sum(F.abs("raw")).alias("_l1"))
    sums = by_sensor.groupBy(key, "component").agg(F.sum("_l1").alias("l1"))
    total = F.sum("l1").over(Window.partitionBy(key))
    return sums.select(key, "component", "l1", (F.col("l1") / F.when(total > 0, total).otherwise(1.0)).alias("share")), by_sensor.drop("_l1")

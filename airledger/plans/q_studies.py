"""Queries of adequacy, studies, comparisons and result tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import adequacy as ad
from ..operators import factor as fa
from ..operators import fit as fi
from ..operators import groups as gr
from ..operators import results as out
from ..operators import response as rs
from ..operators import spatial as sp
from ..operators import study as st
from ..operators.bounded import spread
from ..sources import tables as tb
from .q_fits import COH, GRAM, coefficients, pairs, r4, residuals
from .q_inventory import basis, kernel, small
from .q_readings import panel
from .q_spatial import placed
from .registry import BASE, DESIGN, GRID_STATIONS, base, design, query, r6, s6, with_

TRIALS = "trials AS (SELECT CAST(o_custkey % 4 AS DOUBLE) * 0.4 AS amplitude, (o_orderkey * 7919 % 10007) / 10007.0::DOUBLE AS p FROM orders)"


def trials(spark, sf):
    return base(spark, sf, "orders").select(((F.col("o_custkey") % 4).cast("double") * 0.4).alias("amplitude"), ((F.col("o_orderkey") * 7919 % 10007) / 10007.0).alias("p"))


@query(with_(TRIALS) + f", a AS (SELECT amplitude, avg(CASE WHEN p <= 0.05 THEN 1.0 ELSE 0.0 END) AS rate, avg(p) AS mean_p, quantile_cont(p, 0.25) AS q25, quantile_cont(p, 0.75) AS q75, count(*) AS n FROM trials GROUP BY 1), b AS (SELECT *, lag(rate) OVER (ORDER BY amplitude) AS before FROM a) "
  f"SELECT amplitude, {s6('rate')} AS rate, {s6('mean_p')} AS mean_p, {s6('q25')} AS q25, {s6('q75')} AS q75, CASE WHEN amplitude = 0 THEN abs(rate - 0.05) <= 2 * sqrt(0.05 * 0.95 / n) END AS null_ok, coalesce(rate >= before, true) AS grows FROM b")
def a37_rejection_rates(spark, sf):
    return ad.rejection(trials(spark, sf)).select("amplitude", *[r6(F.col(c)).alias(c) for c in ("rate", "mean_p", "q25", "q75")], "null_ok", "grows")


@query(with_(TRIALS) + f", r AS (SELECT amplitude, p, row_number() OVER (PARTITION BY amplitude ORDER BY p) AS i, count(*) OVER (PARTITION BY amplitude) AS n FROM trials) SELECT amplitude, {s6('max(greatest(i / n - p, p - (i - 1) / n))')} AS ks FROM r GROUP BY 1")
def a38_uniform_distance(spark, sf):
    return ad.ks_uniform(trials(spark, sf), "amplitude").withColumn("ks", r6(F.col("ks")))


def factors(spark, sf):
    return fa.factor(design(spark, sf).withColumn("one", F.lit(1.0)), "window_id", ["one", "h1", "h2", "y"])


@query()
def m7_residual_adequacy(spark, sf):
    return ad.verdicts(ad.replicates(factors(spark, sf), "window_id", 1, 2, noise=0.5, n=1000, chunk=100), "window_id")


@query()
def m8_sweep(spark, sf):
    """Every setting draws the same noise, of its own size; all come from one factor of the rows."""
    configs = st.sweep(spark, noise=[0.0, 0.05, 0.2], slope=[1.0, 0.5])
    u = F.pmod(F.xxhash64(F.lit("sweep"), "row_id"), F.lit(1 << 20)) / float(1 << 20)
    rows = design(spark, sf).withColumns({"all_rows": F.lit(0), "one": F.lit(1.0), "z": F.col("y") * (2 * u - 1)})

    def columns_of(setting):
        m = np.zeros((5, 4))  # from one, h1, h2, y, z to one, h1, h2, y
        m[0, 0] = m[1, 1] = m[3, 3] = 1.0
        m[2, 2], m[4, 3] = setting.slope, setting.noise
        return m

    own = fa.recombined(fa.factor(rows, "all_rows", ["one", "h1", "h2", "y", "z"]), "all_rows", configs, columns_of)
    return fi.fit(own, "config_id", 1, ["h1", "h2"]).join(F.broadcast(configs), "config_id")


@query()
def m9_missing_source(spark, sf):
    """The target is made of h1 alone (null), also of h4 (visible), or also of a mix of known columns (in-span); the fit knows h1 and h2.

    ``out_of_span`` is the part of the omitted signal that the known columns don't span; null if nothing is omitted.
    """
    noise = F.pmod(F.xxhash64(F.lit("m9"), "row_id"), F.lit(1 << 20)) / float(1 << 20) - 0.5  # by row, however the rows are dealt
    rows = design(spark, sf).withColumns({"one": F.lit(1.0), "e": noise})
    omitted = [F.lit(0.0), F.col("h4"), 1.0 + 0.3 * F.col("h1") + 0.2 * F.col("h2")]
    cases = rows.withColumn("miss", F.array(*omitted)).select("*", F.posexplode("miss").alias("case_id", "m")).select(F.col("case_id").cast("long").alias("case_id"), "one", "h1", "h2", "m", (0.5 * F.col("h1") + F.col("m") + F.col("e")).alias("y"))
    r = lambda i: F.col("r")[4 * i + 3]
    whole = F.sqrt(r(0) ** 2 + r(1) ** 2 + r(2) ** 2 + r(3) ** 2)
    span = fa.factor(cases, "case_id", ["one", "h1", "h2", "m"]).select("case_id", F.when(whole > 0, F.abs(r(3)) / whole).alias("out_of_span"))
    found = ad.verdicts(ad.replicates(fa.factor(cases, "case_id", ["one", "h1", "h2", "y"]), "case_id", 1, 2, noise=12**-0.5, n=1000, chunk=100), "case_id")
    return found.join(F.broadcast(span), "case_id")


@query()
def m9_rejection_rates(spark, sf):
    """How often the test rejects where nothing, a visible and an in-span source is left out, with the part of each that the known columns don't span.

    The fit knows h1, h2 and a constant; what is left out has the energy of the known signal. 100 trials of 1000 refits each.
    """
    rows = design(spark, sf).withColumns({"one": F.lit(1.0), "known": 0.5 * F.col("h1") + 0.8 * F.col("h2"), "inner": 1.0 + 0.3 * F.col("h1") + 0.2 * F.col("h2")})
    size = rows.agg(*[F.sqrt(F.sum(F.col(c) ** 2)).alias(f"_{c}") for c in ("known", "h4", "inner")], (0.5 * F.max(F.abs("known"))).alias("sigma"))
    sized = rows.join(F.broadcast(size))
    omitted = F.array(F.lit(0.0), F.col("h4") * F.col("_known") / F.col("_h4"), F.col("inner") * F.col("_known") / F.col("_inner"))
    cases = sized.select("one", "h1", "h2", "known", F.posexplode(omitted).alias("case_id", "m")).select(F.col("case_id").cast("long").alias("case_id"), "one", "h1", "h2", "m", (F.col("known") + F.col("m")).alias("mean"))
    r = lambda i: F.col("r")[4 * i + 3]
    whole = F.sqrt(r(0) ** 2 + r(1) ** 2 + r(2) ** 2 + r(3) ** 2)
    span = fa.factor(cases, "case_id", ["one", "h1", "h2", "m"]).select("case_id", F.when(whole > 0, F.abs(r(3)) / whole).alias("out_of_span"))
    sigma = size.first().sigma
    found = ad.trials(fa.factor(cases, "case_id", ["one", "h1", "h2", "mean"]), "case_id", 1, 2, sigma)
    rates = found.groupBy("case_id").agg(F.avg(F.col("inadequate").cast("double")).alias("rate"), F.avg("p").alias("mean_p"), F.count("*").alias("n_trials"))
    return rates.join(F.broadcast(span), "case_id")


@query()
def m7_covariance_adequacy(spark, sf):
    """Each month's rows under noise that ties the lines of an order together (0.6 from line to line), whitened before they are reduced."""
    own = design(spark, sf).withColumns({"line": F.col("row_id") % 10, "order": F.floor(F.col("row_id") / 10), "one": F.lit(1.0)})
    lines = spark.range(1, 8).select(F.col("id").alias("i")).join(spark.range(1, 8).select(F.col("id").alias("j"))).withColumn("v", 0.25 * F.pow(F.lit(0.6), F.abs(F.col("i") - F.col("j"))))
    once = spread(own, "window_id", "order").groupBy("window_id", "order", "line").agg(*[F.avg(c).alias(c) for c in ("one", "h1", "h2", "y")])
    white = fa.whitened(once, ["window_id", "order"], "line", ["one", "h1", "h2", "y"], lines)
    noise = ad.Noise(1.0, calibrated=True, source="declared with the query")
    return ad.verdicts(ad.replicates(fa.factor(white, "window_id", ["one", "h1", "h2", "y"]), "window_id", 1, 2, noise, n=1000, chunk=250), "window_id")


FLAGS = "flags AS (SELECT c_custkey AS key, c_nationkey % 5 = 0 AS merged, c_nationkey % 7 = 0 AS weak, (c_custkey % 100) / 50.0 AS visibility, (c_custkey % 37) / 40.0 AS absorption, CAST(c_custkey % 11 AS DOUBLE) AS sigma_j, (c_custkey % 101) / 100.0 AS coherence FROM customer)"


def flags(spark, sf):
    k = F.col("c_custkey")
    return base(spark, sf, "customer").select(k.alias("key"), (F.col("c_nationkey") % 5 == 0).alias("merged"), (F.col("c_nationkey") % 7 == 0).alias("weak"), (k % 100 / 50.0).alias("visibility"), (k % 37 / 40.0).alias("absorption"), (k % 11).cast("double").alias("sigma_j"), (k % 101 / 100.0).alias("coherence"))


@query(with_(FLAGS) + "SELECT key, merged OR weak OR visibility <= 0.1 OR absorption >= 0.9 OR sigma_j <= 1e-6 OR coherence >= 0.99 AS unidentifiable FROM flags")
def a36_identifiability_flag(spark, sf):
    return st.identifiable(flags(spark, sf)).select("key", "unidentifiable")


@query(with_(FLAGS) + "SELECT key, concat_ws(',', CASE WHEN sigma_j < 0.95 * 5 THEN 'sigma_fell' END, CASE WHEN coherence > 0.99 THEN 'coherent' END, CASE WHEN visibility / 4 > 0.25 THEN 'correction_too_large' END, CASE WHEN abs(absorption * 2 - 1) > 0.5 THEN 'outside_box' END, CASE WHEN weak AND absorption > 0.5 THEN 'fit_worse' END) AS reasons FROM flags")
def m10_refinement_gate(spark, sf):
    own = flags(spark, sf).withColumns({"sigma_j0": F.lit(5.0), "largest": F.col("visibility") / 4, "psi": F.col("absorption") * 2 - 1, "needs_fit": F.col("weak"), "data": F.col("absorption"), "data0": F.lit(0.5)})
    return st.gate(own, box=0.5).select("key", "reasons")


@query()
def m10_refinement_search(spark, sf):
    """Each nation's best (p0, p1) against its customers' mean balance, by rounds of candidates."""
    goals = base(spark, sf, "customer").groupBy((F.col("c_nationkey") % 5).cast("long").alias("key")).agg((F.avg("c_acctbal") / 10000).alias("goal"))
    start = goals.select("key", F.lit(0.0).alias("p0"), F.lit(0.0).alias("p1"))
    score = lambda df: df.join(F.broadcast(goals), "key").withColumn("value", (F.col("p0") - F.col("goal")) ** 2 + (F.col("p1") + F.col("goal")) ** 2).drop("goal")
    return st.refine(start, score, step=0.2, rounds=12, floor=0.01)


@query(with_(BASE) + f"SELECT station_id AS key, {s6('sum(dx * dx + dy * dy)')} AS energy, {s6('coalesce(sum(s), 0.0)')} AS smoothness, {s6('max(greatest(abs(dx), abs(dy)))')} AS largest FROM (SELECT station_id, ux AS dx, vy AS dy, power(ux - lag(ux) OVER w, 2) + power(vy - lag(vy) OVER w, 2) AS s FROM panel WHERE ok WINDOW w AS (PARTITION BY station_id ORDER BY t_idx)) GROUP BY 1")
def a40_correction_penalties(spark, sf):
    own = panel(spark, sf).where("vector_valid").select(F.col("station_id").alias("key"), "t_idx", F.col("ux").alias("dx"), F.col("vy").alias("dy"))
    return st.penalties(own).select("key", *[r6(F.col(c)).alias(c) for c in ("energy", "smoothness", "largest")])


@query("WITH c AS (SELECT l_linenumber % 3 AS factor, (l_partkey % 3)::BIGINT AS grp, avg(l_discount) AS corr FROM lineitem GROUP BY 1, 2), p AS (SELECT a.grp AS a, b.grp AS b, d.grp AS d, a.corr + b.corr + d.corr AS total FROM c a, c b, c d WHERE a.factor = 0 AND b.factor = 1 AND d.factor = 2 AND a.grp <> b.grp AND a.grp <> d.grp AND b.grp <> d.grp ORDER BY total DESC LIMIT 1) SELECT 0::BIGINT AS factor, a AS grp FROM p UNION ALL SELECT 1, b FROM p UNION ALL SELECT 2, d FROM p")
def j13_factor_assignment(spark, sf):
    own = base(spark, sf, "lineitem").groupBy((F.col("l_linenumber") % 3).cast("long").alias("factor"), (F.col("l_partkey") % 3).alias("grp")).agg(F.avg("l_discount").alias("corr"))
    return st.best_assignment(own)


@query()
def m5_nonnegative_factors(spark, sf):
    matrix = base(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 48).alias("t_idx"), (F.col("l_partkey") % 8).alias("sensor_idx")).agg(F.avg("l_quantity").alias("v"))
    times, sensors, shares = st.nonnegative_factors(matrix, 2)
    return shares.join(st.reconstruction_error(matrix, times, sensors))


@query(with_(BASE, GRID_STATIONS) + f", f AS (SELECT min(t_idx) AS t FROM (SELECT t_idx FROM panel WHERE pm25 IS NOT NULL GROUP BY t_idx HAVING count(*) >= 3)), c AS (SELECT i AS ix, j AS iy FROM range(8) a(i), range(8) b(j)), w AS (SELECT ix, iy, greatest(exp(-0.5 * ((ix - x) * (ix - x) + (iy - y) * (iy - y)) / 4.0), 1e-12) AS w, pm25 FROM panel JOIN f ON t_idx = t JOIN placed USING (station_id) CROSS JOIN c WHERE pm25 IS NOT NULL) SELECT ix, iy, {s6('greatest(0.0, sum(w * pm25) / sum(w))')} AS mass FROM w GROUP BY 1, 2")
def j14_initial_baseline(spark, sf):
    seen = panel(spark, sf).where("pm25_valid").select("t_idx", "station_id", F.col("pm25").alias("v"))
    sites = placed(spark, sf).select("station_id", "sx", "sy")
    return st.initial_baseline(seen, sites, sp.cells(spark, 8, 8), 2.0).withColumn("mass", r6(F.col("mass")))


def study(spark, sf):
    rows = design(spark, sf).withColumns({"one": F.lit(1.0), "y": F.when(F.col("row_id") % 7 != 0, F.col("y"))})
    return st.observed_study(rows, "window_id", ["one"], ["h1", "h2", "h4"], "y")


@query(with_(DESIGN) + "SELECT window_id, count(*) AS n_total, count(*) FILTER (row_id % 7 <> 0) AS n_observed, CASE WHEN count(*) FILTER (row_id % 7 <> 0) < 4 THEN 'insufficient_observed_rows' ELSE 'uncalibrated' END AS status FROM design GROUP BY 1")
def m11_study_status(spark, sf):
    return study(spark, sf)[0].select("window_id", "n_total", "n_observed", "status")


@query()
def m11_observed_study(spark, sf):
    summary, fitted, *_ = study(spark, sf)
    return summary.join(fitted, "window_id").select("window_id", "status", "sigma_j", "rank", "name", "c", "std", "residual_norm")


@query(with_(DESIGN, GRAM, COH) + f"SELECT window_id, i, j, {s6('coherence')} AS coherence FROM coh WHERE coherence IS NOT NULL")
def m12_pair_report(spark, sf):
    return pairs(spark, sf).where("coherence is not null").select("window_id", "i", "j", out.rounded(F.col("coherence") + 1e-9).alias("coherence"))


@query(with_(DESIGN) + f"SELECT window_id, {s6('sum(h1) / sum(h1 + h2 + h3)')} AS h1, {s6('sum(h2) / sum(h1 + h2 + h3)')} AS h2, {s6('sum(h3) / sum(h1 + h2 + h3)')} AS h3 FROM design GROUP BY 1")
def m12_t4_apportionment(spark, sf):
    own = design(spark, sf).groupBy("window_id").agg(*[F.sum(c).alias(c) for c in ("h1", "h2", "h3")])
    total = F.col("h1") + F.col("h2") + F.col("h3")
    shares = own.select("window_id", F.explode(F.array(*[F.struct(F.lit(c).alias("grp"), r6(F.col(c) / total).alias("share")) for c in ("h1", "h2", "h3")])).alias("x")).select("window_id", "x.*")
    return out.apportionment(shares, ["h1", "h2", "h3"])


@query("SELECT o_orderpriority AS experiment, count(*) AS n, string_agg(r, '+' ORDER BY r) AS runs FROM (SELECT o_orderpriority, o_orderstatus AS r FROM orders GROUP BY 1, 2) GROUP BY 1")
def m12_run_index(spark, sf):
    runs = base(spark, sf, "orders").select(F.col("o_orderpriority").alias("experiment"), F.col("o_orderstatus").alias("run")).distinct()
    return out.run_index(runs).select("experiment", "n", F.concat_ws("+", "runs").alias("runs"))


@query()
def m14_method_comparison(spark, sf):
    truth = spark.createDataFrame([("h1", 0.5), ("h2", 0.3)], "name string, c double")
    return st.compare_methods(factors(spark, sf), "window_id", 1, ["h1", "h2"], truth, 1e-3)


@query("SELECT event_id, unnest(json_keys(props)) AS name, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events")
def f13_flattened_json(spark, sf):
    return out.flattened(base(spark, sf, "events"), "event_id", "props")


@query("SELECT event_id, round(CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END, 6) AS value FROM events")
def f14_rounded(spark, sf):
    return base(spark, sf, "events").select("event_id", out.rounded(F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value"))).alias("value"))


HASH = ", ".join(f"CAST(sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) AS VARCHAR)" for i in range(8))


@query(f"SELECT sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {HASH})) AS sha256 FROM (SELECT sha256(concat_ws('|', n_nationkey::VARCHAR, n_name)) AS h FROM nation)")
def f15_content_hash(spark, sf):
    return out.content_hash(base(spark, sf, "nation"), "n_nationkey", "n_name")


@query("SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'unsupported' ELSE CAST(CAST(c_nationkey AS DOUBLE) AS VARCHAR) END AS cell FROM customer")
def f17_share_cells(spark, sf):
    admissible = F.when(F.col("c_nationkey") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array("c_nationkey"))
    return base(spark, sf, "customer").select("c_custkey", out.share_cell(admissible, F.col("c_nationkey").cast("double")).alias("cell"))


@query("SELECT n_nationkey AS id, n_name AS name, NULL::DOUBLE AS balance, 'a' AS run FROM nation UNION ALL SELECT s_nationkey, s_name, s_acctbal, 'b' FROM supplier")
def u1_merged_tables(spark, sf):
    a = base(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    b = base(spark, sf, "supplier").select(F.col("s_nationkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return out.merged([("a", a), ("b", b)]).select("id", "name", "balance", "run")


@query("SELECT o_orderpriority AS note, min(o_orderkey) AS pos FROM orders GROUP BY 1")
def u2_notes_in_order(spark, sf):
    return out.notes_in_order(base(spark, sf, "orders").select(F.col("o_orderpriority").alias("note"), F.col("o_orderkey").alias("pos")))


def scratch(spark):
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        gr.durable(spark.range(1))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


@query("SELECT event_id, user_id, value FROM events")
def c3_raster_round_trip(spark, sf):
    path = scratch(spark)
    base(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("ix"), F.col("user_id").alias("iy"), F.col("value").alias("intensity")).write.parquet(path)
    return tb.read_rasters(spark, path).select(F.col("ix").alias("event_id"), F.col("iy").alias("user_id"), F.col("intensity").alias("value"))


@query(with_(BASE) + f"SELECT station_id, t_idx, {s6('ux')} AS ux FROM panel")
def c4_wind_product(spark, sf):
    path = scratch(spark)
    tb.write_product(panel(spark, sf), path, {"convention": "transport", "hours": "local"})
    return tb.read_product(spark, path)[0].select("station_id", "t_idx", r6(F.col("ux")).alias("ux"))


@query("SELECT o_orderkey AS experiment_row, 'observed_week' AS experiment, 'observed' AS kind FROM orders")
def c6_run_results(spark, sf):
    return run_results(spark, base(spark, sf, "orders"))


def run_results(spark, orders):
    path = scratch(spark)
    orders.select(F.col("o_orderkey").alias("experiment_row"), F.lit("observed_week").alias("experiment")).write.json(f"{path}/week1")
    reader = spark.read.option("recursiveFileLookup", True).schema("experiment_row long, experiment string").json(path)
    return reader.withColumn("kind", F.when(F.col("experiment").startswith("observed"), "observed").otherwise("controlled")).select("experiment_row", "experiment", "kind")


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def c7_report_files(spark, sf):
    path = scratch(spark)
    tb.write_report(base(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), path)
    return spark.read.schema("s_suppkey long, s_acctbal double").json(f"{path}/json")


@query("SELECT s_suppkey, 'exp01' AS experiment, 3 AS seed FROM supplier")
def c8_run_partitions(spark, sf):
    path = scratch(spark)
    tb.write_run(base(spark, sf, "supplier").select("s_suppkey"), path, "exp01", 3, {"lag": 12, "dt": 1.0})
    return spark.read.parquet(path).select("s_suppkey", "experiment", "seed")


@query()
def a24_footprint_localization(spark, sf):
    prints = rs.footprints(rs.cell_response(kernel(spark, sf)[0], basis(spark, sf)), small(spark, sf), coefficients(spark))
    return rs.localization(prints, spark.createDataFrame([(2.0, 2.0), (7.0, 7.0)], "sx double, sy double"), 2.5)


@query("SELECT s AS source_idx, b AS basis_idx, s * 3 + b AS col_idx FROM range(4) t(s), range(3) u(b) WHERE NOT (b = 0 OR s = 0 AND b < 2 OR s > 1 AND b = 2)")
def f11_admissible_columns(spark, sf):
    from ..functions.bases import fixed_zeros

    pairs_ = base(spark, sf, "lineitem").select((F.col("l_linenumber") % 4).cast("long").alias("source_idx"), (F.col("l_suppkey") % 3).alias("basis_idx")).distinct()
    zeros = fixed_zeros(pairs_, (F.col("basis_idx") == 0) | ((F.col("source_idx") == 0) & (F.col("basis_idx") < 2)) | ((F.col("source_idx") > 1) & (F.col("basis_idx") == 2)), 3)
    return pairs_.withColumn("col_idx", F.col("source_idx") * 3 + F.col("basis_idx")).join(zeros, "col_idx", "left_anti").select("source_idx", "basis_idx", "col_idx")


@query()
def a32_kernel_mass(spark, sf):
    """Retained share of each hour's kernel mass over the sensors' cells, opt-in."""
    return kernel(spark, sf)[0].groupBy("tau").agg(F.sum("g").alias("mass"), F.count_if(F.col("g") > 1).alias("clipped"), F.max("g").alias("largest"))

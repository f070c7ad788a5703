"""Queries of factorization, diagnostics, fits, groups and attribution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import factor as fa
from ..operators import fit as fi
from ..operators import groups as gr
from ..operators.bounded import spread
from .registry import DESIGN, RESPONSE, base, coefficients, design, query, r6, response, s6, with_

HS = ["h1", "h2", "h3", "h4"]


def s4(sql: str) -> str:
    return f"(CASE WHEN round(({sql}) + 1e-8, 4) = 0 THEN 0.0 ELSE round(({sql}) + 1e-8, 4) END)"


def r4(c):
    out = F.round(c + 1e-8, 4)
    return F.when(out == 0, F.lit(0.0)).otherwise(out)


def columns(spark):
    return spark.createDataFrame([(0, 0, "h1"), (1, 0, "h2"), (2, 1, "h3"), (3, 1, "h4")], "col_idx int, source_idx long, name string")


PAIRS = ", ".join(f"({i}, {j}, h{i + 1} * h{j + 1})" for i in range(4) for j in range(i, 4))
GRAM = "gram AS (SELECT window_id, i, j, sum(v) AS g FROM (" + " UNION ALL ".join(f"SELECT window_id, {i} AS i, {j} AS j, h{i + 1} * h{j + 1} AS v FROM design" for i in range(4) for j in range(i, 4)) + ") GROUP BY 1, 2, 3)"
COH = "coh AS (SELECT g.window_id, g.i, g.j, CASE WHEN a.g > 0 AND b.g > 0 THEN least(1.0, abs(g.g) / (sqrt(a.g) * sqrt(b.g))) END AS coherence FROM gram g JOIN gram a ON a.window_id = g.window_id AND a.i = g.i AND a.j = g.i JOIN gram b ON b.window_id = g.window_id AND b.i = g.j AND b.j = g.j WHERE g.i < g.j)"
DEM = "dem AS (SELECT window_id, row_id, h1 - avg(h1) OVER w AS h1, h2 - avg(h2) OVER w AS h2, h4 - avg(h4) OVER w AS h4, y - avg(y) OVER w AS y FROM design WINDOW w AS (PARTITION BY window_id))"
TWO = "two AS (SELECT window_id, sum(h1 * h1) AS a, sum(h1 * h2) AS b, sum(h2 * h2) AS d, sum(h1 * y) AS p, sum(h2 * y) AS q, sum(y * y) AS yy, count(*) AS n FROM {} GROUP BY 1)"


@query(with_(DESIGN, GRAM) + f"SELECT window_id, i, j, {s4('g')} AS g FROM gram")
def a10_gram(spark, sf):
    return fa.gram(design(spark, sf), "window_id", HS).select("window_id", "i", "j", r4(F.col("g")).alias("g"))


def pairs(spark, sf, limit=0.8):
    return fa.coherence(fa.gram(design(spark, sf), "window_id", HS), "window_id", 0.0, limit)


@query(with_(DESIGN, GRAM, COH) + f"SELECT window_id, i, j, {s6('coherence')} AS coherence, {s6('sqrt(1 - coherence * coherence)')} AS ray_distance, coalesce(coherence > 0.8, false) AS ambiguous FROM coh")
def a12_coherence(spark, sf):
    return pairs(spark, sf).select("window_id", "i", "j", r6(F.col("coherence")).alias("coherence"), r6(F.col("ray_distance")).alias("ray_distance"), "ambiguous")


@query(with_(DESIGN, GRAM) + ", w AS (SELECT window_id, CASE WHEN i < 2 THEN 0::BIGINT ELSE 1 END AS source, sqrt(g) <= 60.0 AS weak, 'h' || (i + 1) AS name FROM gram WHERE i = j) SELECT window_id, source, coalesce(string_agg(name, '+' ORDER BY name) FILTER (weak), '') AS weak, bool_and(weak) AS all_weak FROM w GROUP BY 1, 2")
def a11_weak_columns(spark, sf):
    sources = columns(spark).select(F.col("col_idx").alias("i"), F.col("source_idx").alias("source"), "name")
    return fa.weak_columns(fa.gram(design(spark, sf), "window_id", HS), "window_id", 60.0, sources).withColumn("weak", F.concat_ws("+", "weak"))


@query(with_(DESIGN) + ", m AS (SELECT window_id, " + ", ".join(f"sqrt(sum(power({h} - m_{h}, 2))) / sqrt(sum({h} * {h})) AS v_{h}, sqrt(count(*) * max(m_{h}) * max(m_{h})) / sqrt(sum({h} * {h})) AS r_{h}" for h in HS[:2]) + " FROM (SELECT *, avg(h1) OVER (PARTITION BY window_id) AS m_h1, avg(h2) OVER (PARTITION BY window_id) AS m_h2 FROM design) GROUP BY 1) "
  + " UNION ALL ".join(f"SELECT window_id, '{h}' AS name, {s6('r_' + h)} AS absorbed, {s6('v_' + h)} AS visible FROM m" for h in HS[:2]))
def a13_background_absorption(spark, sf):
    own = fa.project(design(spark, sf).withColumn("one", F.lit(1.0)), "window_id", ["one"], ["h1", "h2"])
    return fa.absorption(own, "window_id", ["h1", "h2"]).select("window_id", "name", r6(F.col("absorbed")).alias("absorbed"), r6(F.col("visible")).alias("visible"))


@query(with_(DESIGN, DEM) + f"SELECT window_id, row_id, {s6('h1')} AS h1, {s6('y')} AS y FROM dem")
def m2_background_projection(spark, sf):
    own = fa.project(design(spark, sf).withColumn("one", F.lit(1.0)), "window_id", ["one"], ["h1", "y"])
    return own.select("window_id", "row_id", r6(F.col("h1_t")).alias("h1"), r6(F.col("y_t")).alias("y"))


@query(with_(DESIGN, TWO.format("design")) + f", s AS (SELECT window_id, n, sqrt(((a + d) + sqrt((a - d) * (a - d) + 4 * b * b)) / 2) AS s1, sqrt((a * d - b * b) / (((a + d) + sqrt((a - d) * (a - d) + 4 * b * b)) / 2)) AS s2 FROM two) SELECT window_id, n AS n_rows, {s4('s1')} AS s1, {s4('s2')} AS s2, 2 AS rank, {s4('s1 / s2')} AS condition FROM s")
def a14_singular_spectrum(spark, sf):
    d = fa.diagnostics(fa.factor(design(spark, sf), "window_id", ["h1", "h2", "y"]), "window_id", 0, 2)
    return d.select("window_id", "n_rows", r4(F.col("spectrum")[0]).alias("s1"), r4(F.col("sigma_j")).alias("s2"), "rank", r4(F.col("condition")).alias("condition"))


@query()
def m1_window_factors(spark, sf):
    return fa.factor(design(spark, sf).withColumn("one", F.lit(1.0)), "window_id", ["one", *HS, "y"])


@query()
def a15_per_sensor_identifiability(spark, sf):
    own = design(spark, sf).withColumn("sensor_idx", F.pmod("row_id", F.lit(8)))
    each = fa.diagnostics(fa.factor(own, "sensor_idx", [*HS, "y"]), "sensor_idx", 0, 4)
    pooled = fa.diagnostics(fa.factor(own.withColumn("all_rows", F.lit(0)), "all_rows", [*HS, "y"]), "all_rows", 0, 4).select(F.col("sigma_j").alias("pooled_sigma"), F.col("rank").alias("pooled_rank"))
    return each.join(F.broadcast(pooled)).select("sensor_idx", "n_rows", "sigma_j", "rank", ((F.col("sigma_j") <= F.col("pooled_sigma") + 1e-9) & (F.col("rank") <= F.col("pooled_rank"))).alias("within_pooled"))


@query("SELECT i::BIGINT AS col_idx, CASE WHEN i IN (1, 4) THEN -1 WHEN i < 1 THEN i WHEN i < 4 THEN i - 1 ELSE i - 2 END::BIGINT AS reduced_idx FROM range(7) r(i)")
def p7_fixed_zero_columns(spark, sf):
    """The columns are the line numbers from 0."""
    return fa.fixed_zero_map(base(spark, sf, "lineitem").select((F.col("l_linenumber") - 1).cast("long").alias("col_idx")).distinct(), spark.createDataFrame([(1,), (4,)], "col_idx long"))


@query(with_(DESIGN, GRAM, COH) + f"SELECT window_id, {s6('max(coherence)')} AS coherence, arg_max(i, coherence) AS i, arg_max(j, coherence) AS j, arg_min(i, sqrt(1 - coherence * coherence)) AS near_i, arg_min(j, sqrt(1 - coherence * coherence)) AS near_j FROM coh GROUP BY 1")
def t2_t8_strongest_pair(spark, sf):
    return fa.strongest(pairs(spark, sf), "window_id").withColumn("coherence", r6(F.col("coherence")))


@query("WITH p AS (SELECT DISTINCT l_orderkey % 48 AS t_idx, l_partkey % 4 AS sensor_idx FROM lineitem), s AS (SELECT avg(t_idx) AS m, stddev_pop(t_idx) AS s FROM p) "
  f"SELECT t_idx, sensor_idx, name, {s6('q')} AS q FROM (SELECT t_idx, sensor_idx, 'constant' AS name, 1.0::DOUBLE AS q FROM p UNION ALL SELECT t_idx, sensor_idx, 'time_1', (t_idx - m) / s FROM p, s UNION ALL SELECT t_idx, sensor_idx, 'sin_1', sin(2 * pi() * (t_idx % 24) / 24.0) FROM p UNION ALL SELECT t_idx, sensor_idx, 'cos_1', cos(2 * pi() * (t_idx % 24) / 24.0) FROM p "
  "UNION ALL SELECT t_idx, sensor_idx, 'sensor_' || (sensor_idx + 1), 1.0 FROM p WHERE sensor_idx > 0 UNION ALL SELECT t_idx, sensor_idx, 'day_2', 1.0 FROM p WHERE t_idx >= 24)")
def f9_w9_background_basis(spark, sf):
    return fa.background(_panel(spark, sf), 1, 1, True, True).withColumn("q", r6(F.col("q")))


def _panel(spark, sf):
    own = base(spark, sf, "lineitem").select((F.col("l_orderkey") % 48).alias("t_idx"), (F.col("l_partkey") % 4).alias("sensor_idx")).distinct()
    return own.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(t_idx as int), 0, 0)"))


@query(with_(RESPONSE) + ", p AS (SELECT DISTINCT t_idx, sensor_idx FROM response), f AS (SELECT t_idx, sensor_idx, h FROM response WHERE source_idx = 0 AND basis_idx = 0), n AS (SELECT sqrt(sum(h * h)) AS n FROM f) "
  f"SELECT variant, name, count(*) AS n, {s6('sum(q * q)')} AS q2 FROM (SELECT v.variant, 'constant' AS name, 1.0 AS q FROM p, (SELECT unnest(['primary', 'redundant', 'stress']) AS variant) v UNION ALL SELECT 'redundant', 'constant_copy', 1.0 FROM p UNION ALL SELECT 'stress', 'stress', h / n FROM f, n) GROUP BY 1, 2")
def f19_background_variants(spark, sf):
    first = response(spark, sf).where("source_idx = 0 and basis_idx = 0")
    return fa.variants(fa.background(_panel(spark, sf), 0, 0), first).groupBy("variant", "name").agg(F.count("*").alias("n"), r6(F.sum(F.col("q") * F.col("q"))).alias("q2"))


@query("WITH p AS (SELECT DISTINCT l_orderkey % 48 AS t_idx, l_partkey % 4 AS sensor_idx FROM lineitem) SELECT name, count(*) AS n FROM (SELECT 'constant' AS name FROM p UNION ALL SELECT 'parity' FROM p) GROUP BY 1")
def x3_user_background(spark, sf):
    panel = _panel(spark, sf)
    user = panel.select("t_idx", "sensor_idx", F.lit("parity").alias("name"), (F.col("t_idx") % 2).cast("double").alias("q"))
    return fa.with_user_columns(fa.background(panel, 0, 0), user).groupBy("name").agg(F.count("*").alias("n"))


# Nonnegative fits of two columns: the four active sets in closed form.
NNLS = """sets AS (SELECT window_id, (p * d - q * b) / (a * d - b * b) AS c1, (q * a - p * b) / (a * d - b * b) AS c2, a, b, d, p, q FROM two UNION ALL SELECT window_id, p / a, 0.0, a, b, d, p, q FROM two UNION ALL SELECT window_id, 0.0, q / d, a, b, d, p, q FROM two UNION ALL SELECT window_id, 0.0, 0.0, a, b, d, p, q FROM two),
  best AS (SELECT window_id, c1, c2, row_number() OVER (PARTITION BY window_id ORDER BY a * c1 * c1 + 2 * b * c1 * c2 + d * c2 * c2 - 2 * p * c1 - 2 * q * c2) AS r FROM sets WHERE c1 >= 0 AND c2 >= 0)"""


@query(with_(DESIGN, DEM, TWO.format("dem"), NNLS) + f"SELECT window_id, 'h1' AS name, {s4('c1')} AS c FROM best WHERE r = 1 UNION ALL SELECT window_id, 'h2', {s4('c2')} FROM best WHERE r = 1")
def m3_nonnegative_fit(spark, sf):
    own = fa.factor(design(spark, sf).withColumn("one", F.lit(1.0)), "window_id", ["one", "h1", "h2", "y"])
    return fi.fit(own, "window_id", 1, ["h1", "h2"]).select("window_id", "name", r4(F.col("c")).alias("c"))


@query(with_(DESIGN, TWO.format("design"), NNLS) + f"SELECT window_id, 'raw' AS method, {s4('c1')} AS c1, {s4('c2')} AS c2 FROM best WHERE r = 1")
def m4_raw_fit(spark, sf):
    own = fa.factor(design(spark, sf), "window_id", ["h1", "h2", "y"])
    out = fi.fit(own, "window_id", 0, ["h1", "h2"], raw=True).groupBy("window_id").pivot("name", ["h1", "h2"]).agg(F.first("c"))
    return out.select("window_id", F.lit("raw").alias("method"), r4(F.col("h1")).alias("c1"), r4(F.col("h2")).alias("c2"))


RES = "res AS (SELECT window_id, row_id, row_id // 10 AS t_idx, row_id % 10 AS sensor_idx, 0.4 * avg(h1) + 0.2 * avg(h2) - avg(y) AS r FROM design GROUP BY window_id, row_id)"


def rows_once(spark, sf, *place):
    """Rows of the design, repeated ones averaged; ``place`` tells a window's rows apart, and its first column's rows stay in one partition."""
    own = design(spark, sf).withColumns({"t_idx": F.floor(F.col("row_id") / 10), "sensor_idx": F.col("row_id") % 10}).select("window_id", *place, "h1", "h2", "y")
    return spread(own, "window_id", place[0]).groupBy("window_id", *place).agg(*[F.avg(c).alias(c) for c in ("h1", "h2", "y")])


def residuals(spark, sf):
    return rows_once(spark, sf, "t_idx", "sensor_idx").select("window_id", "t_idx", "sensor_idx", (0.4 * F.col("h1") + 0.2 * F.col("h2") - F.col("y")).alias("r"))


@query(with_(DESIGN, RES) + f"SELECT window_id, sensor_idx, {s6('sqrt(avg(r * r))')} AS rms, count(*) AS n FROM res GROUP BY 1, 2")
def a25_residual_summary(spark, sf):
    return fi.residual_summary(residuals(spark, sf), "window_id", "sensor_idx").withColumn("rms", r6(F.col("rms")))


@query(with_(DESIGN, RES) + f", n AS (SELECT *, lead(r) OVER (PARTITION BY window_id ORDER BY t_idx, sensor_idx) AS nx FROM res) SELECT window_id, {s6('coalesce(sum(r * nx) / nullif(sum(r * r), 0), 0.0)')} AS lag1 FROM n GROUP BY 1")
def w2_residual_autocorrelation(spark, sf):
    return fi.autocorrelation(residuals(spark, sf), "window_id").withColumn("lag1", r6(F.col("lag1")))


@query(with_(DESIGN, RES) + f"SELECT window_id, {s4('sum(r * r)')} AS data, 0.1::DOUBLE AS penalty, {s4('sum(r * r) + 0.1')} AS total FROM res GROUP BY 1")
def a26_objective(spark, sf):
    own = rows_once(spark, sf, "row_id").select("window_id", "row_id", "y", F.explode(F.create_map(F.lit("h1"), F.col("h1"), F.lit("h2"), F.col("h2"))).alias("name", "h"))
    c = design(spark, sf).select("window_id").distinct().join(spark.createDataFrame([("h1", 0.4), ("h2", 0.2)], "name string, c double"))
    return fi.objective(own, "window_id", c, 0.5, 0.0).select("window_id", *[r4(F.col(x)).alias(x) for x in ("data", "penalty", "total")])


@query(with_(DESIGN) + f"SELECT window_id, {s6('quantile_cont(h1 / (1 + h3), 0.05)')} AS q05, {s6('quantile_cont(h1 / (1 + h3), 0.5)')} AS q50, {s6('quantile_cont(h1 / (1 + h3), 0.95)')} AS q95, count(*) AS n FROM design GROUP BY 1")
def a29_transport_intervals(spark, sf):
    members = design(spark, sf).withColumn("c", F.col("h1") / (1 + F.col("h3")))
    return fi.ensemble_intervals(members, "window_id").select("window_id", *[r6(F.col(x)).alias(x) for x in ("q05", "q50", "q95")], "n")


@query(with_(DESIGN) + f"SELECT window_id AS scenario, {s6('avg(h1)')} AS a, {s6('avg(h2)')} AS b FROM design GROUP BY 1")
def a30_u3_inventory_scenarios(spark, sf):
    means = design(spark, sf).groupBy("window_id").agg(F.avg("h1").alias("a"), F.avg("h2").alias("b"))
    part = lambda n: means.select(F.col("window_id").alias("scenario"), F.lit(n).alias("name"), F.col(n).alias("c"), F.lit("inventory").alias("ensemble_kind"))
    return fi.scenario_rows(part("a").unionByName(part("b"))).select("scenario", r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"))


@query(with_(DESIGN, TWO.format("design")) + f", f AS (SELECT *, (p * d - q * b) / (a * d - b * b) AS c1, (q * a - p * b) / (a * d - b * b) AS c2 FROM two), v AS (SELECT *, (a * c1 * c1 + 2 * b * c1 * c2 + d * c2 * c2 - 2 * p * c1 - 2 * q * c2 + yy) / (n - 2) AS s2 FROM f WHERE c1 > 0 AND c2 > 0) SELECT window_id, {s4('sqrt(s2 * d / (a * d - b * b))')} AS std1, {s4('sqrt(s2 * a / (a * d - b * b))')} AS std2 FROM v")
def a39_coefficient_deviation(spark, sf):
    out = fi.fit(fa.factor(design(spark, sf), "window_id", ["h1", "h2", "y"]), "window_id", 0, ["h1", "h2"])
    return out.groupBy("window_id").pivot("name", ["h1", "h2"]).agg(F.first(F.struct("c", "std"))).where("h1.c > 0 and h2.c > 0").select("window_id", r4(F.col("h1.std")).alias("std1"), r4(F.col("h2.std")).alias("std2"))


@query(with_(DESIGN) + f", e AS (SELECT window_id, avg(h1) / 100 AS a, avg(h2) / 10 AS b FROM design GROUP BY 1) SELECT window_id, {s6('sqrt(power(a - 0.3, 2) + power(b - 0.7, 2)) / sqrt(0.58)')} AS coefficient_error, {s6('abs(a + b - 1.0) / 1.0')} AS total_error, {s6('sqrt(power(a / (a + b) - 0.3, 2) + power(b / (a + b) - 0.7, 2))')} AS share_error FROM e")
def a35_recovery_scores(spark, sf):
    means = design(spark, sf).groupBy("window_id").agg((F.avg("h1") / 100).alias("a"), (F.avg("h2") / 10).alias("b"))
    est = means.select("window_id", F.explode(F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b"))).alias("name", "c"))
    out = fi.recovery(est, spark.createDataFrame([("a", 0.3), ("b", 0.7)], "name string, c double"), "window_id")
    return out.select("window_id", *[r6(F.col(x)).alias(x) for x in ("coefficient_error", "total_error", "share_error")])


# Ambiguity graph of embedding labels: centroids of three windows, edges above a cosine cut.
CENTROIDS = """parts AS (SELECT vec_id % 3 AS window_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), cen AS (SELECT window_id, label, d, avg(x::DOUBLE) AS x FROM parts GROUP BY 1, 2, 3),
  cosine AS (SELECT a.window_id, a.label AS i, b.label AS j, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) AS coherence FROM cen a JOIN cen b ON a.window_id = b.window_id AND a.d = b.d AND a.label < b.label GROUP BY 1, 2, 3)"""


def cosine(spark, sf):
    cen = base(spark, sf, "embeddings").select((F.col("vec_id") % 3).alias("window_id"), "label", F.posexplode("embedding").alias("d", "x")).groupBy("window_id", "label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    left, right = cen.select("window_id", F.col("label").alias("i"), "d", F.col("x").alias("xi")), cen.select("window_id", F.col("label").alias("j"), "d", F.col("x").alias("xj"))
    both = left.join(right, ["window_id", "d"]).where("i < j").groupBy("window_id", "i", "j")
    return both.agg((F.sum(F.col("xi") * F.col("xj")) / F.sqrt(F.sum(F.col("xi") ** 2) * F.sum(F.col("xj") ** 2))).alias("coherence")).withColumn("ray_distance", F.sqrt(1 - F.least(F.lit(1.0), F.abs("coherence")) ** 2))


def edges(spark, sf):
    labels = base(spark, sf, "embeddings").select(F.col("label").alias("col_idx"), F.floor(F.col("label") / 2).alias("source_idx")).distinct()
    return gr.source_edges(cosine(spark, sf), labels, "window_id", 0.1)


EDGES = "edges AS (SELECT window_id, least(i // 2, j // 2)::BIGINT AS a, greatest(i // 2, j // 2)::BIGINT AS b, max(coherence) AS coherence, min(sqrt(1 - least(1.0, abs(coherence)) * least(1.0, abs(coherence)))) AS ray_distance FROM cosine WHERE coherence > 0.1 AND i // 2 <> j // 2 GROUP BY 1, 2, 3)"


@query(with_(CENTROIDS, EDGES) + f"SELECT window_id, a, b, {s6('coherence')} AS coherence, {s6('ray_distance')} AS ray_distance FROM edges")
def w11_source_edges(spark, sf):
    return edges(spark, sf).select("window_id", "a", "b", r6(F.col("coherence")).alias("coherence"), r6(F.col("ray_distance")).alias("ray_distance"))


def component_rows(spark, sf):
    nodes = base(spark, sf, "embeddings").select((F.col("vec_id") % 3).alias("window_id"), F.floor(F.col("label") / 2).alias("node")).distinct()
    return gr.components(nodes, edges(spark, sf), "window_id")


REACH = ", nodes AS (SELECT DISTINCT vec_id % 3 AS window_id, (label // 2)::BIGINT AS node FROM embeddings), both_ways AS (SELECT window_id, a, b FROM edges UNION SELECT window_id, b, a FROM edges), reach(window_id, node, other) AS (SELECT window_id, node, node FROM nodes UNION SELECT r.window_id, r.node, e.b FROM reach r JOIN both_ways e ON e.window_id = r.window_id AND e.a = r.other), comp AS (SELECT window_id, node, min(other) AS component FROM reach GROUP BY 1, 2)"


@query(with_(CENTROIDS, EDGES).replace("WITH ", "WITH RECURSIVE ").rstrip() + REACH + " SELECT window_id, node, component FROM comp")
def m6_components(spark, sf):
    return component_rows(spark, sf)


@query(with_(CENTROIDS, EDGES).replace("WITH ", "WITH RECURSIVE ").rstrip() + REACH + " SELECT window_id, component, string_agg('s' || node, '+' ORDER BY node) AS \"group\" FROM comp GROUP BY 1, 2")
def f16_group_keys(spark, sf):
    names = base(spark, sf, "embeddings").select(F.floor(F.col("label") / 2).alias("source_idx")).distinct().withColumn("source_name", F.concat(F.lit("s"), F.col("source_idx").cast("string")))
    return gr.group_names(component_rows(spark, sf), names, "window_id")


@query(with_(CENTROIDS, EDGES).replace("WITH ", "WITH RECURSIVE ").rstrip() + REACH + ", v AS (SELECT vec_id % 3 AS window_id, (label // 2)::BIGINT AS node, count(*)::DOUBLE AS v FROM embeddings GROUP BY 1, 2) SELECT window_id, component, sum(v) AS v FROM v JOIN comp USING (window_id, node) GROUP BY 1, 2")
def a21_group_sums(spark, sf):
    values = base(spark, sf, "embeddings").groupBy((F.col("vec_id") % 3).alias("window_id"), F.floor(F.col("label") / 2).alias("node")).agg(F.count("*").cast("double").alias("v"))
    return gr.group_sums(values, component_rows(spark, sf), "window_id")


def demeaned_response(spark, sf):
    own = Window.partitionBy("source_idx", "basis_idx")
    return response(spark, sf).withColumn("h_t", F.col("h") - F.avg("h").over(own))


@query(with_(RESPONSE) + f", d AS (SELECT *, h - avg(h) OVER (PARTITION BY source_idx, basis_idx) AS ht FROM response) SELECT sensor_idx, source_idx, {s6('sum(ht * c)')} AS projected, {s6('sum(h * c)')} AS raw FROM d JOIN coefficients USING (source_idx, basis_idx) GROUP BY 1, 2")
def a22_per_sensor_contribution(spark, sf):
    return gr.per_sensor(demeaned_response(spark, sf), coefficients(spark)).select("sensor_idx", "source_idx", r6(F.col("projected")).alias("projected"), r6(F.col("raw")).alias("raw"))


@query(with_(RESPONSE) + f", g AS (SELECT t_idx, sensor_idx, source_idx, sum(h * c) AS s FROM response JOIN coefficients USING (source_idx, basis_idx) GROUP BY 1, 2, 3), l AS (SELECT source_idx, sum(abs(s)) AS l1 FROM g GROUP BY 1) SELECT source_idx, {s6('l1')} AS l1, {s6('l1 / sum(l1) OVER ()')} AS share FROM l")
def a27_signal_shares(spark, sf):
    return gr.signal_shares(response(spark, sf), coefficients(spark)).select("source_idx", r6(F.col("l1")).alias("l1"), r6(F.col("share")).alias("share"))


@query(with_(DESIGN, GRAM, COH, TWO.format("design")) + f", s AS (SELECT window_id, sqrt((a * d - b * b) / (((a + d) + sqrt((a - d) * (a - d) + 4 * b * b)) / 2)) AS s2 FROM two) SELECT {s4('quantile_cont(s2, 0.05)')} AS q05, {s4('quantile_cont(s2, 0.5)')} AS q50, {s4('quantile_cont(s2, 0.95)')} AS q95, 1.0::DOUBLE AS p_full_rank, count(*) AS n FROM s")
def a16_window_ensemble(spark, sf):
    d = fa.diagnostics(fa.factor(design(spark, sf), "window_id", ["h1", "h2", "y"]), "window_id", 0, 2).withColumn("n_columns", F.lit(2))
    return gr.window_ensemble(d, pairs(spark, sf))[0].select(*[r4(F.col(x)).alias(x) for x in ("q05", "q50", "q95")], "p_full_rank", "n")

"""Tiny matrices with known answers, algebraic invariants, contracts with bad inputs."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from airledger.functions import wind as w
from airledger.operators import factor as fa
from airledger.operators import fit as fi
from airledger.operators import groups as gr
from airledger.operators import readings as rd
from airledger.operators.bounded import spread
from airledger.sources import tables as tb


def matrix(spark, rows, names):
    return spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(rows)], "window_id long, row_id long, " + ", ".join(f"{n} double" for n in names))


def test_cardinal_winds(spark):
    df = spark.createDataFrame([(0.0,), (90.0,), (180.0,), (270.0,)], "wd double").select(w.transport_x(F.col("wd"), F.lit(1.0)).alias("x"), w.transport_y(F.col("wd"), F.lit(1.0)).alias("y"), "wd")
    got = [(round(r.x, 9) + 0.0, round(r.y, 9) + 0.0) for r in df.collect()]
    assert got == [(0, -1), (-1, 0), (0, 1), (1, 0)]
    back = df.select(w.direction(F.col("x"), F.col("y")).alias("d"), "wd").collect()
    assert all(abs(r.d - r.wd) < 1e-9 or abs(r.d - r.wd - 360) < 1e-9 for r in back)


def test_duplicate_columns_are_rank_deficient(spark):
    rows = [(1, 1, .2), (.5, .5, .9), (.2, .2, .1), (.7, .7, .3)]
    df = matrix(spark, rows, "abc").withColumn("y", F.lit(1.0))
    d = fa.diagnostics(fa.factor(df, "window_id", ["a", "b", "c", "y"]), "window_id", 0, 3).first()
    assert d["rank"] == 2 and d.sigma_j == 0.0 and d.condition is None
    pair = fa.coherence(fa.gram(df, "window_id", ["a", "b", "c"]), "window_id").where("i = 0 and j = 1").first()
    assert pair.coherence >= 0.999 and pair.ambiguous


def test_weak_column_has_null_pairs(spark):
    df = matrix(spark, [(1, 1e-10, .2), (.5, 0, .9), (.2, 1e-10, .1)], "abc")
    got = {(r.i, r.j): r.coherence for r in fa.coherence(fa.gram(df, "window_id", ["a", "b", "c"]), "window_id", 1e-6).collect()}
    assert got[0, 1] is None and got[1, 2] is None and got[0, 2] is not None


def test_wide_matrix_is_padded(spark):
    df = matrix(spark, [(1, 0, 1, 0), (0, 1, 0, 1)], "abcd").withColumn("y", F.lit(0.0))
    d = fa.diagnostics(fa.factor(df, "window_id", ["a", "b", "c", "d", "y"]), "window_id", 0, 4).first()
    assert len(d.spectrum) == 4 and d.spectrum[-1] < 1e-12 and d["rank"] == 2


def test_well_conditioned_fit(spark):
    a = np.vstack([np.eye(3), 0.1 * np.ones((3, 3))])
    y = a @ np.array([1.5, .7, 0])
    df = matrix(spark, np.column_stack([a, y]), ["a", "b", "c", "y"])
    got = {r.name: r.c for r in fi.fit(fa.factor(df, "window_id", ["a", "b", "c", "y"]), "window_id", 0, ["a", "b", "c"]).collect()}
    assert abs(got["a"] - 1.5) < 1e-4 and abs(got["b"] - .7) < 1e-4 and got["c"] < 1e-4


@pytest.mark.parametrize("seed", range(5))
def test_nonnegative_fit_is_optimal(seed):
    rng = np.random.default_rng(seed)
    a, y = rng.standard_normal((30, 5)), rng.standard_normal(30)
    c, how = fi.nonnegative(a, y, 0.1, np.full(5, 0.2))
    grad = a.T @ (a @ c - y) + 0.1 * (c - 0.2)
    assert how["converged"] and (c >= 0).all() and (grad >= -1e-5).all() and abs(grad[c > 1e-8]).max(initial=0) < 1e-5


def test_projection_is_idempotent_and_matches_lstsq(spark):
    rng = np.random.default_rng(0)
    q, h = rng.standard_normal((40, 3)), rng.standard_normal((40, 2))
    q[:, 2] = q[:, 0] + q[:, 1]  # a dependent background column
    df = matrix(spark, np.column_stack([q, h]), ["q0", "q1", "q2", "h", "y"])
    out = fa.project(df, "window_id", ["q0", "q1", "q2"], ["h", "y"]).orderBy("row_id").toPandas()
    want = h - q @ np.linalg.lstsq(q, h, rcond=None)[0]
    assert np.allclose(out[["h_t", "y_t"]], want, atol=1e-8)
    again = fa.project(spark.createDataFrame(out[["window_id", "row_id", "q0", "q1", "q2", "h_t", "y_t"]]).withColumnsRenamed({"h_t": "h", "y_t": "y"}), "window_id", ["q0", "q1", "q2"], ["h", "y"]).agg(F.max(F.abs("h_r"))).first()[0]
    assert again < 1e-8


def test_factor_over_partitions_is_one_factor(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 3))
    df = matrix(spark, x, "abc")
    r1 = np.array(fa.factor(df.repartition(7), "window_id", ["a", "b", "c"]).first().r).reshape(3, 3)
    assert np.allclose(r1.T @ r1, x.T @ x)


def test_chain_is_one_component(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(6)], "window_id long, node long")
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 4, 5)], "window_id long, a long, b long")
    got = {r.node: r.component for r in gr.components(nodes, edges, "window_id").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="missing columns: b, c"):
        tb.require(spark.createDataFrame([(1,)], "a int"), {"a", "b", "c"})


def test_stations_first_row_wins(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Monitor ID,Latitude,Longitude,Location\nA,1,2,x\nB,3,bad,y\nA,9,9,z\n")
    got = {r.station_id: (r.lon, r.lat) for r in tb.read_stations(spark, str(tmp_path / "s.csv")).collect()}
    assert got == {"A": (2.0, 1.0), "B": (None, 3.0)}


def test_report_refuses_nan(spark, tmp_path):
    with pytest.raises(ValueError):
        tb.write_report(spark.createDataFrame([(float("nan"),)], "v double"), str(tmp_path / "r"))


def test_bad_product_is_found(spark):
    rows = [("A", 1, True, True, True, True, 1.0, 1.0), ("A", 1, True, False, False, True, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "station_id string, ts int, wd_valid boolean, wd_missing boolean, ws_valid boolean, vector_valid boolean, ux double, vy double")
    got = {r.check_name: r.passed for r in rd.product_checks(df).collect()}
    assert not got["unique_keys"] and not got["masks_inverse"] and not got["vector_mask"] and not got["finite"] and got["nonempty"]


def test_mixed_ensembles_are_refused(spark):
    rows = [(0, "a", 1.0, "inventory"), (1, "a", 1.0, "transport")]
    with pytest.raises(ValueError):
        fi.scenario_rows(spark.createDataFrame(rows, "scenario int, name string, c double, ensemble_kind string"))


def test_stream_matches_batch(spark, tmp_path):
    from airledger.streaming.hourly import hourly_stream

    rows = spark.createDataFrame([("A", f"2024-01-01 0{i // 4}:{10 * (i % 4)}:00", float(i)) for i in range(16)], "station_id string, t string, v double").select("station_id", F.to_timestamp("t").alias("ts"), "v")
    rows.write.parquet(str(tmp_path / "in"))
    stream = hourly_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "v")
    stream.writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert sorted(r.v for r in spark.table("hourly").collect()) == [1.5, 5.5, 9.5, 13.5]


def test_adequacy_accepts_the_null_and_rejects_a_missing_source(spark):
    from airledger.operators import adequacy as ad

    rng = np.random.default_rng(3)
    a = np.linalg.qr(rng.standard_normal((48, 4)))[0]
    for amplitude, bad in ((0.0, False), (3.0, True)):
        y = np.abs(a[:, :3] @ np.ones(3)) * 0 + a[:, :3] @ np.ones(3) + amplitude * a[:, 3] + 0.1 * rng.standard_normal(48)
        df = matrix(spark, np.column_stack([a[:, :3], y]), ["a", "b", "c", "y"])
        v = ad.verdicts(ad.replicates(fa.factor(df, "window_id", ["a", "b", "c", "y"]), "window_id", 0, 3, 0.1, 200, 50), "window_id").first()
        assert v.inadequate == bad
    assert ad.replicates(fa.factor(df, "window_id", ["a", "b", "c", "y"]), "window_id", 0, 3, None).count() == 0


def test_activity_levels(spark):
    from airledger.functions import clock

    df = spark.range(48).select(F.col("id").alias("t"), (F.col("id") % 24).cast("double").alias("h"))
    names = ["brick_kilns", "industries", "population_density", "traffic_00", "traffic_06", "traffic_12", "traffic_18", "fires", "traffic_", "traffic_x"]
    rows = df.select("t", *[clock.activity(F.lit(n), F.col("t"), F.col("h")).alias(n) for n in names]).orderBy("t").toPandas()
    assert set(rows.brick_kilns) == {0.25, 0.60} and (rows.brick_kilns[: 12 - clock.phase()] == 0.60).all() and rows.brick_kilns[12 - clock.phase()] == 0.25
    assert (rows.industries[7:20] == 1).all() and abs(rows.industries[6] - 0.5125) < 1e-12 and abs(rows.industries[20] - 0.5125) < 1e-12
    assert rows.population_density[13] == 1 and 0.2 < rows.population_density[3] < 0.22 and rows.population_density.max() <= 1
    assert (rows[["traffic_00", "traffic_06", "traffic_12", "traffic_18"]].sum(axis=1) == 1).all() and all(rows.loc[int(n[-2:]), n] == 1 for n in names[3:7])
    assert (rows[["fires", "traffic_", "traffic_x"]] == 0).all().all()
    with pytest.raises(ValueError):
        clock.activity(F.lit("industries"), F.col("t"), F.col("h"), industry_24h=1.5)


def test_a_broadcast_that_grew_is_refused(spark):
    from airledger.operators.bounded import few

    rows = spark.range(20)
    assert rows.join(few(spark.range(5), 5), "id").count() == 5
    with pytest.raises(Exception, match="more than 5 rows"):
        rows.join(few(spark.range(9), 5), "id").count()


def test_exits_are_those_of_walking_every_cell(spark):
    """First substep outside, cell by cell, against arrays of first exits of columns and rows."""
    from airledger.operators import response as rs

    rng = np.random.default_rng(8)
    city = [(t, *map(float, rng.normal(0, 1.5, 2))) for t in range(12)]
    df = spark.createDataFrame(city, "t_idx long, vx double, vy double")
    cells = spark.createDataFrame([(i, j) for i in range(5) for j in range(7)], "ix long, iy long")
    flying, exits = rs.puffs(cells, df, 4, 5, 7)
    way = {}
    for r in rs.paths(df, 4).collect():
        way.setdefault(r.tau, {})[r.j] = (r.px, r.py)
    out, inside = {}, set()
    for t in range(12):
        for i in range(5):
            for j in range(7):
                left = [k for k, (x, y) in sorted(way.get(t, {}).items()) if not (-0.5 <= i + x <= 4.5 and -0.5 <= j + y <= 6.5)]
                if left:
                    out[i, j, t] = left[0]
                inside |= {(i, j, t, lag) for lag in range(4) if lag == 0 or (lag * 4 in way.get(t, {}) and not (left and left[0] <= lag * 4))}
    assert {(r.ix, r.iy, r.tau): r.exit_j for r in exits.collect()} == out and out
    assert {(r.ix, r.iy, r.tau, r.lag) for r in flying.collect()} == inside
    plan = exits._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastNestedLoopJoin") == 1  # the grid of releases and cells, nothing else


@pytest.mark.parametrize("seed", range(4))
def test_many_fits_are_those_one_by_one(seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((12, 5))
    if seed == 3:
        a[:, 4] = a[:, 0] + a[:, 1]  # a column that depends on others
    y = rng.standard_normal((12, 200))
    c = fi.nonnegative_many(a, y)
    res = ((a @ c - y) ** 2).sum(axis=0)
    grad = a.T @ (a @ c - y)
    assert (c >= 0).all() and (grad > -1e-7).all() and np.abs(grad * (c > 1e-9)).max() < 1e-7
    for j in range(0, 200, 20):
        one, _ = fi.nonnegative(a, y[:, j])
        assert abs(((a @ one - y[:, j]) ** 2).sum() - res[j]) < 1e-5


def test_whitened_rows_give_the_weighted_problem(spark):
    """A unit matrix times s squared is the scalar case; an AR(1) matrix over the hours of each sensor is NumPy's weighted residual."""

    def weighted(rows, cov):
        x = np.array([r[3:] for r in rows])
        sigma = np.array([[cov[p[2], q[2]] if p[1] == q[1] else 0.0 for q in rows] for p in rows])
        w = np.linalg.inv(np.linalg.cholesky(sigma))
        q, _ = np.linalg.qr(w @ x[:, :1])
        left = w @ x[:, 1:] - q @ (q.T @ (w @ x[:, 1:]))
        c, _ = fi.nonnegative(left[:, :2], left[:, 2])
        return ((left[:, :2] @ c - left[:, 2]) ** 2).sum()

    rng = np.random.default_rng(9)
    n_t, n_s = 12, 3
    h, y = rng.random((n_t * n_s, 2)), rng.random(n_t * n_s)
    rows = [(0, k % n_s, k // n_s, 1.0, *map(float, h[k]), float(y[k])) for k in range(n_t * n_s) if k != 7]
    df = spark.createDataFrame(rows, "w long, sensor long, t long, one double, a double, b double, y double").repartition(3)
    for rho in (0.0, 0.7):
        cov = 0.09 * rho ** np.abs(np.subtract.outer(np.arange(n_t), np.arange(n_t))) if rho else 0.09 * np.eye(n_t)
        table = spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(n_t) for j in range(n_t) if cov[i, j]], "i long, j long, v double")
        white = fa.whitened(df, ["w", "sensor"], "t", ["one", "a", "b", "y"], table)
        from airledger.operators import adequacy as ad

        noise = ad.Noise(1.0, True, "test")
        t0 = ad.replicates(fa.factor(white, "w", ["one", "a", "b", "y"]), "w", 1, 2, noise, 10, 5).first().t0
        assert abs(t0 - weighted(rows, cov)) < 1e-6
        if not rho:
            plain = ad.replicates(fa.factor(df, "w", ["one", "a", "b", "y"]), "w", 1, 2, 0.3, 10, 5).first().t0
            assert abs(t0 - plain) < 1e-6
    for refused in (ad.Noise(1.0, False, "test"), ad.Noise(1.0, True, " "), ad.Noise(1.0, True, "test", True)):
        assert ad.replicates(fa.factor(df, "w", ["one", "a", "b", "y"]), "w", 1, 2, refused, 10, 5).count() == 0
    bad = spark.createDataFrame([(i, j, 1.0) for i in range(n_t) for j in range(n_t)], "i long, j long, v double")
    with pytest.raises(Exception, match="positive definite"):
        fa.whitened(df, ["w", "sensor"], "t", ["one", "a", "b", "y"], bad).count()
    with pytest.raises(ValueError, match="symmetric"):
        fa.whitened(df, ["w", "sensor"], "t", ["one"], spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (1, 0, 0.2), (1, 1, 1.0)], "i long, j long, v double"))


def test_many_blocks_are_whitened_as_each_alone(spark):
    """60,000 blocks of one to five places, in batches that cut through blocks; one task a block took minutes."""
    rng, columns = np.random.default_rng(4), ["a", "y"]
    cov = 0.25 * 0.6 ** np.abs(np.subtract.outer(np.arange(5), np.arange(5)))
    table = spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(5) for j in range(5)], "i long, j long, v double")
    value = lambda s: F.pmod(F.xxhash64(F.lit(s), "k", "t"), F.lit(1000)) / 100.0
    rows = spark.range(300_000).select(F.when(F.col("id") >= 5, (F.col("id") / 5).cast("long")).alias("k"), (F.col("id") % 5).alias("t")).where(F.pmod(F.xxhash64("k", "t"), F.lit(3)) > 0)
    rows = rows.select("k", "t", value("a").alias("a"), value("y").alias("y"))
    began = time.time()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "101")
    try:
        got = fa.whitened(rows, ["k"], "t", columns, table).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert time.time() - began < 60
    own = rows.toPandas()
    assert len(got) == len(own) and got.k.isna().sum() == own.k.isna().sum() > 0
    both = own.merge(got, on=["k", "t"], suffixes=("", "_w"))
    assert len(both) == len(own)
    for k in rng.choice(59_999, 300) + 1:
        part = both[both.k == k].sort_values("t")
        w = np.linalg.inv(np.linalg.cholesky(cov[np.ix_(part.t, part.t)]))
        np.testing.assert_allclose(part[["a_w", "y_w"]].to_numpy(), w @ part[columns].to_numpy(), rtol=0, atol=1e-9)
    for bad in ([(1, 0, 1.0), (1, 0, 2.0)], [(1, 5, 1.0)], [(1, None, 1.0)], [(1, 0, 1.0)] * 6):
        with pytest.raises(Exception, match="place twice"):
            fa.whitened(spark.createDataFrame(bad, "k long, t long, a double"), ["k"], "t", ["a"], table).count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_spread_once_for_what_is_grouped_later(spark):
    own = spread(spark.range(20_000).select((F.col("id") % 3).alias("w"), (F.col("id") % 5_000).alias("t"), "id"), "w", "t", rows=500)
    sizes = own.groupBy(F.spark_partition_id()).count().collect()
    assert own.rdd.getNumPartitions() == 40 and max(r["count"] for r in sizes) < 1_000
    grouped = own.groupBy("w", "t", "id").agg(F.count("*").alias("n")).groupBy("w", "t").agg(F.sum("n").alias("n"))
    assert plan_of(grouped).count("Exchange") == 1
    assert grouped.count() == 15_000 and grouped.agg(F.sum("n")).first()[0] == 20_000


def test_objective_keeps_rows_where_they_are(spark, sf):
    """Coefficients go to the rows: joined by window and name, all rows of a name of a window met in one task; nor are rows held by number where they are read."""
    from airledger.plans import queries as library

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(library.queries()["a26_objective"](spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 1 and "name#" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    assert sum("Exchange hashpartitioning" in x and "row_id" in x for x in plan.splitlines()) == 1 and "REPARTITION_BY_NUM" in plan
    assert "HashAggregate" not in plan[plan.index("REPARTITION_BY_NUM"):].split("FileScan")[0]


def test_residual_tables_group_hours_where_they_are(spark, sf):
    """No row is multiplied by the tables it is in, and hours, which are nearly as many as rows, are not shuffled again."""
    from airledger.operators import results as out
    from airledger.plans import queries as library

    plan = plan_of(library.queries()["m12_residual_tables"](spark, sf))
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "t_idx" in x]
    assert shuffles and all("REPARTITION_BY_NUM" in x for x in shuffles)
    assert all("t_idx" not in x for x in plan.splitlines() if " Expand " in x)
    rows = [(0, 1, 0, 3.0), (0, 1, 1, None), (0, 2, 0, 1.0), (1, None, None, 2.0)]
    got = out.residual_tables(spark.createDataFrame(rows, "window_id long, t_idx long, sensor_idx long, r double"))
    assert {tuple(r) for r in got.collect()} == {
        ("window", 0, None, None, 5**0.5, 3), ("monitor", 0, 0, None, 5**0.5, 2), ("monitor", 0, 1, None, None, 1), ("hour", 0, None, 1, 3.0, 2), ("hour", 0, None, 2, 1.0, 1),
        ("window", 1, None, None, 2.0, 1), ("monitor", 1, None, None, 2.0, 1), ("hour", 1, None, None, 2.0, 1),
    }


def test_rejection_rates_of_the_three_cases(spark, sf):
    from airledger.plans import queries as library

    got = {r.case_id: r for r in library.queries()["m9_rejection_rates"](spark, sf).collect()}
    bound = 0.05 + 3 * (0.05 * 0.95 / 100) ** 0.5
    assert {r.n_trials for r in got.values()} == {100} and got[0].rate <= bound and got[2].rate <= bound and got[1].rate == 1.0
    assert got[0].out_of_span is None and got[2].out_of_span < 1e-8 and got[1].out_of_span > 0.05


def test_an_hour_without_plume_mass_is_an_error(spark):
    from airledger.operators import response as rs

    rows = "t_idx long, sx double, sy double, v double"
    assert rs.moments(spark.createDataFrame([(0, 0.0, 1.0, 1.0), (0, 2.0, 1.0, 1.0)], rows)).first().var_x == 1.0
    with pytest.raises(Exception, match="no plume mass at hour 1"):
        rs.moments(spark.createDataFrame([(1, 0.0, 1.0, 0.0)], rows)).collect()


def test_a_factor_recombined_is_that_of_the_recombined_rows(spark):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((60, 3))
    own = fa.factor(matrix(spark, x, "aby"), "window_id", ["a", "b", "y"])
    settings = spark.createDataFrame([(0, 2.0), (1, -0.5)], "config_id long, k double")
    m = lambda k: np.array([[1.0, 0.0], [k, 0.0], [0.0, 1.0]])
    for r in fa.recombined(own, "window_id", settings, lambda s: m(s.k)).collect():
        z, got = x @ m({0: 2.0, 1: -0.5}[r.config_id]), np.array(r.r).reshape(2, 2)
        assert r.n_rows == 60 and np.allclose(got.T @ got, z.T @ z)

"""Composite jobs against NumPy on their collected rows, and invariants of queries without SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from airledger.operators import factor as fa
from airledger.operators import groups as gr
from airledger.operators import study as st
from airledger.plans import q_chain
from airledger.plans import queries as library


@pytest.fixture(scope="module", params=["city", "gridded"])
def chain(spark, sf, request):
    return {"city": q_chain.chain, "gridded": q_chain.gridded_chain}[request.param](spark, sf)


def test_observed_chain_against_numpy(chain):
    names, q = [f"h{s}_{b}" for s, b in q_chain.COLUMNS], ["one", "time_1", "sin_1", "cos_1"]
    rows = chain["rows"].where("y is not null").toPandas()
    fitted = {(r.window_id, r.name): r.c for r in chain["coefficients"].collect()}
    contributions = {(r.window_id, r.sensor_idx, r.component): (r.projected, r.raw) for r in chain["contributions"].collect()}
    comps = {(r.window_id, r.node): r.component for r in chain["components"].collect()}
    shares = {(r.window_id, r.component): r.share for r in chain["shares"].collect()}
    windows = {w for w, _ in fitted}
    assert windows
    for w in windows:
        own = rows[rows.window_id == w]
        basis, _ = np.linalg.qr(own[q].to_numpy(float))
        clean = lambda x: x - basis @ (basis.T @ x)
        h, y = clean(own[names].to_numpy(float)), clean(own.y.to_numpy(float))
        c = np.array([fitted[w, n] for n in names])
        grad = h.T @ (h @ c - y)
        size = max(1.0, np.abs(h.T @ y).max())
        assert (c >= 0).all() and (grad >= -1e-4 * size).all() and np.abs(grad[c > 1e-8]).max(initial=0) < 1e-4 * size
        l1 = {}
        for comp in {comps[w, s] for s, _ in q_chain.COLUMNS}:
            mine = np.array([comps[w, s] == comp for s, _ in q_chain.COLUMNS])
            raw, projected = own[names].to_numpy(float) @ (c * mine), h @ (c * mine)
            l1[comp] = np.abs(raw).sum()
            for sensor in own.sensor_idx.unique():
                at = (own.sensor_idx == sensor).to_numpy()
                assert np.allclose(contributions[w, sensor, comp], (projected[at].sum(), raw[at].sum()), rtol=1e-6, atol=1e-6)
        for comp, x in l1.items():
            assert abs(shares[w, comp] - x / max(sum(l1.values()), 1e-300)) < 1e-8


def test_edges_join_sources_and_weak_columns_make_none(chain):
    edges = chain["edges"].collect()
    comps = {(r.window_id, r.node): r.component for r in chain["components"].collect()}
    assert all(comps[r.window_id, r.a] == comps[r.window_id, r.b] and r.coherence > 0.97 for r in edges)
    for r in chain["resolution"].collect():
        assert r.n_components == len({c for (w, _), c in comps.items() if w == r.window_id}) and r.merged == (r.n_components < 4)


def test_unobserved_rows_are_never_filled(spark, chain):
    counts = {r.window_id: (r.n_total, r.n_observed, r.status) for r in chain["summary"].collect()}
    for r in chain["rows"].groupBy("window_id").agg(F.count("*").alias("n"), F.count("y").alias("k")).collect():
        assert counts[r.window_id][:2] == (r.n, r.k) and (counts[r.window_id][2] == "uncalibrated") == (r.k >= 9)


def test_sweep_recovers_the_truth_where_nothing_was_changed(spark, sf):
    own = {(r.config_id, r.name): r for r in library.queries()["m8_swept_fits"](spark, sf).collect()}
    columns = spark.createDataFrame(q_chain.COLUMNS, "source_idx long, basis_idx long")
    truth = {f"h{r.source_idx}_{r.basis_idx}": r.c for r in st.synthetic_coefficients(columns, "truth").collect()}
    error = lambda k: np.sqrt(sum((own[k, n].c - c) ** 2 for n, c in truth.items()))
    assert len(own) == 8 * len(q_chain.SETTINGS) and all(0.3 <= c <= 1.2 for c in truth.values())
    if own[0, "h0_0"]["rank"] == 8:
        assert error(0) < 1e-3 * len(truth) and all(error(k) > error(0) for k in (1, 2, 3, 4, 5))
    assert own[0, "h0_0"].residual_norm < 1e-4 and all(own[k, "h0_0"].residual_norm > own[0, "h0_0"].residual_norm for k in (1, 2, 3, 4, 5))


def test_ensembles_of_different_columns_are_refused(spark):
    rows = spark.createDataFrame([(0, 1.0, 2, 2, 2), (1, 1.0, 3, 3, 3)], "w long, sigma_j double, rank int, effective_rank int, n_columns int")
    none = lambda kind: spark.createDataFrame([], kind)
    with pytest.raises(ValueError):
        gr.ensemble_report(rows, none("w long, i int, j int, ambiguous boolean"), none("w long, name string, weak boolean"), none("w long, component long, grp string"), none("col_idx int, source_idx long"), "w")


def test_background_directions_are_orthogonal_and_dependent_ones_named(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((50, 5))
    x[:, 2] = x[:, 0] - 3 * x[:, 1]
    df = spark.createDataFrame([(0, *map(float, r)) for r in x], "w long, a double, b double, c double, h double, y double")
    r = fa.background_report(df, "w", ["a", "b", "c"], ["h", "y"], 2).first()
    assert r["rank"] == 2 and r.dependent == ["c"] and r.within_cap and r.orthogonality < 1e-12 and r.idempotence < 1e-12


def rows_of(spark, sf, name):
    return library.queries()[name](spark, sf).collect()


def test_per_sensor_factors_lie_within_the_pooled_one(spark, sf):
    assert all(r.within_pooled for r in rows_of(spark, sf, "a15_per_sensor_identifiability"))


def test_ensemble_spectra_are_ordered(spark, sf):
    r = rows_of(spark, sf, "a16_ensemble_spectra")[0]
    assert 0 <= r.q05 <= r.q50 <= r.q95 and 0 <= r.p_full_effective_rank <= r.p_full_rank <= 1


def test_search_ends_at_the_goal(spark, sf):
    goals = {r.key: r.goal for r in spark.read.parquet(f"{sf}/customer.parquet").groupBy((F.col("c_nationkey") % 5).alias("key")).agg((F.avg("c_acctbal") / 10000).alias("goal")).collect()}
    for r in rows_of(spark, sf, "m10_refinement_search"):
        assert abs(r.p0 - goals[r.key]) < 0.03 and abs(r.p1 + goals[r.key]) < 0.03


def test_factor_shares_and_kernel_masses(spark, sf):
    shares = rows_of(spark, sf, "m5_nonnegative_factors")
    assert abs(sum(r.share for r in shares) - 1) < 1e-6 and all(0 <= r.relative_error < 1 for r in shares)
    assert all(r.mass > 0 and r.largest > 0 and r.clipped >= 0 for r in rows_of(spark, sf, "a32_kernel_mass"))
    assert all(r.distance >= 0 and 0 <= r.mass_within <= 1 for r in rows_of(spark, sf, "a24_footprint_localization"))


def test_background_removed_fits_recover_and_raw_ones_do_not(spark, sf):
    own = {(r.window_id, r.method): r.coefficient_error for r in rows_of(spark, sf, "m14_method_comparison")}
    windows = {w for w, _ in own}
    assert {m for _, m in own} == {"chain", "plain", "raw"}
    assert all(own[w, "plain"] < 1e-6 and own[w, "chain"] < 1e-3 and own[w, "raw"] > own[w, "plain"] for w in windows)


def test_sweep_without_noise_recovers(spark, sf):
    own = {(r.noise, r.slope, r.name): r.c for r in rows_of(spark, sf, "m8_sweep")}
    assert abs(own[0.0, 1.0, "h1"] - 0.5) < 1e-6 and abs(own[0.0, 1.0, "h2"] - 0.3) < 1e-6 and abs(own[0.0, 0.5, "h2"] - 0.6) < 1e-6


def test_drawn_winds_lie_within_the_observed_ones(spark, sf):
    from airledger.plans.q_readings import panel

    most = panel(spark, sf).where("vector_valid").agg(F.max(F.hypot("ux", "vy"))).first()[0]
    own = library.queries()["t7_wind_ensemble"](spark, sf)
    numbers = [c for c, t in own.dtypes if t == "double" and c in ("ux", "vy", "vx")]
    assert numbers and all(own.agg(F.max(F.abs(c))).first()[0] <= most + 1e-6 for c in numbers)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_rank_of_a_background_does_not_depend_on_how_rows_are_dealt(spark, sf_dir):
    """A column and its double differ by rounding alone, of as many rows as there are."""
    rows = q_chain.design(spark, sf_dir).withColumns({"one": F.lit(1.0), "twice": 2 * F.col("h3")}).select("window_id", "one", "h3", "twice", "h1", "y")
    for n in (1, 4, 200):
        own = fa.factor(rows.repartition(n), "window_id", ["one", "h3", "twice", "h1", "y"]).collect()
        assert len(own) == 12 and all(fa.split(r.r, 3, 1, r.n_rows)["kept"].tolist() == [0, 1] for r in own)


def test_residuals_of_a_projection_are_measured_on_rows(spark):
    """A row that the factor leaves out (null) counts nowhere; the figures are those of NumPy on the rest."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 4)) * [1, 1e4, 1, 1e3]
    rows = [(k % 2, *map(float, r)) for k, r in enumerate(x)] + [(0, 1.0, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "w long, a double, b double, h double, y double").repartition(5)
    for r in fa.background_report(df, "w", ["a", "b"], ["h", "y"]).collect():
        own = x[r.w::2]
        left = own[:, 2:] - own[:, :2] @ np.linalg.lstsq(own[:, :2], own[:, 2:], rcond=None)[0]
        assert r["rank"] == 2 and r.dependent == [] and r.orthogonality < 1e-12 and r.idempotence >= r.orthogonality
        assert np.abs(own[:, :2].T @ left).max() < 1e-6


def test_gram_of_the_projected_columns_comes_from_the_factor(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((90, 5))
    df = spark.createDataFrame([(0, *map(float, r)) for r in x], "w long, a double, b double, h double, k double, y double")
    h = x[:, 2:4] - x[:, :2] @ np.linalg.lstsq(x[:, :2], x[:, 2:4], rcond=None)[0]
    for r in fa.projected_gram(fa.factor(df.repartition(4), "w", list("abhky")), "w", 2, 2).collect():
        assert abs(r.g - (h.T @ h)[r.i, r.j]) < 1e-9


def test_a_field_without_space_is_the_city_wind(spark):
    """Puffs, kernel and response under a field that is the same everywhere are those of the city's wind, however a window is split."""
    from airledger.operators import response as rs
    from airledger.operators import spatial as sp

    rng = np.random.default_rng(6)
    city = spark.createDataFrame([(t, *map(float, rng.normal(0, 1, 2))) for t in range(30)], "t_idx long, vx double, vy double")
    cells = sp.cells(spark, 5, 6).select("ix", "iy")
    field = city.join(F.broadcast(cells)).select("t_idx", "ix", "iy", F.col("vx").alias("dx"), F.col("vy").alias("dy"))
    sensors = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "sensor_idx long, sx double, sy double")
    releases = city.select(F.col("t_idx").alias("tau")).join(F.broadcast(cells))
    keys = ["t_idx", "tau", "lag", "sensor_idx", "ix", "iy"]
    want = rs.kernel(rs.puffs(cells, city, 4, 5, 6)[0], sensors, city).toPandas().sort_values(keys).reset_index(drop=True)
    for window, most in ((168, 100_000), (7, 50)):
        own = rs.kernel(rs.gridded(releases, field, rs.bilinear, 4, 5, 6, window=window, most=most), sensors, city)
        got = own.toPandas().sort_values(keys).reset_index(drop=True)
        assert (got[keys] == want[keys]).all().all() and np.abs(got.g - want.g).max() < 1e-9


def test_kernel_of_a_gridded_wind_against_plain_steps(spark):
    """Every puff walked by itself, its axis the mean way from where it was released."""
    from airledger.operators import response as rs

    rng = np.random.default_rng(7)
    n, size, lag = 9, 4, 3
    wind = rng.normal(0, 0.7, (n, size, size, 2))
    field = spark.createDataFrame([(t, i, j, *map(float, wind[t, i, j])) for t in range(n) for i in range(size) for j in range(size)], "t_idx long, ix long, iy long, dx double, dy double")
    releases = spark.createDataFrame([(i, j, t) for t in range(n) for i in range(size) for j in range(size)], "ix long, iy long, tau long")
    hours = spark.range(n).withColumnRenamed("id", "t_idx")
    sensors = spark.createDataFrame([(0, 1.5, 2.0)], "sensor_idx long, sx double, sy double")
    got = {(r.ix, r.iy, r.tau, r.lag): r.g for r in rs.kernel(rs.gridded(releases, field, rs.bilinear, lag, size, size, window=4, most=20), sensors, hours).collect()}

    def at(t, x, y):
        t, x, y = min(max(t, 0), n - 1), min(max(x, 0), size - 1), min(max(y, 0), size - 1)
        a, i, j = min(int(t), n - 2), min(int(x), size - 2), min(int(y), size - 2)
        return sum(((t - a) if da else 1 - t + a) * ((x - i) if di else 1 - x + i) * ((y - j) if dj else 1 - y + j) * wind[a + da, i + di, j + dj] for da in (0, 1) for di in (0, 1) for dj in (0, 1))

    want = {}
    for t in range(n):
        for i in range(size):
            for j in range(size):
                p, alive = np.array([i, j], float), True
                for k in range(lag):
                    if alive and t + k < n:
                        v = at(t, *p) if k == 0 else (p - [i, j]) / k
                        e = v / np.hypot(*v) if np.hypot(*v) > 1e-8 else np.array([1.0, 0.0])
                        d, age = np.array([1.5, 2.0]) - p, max(k, 0.25)
                        a, b = d @ e, -d[0] * e[1] + d[1] * e[0]
                        want[i, j, t, k] = np.exp(-0.5 * (a * a / (0.49 * age) + b * b / (0.0625 * age))) / (2 * np.pi * np.sqrt(0.49 * age * 0.0625 * age))
                    for sub in range(4):
                        if alive:
                            p = p + at(t + k + sub / 4, *p) / 4
                            alive = bool((p >= -0.5).all() and (p <= size - 0.5).all())
    assert got.keys() == want.keys() and all(abs(got[k] - g) < 1e-9 for k, g in want.items())


def small_study(spark, vx, vy, windows=2, T=24):
    """A made-up study of two sources and four sensors; data are made under the wind (vx, vy), the study assumes (1, 0)."""
    from airledger.operators import response as rs
    from airledger.operators import spatial as sp

    n = windows * T
    wind = lambda x, y: spark.range(n).select(F.col("id").alias("t_idx"), F.lit(float(x)).alias("vx"), F.lit(float(y)).alias("vy"))
    cells, hours = sp.cells(spark, 8, 8).select("ix", "iy"), spark.range(n).withColumnRenamed("id", "t_idx")
    sensors = spark.createDataFrame([(0, 3.0, 2.0), (1, 5.0, 3.0), (2, 4.0, 5.0), (3, 6.0, 6.0)], "sensor_idx long, sx double, sy double")
    inventory = spark.createDataFrame([(0, 1, 2, 5.0), (0, 2, 2, 3.0), (1, 2, 5, 4.0), (1, 3, 6, 2.0)], "source_idx long, ix long, iy long, mass double")
    basis = hours.select("t_idx", F.lit(0).cast("long").alias("basis_idx"), (1.0 + 0.5 * F.sin(F.col("t_idx") * 0.7)).alias("phi"))
    h = rs.response(rs.kernel(rs.puffs(cells, wind(vx, vy), 4, 8, 8)[0], sensors, hours), inventory, basis)
    y = h.groupBy("t_idx", "sensor_idx").agg((F.sum(F.when(F.col("source_idx") == 0, 1.2).otherwise(0.7) * F.col("h")) + 0.5).alias("y"))
    rows = gr.durable(y.where(F.col("t_idx") % T >= 3).withColumn("one", F.lit(1.0)))
    return lambda **more: st.refined(wind(1.0, 0.0), cells, sensors, inventory, basis, rows, ["one"], [(0, 0), (1, 0)], 8, 8, 4, window=T, **more)


def test_refinement_improves_the_fit_under_a_turned_wind(spark):
    run = small_study(spark, 1.0, 0.2)
    more = dict(correction="constant", dispersion=False, eps=0.4, weight=0.001, step=0.1, rounds=2)
    rows, more_rows = (sorted(run(**more).collect()) for _ in range(2))
    first, again = [tuple(r) for r in rows], [tuple(r) for r in more_rows]
    assert len(first) == 2 and np.allclose([r[1:12] for r in first], [r[1:12] for r in again], atol=1e-9)
    for r in rows:
        assert r.data < 0.5 * r.data0 and r.total < r.total0 and r.ay0 > 0.05 and abs(r.ax0) <= 0.4 and r.largest <= 0.4 + 1e-9
        assert (r.along, r.across, r.least_age) == (0.7, 0.25, 0.25) and (r.accepted or "sigma_fell" in r.reasons)


def test_refinement_is_bounded_and_gated(spark):
    run = small_study(spark, 1.0, 0.3, windows=1)
    tight = run(correction="constant_linear", dispersion=True, eps=0.03, upper=(0.72, 2.0, 5.0), weight=0.001, weight_psi=0.001, rounds=2).first()
    assert tight.largest <= 0.03 + 1e-9 and tight.along <= 0.72 and tight.data <= tight.data0 + 1e-9
    refused = run(correction="constant", dispersion=False, eps=0.5, weight=0.001, rho=0.0, rounds=1).first()
    assert not refused.accepted and "coherent" in refused.reasons
    held = run(correction="constant", dispersion=True, eps=0.3, weight=1e9, weight_psi=1e9, rounds=1).first()
    assert held.ax0 == held.ay0 == 0 and held.data == held.data0 and held.accepted


def test_overlapping_windows_have_the_factors_of_each_by_itself(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((300, 3))
    df = spark.createDataFrame([(k // 5, *map(float, r)) for k, r in enumerate(x)], "t long, a double, b double, y double").repartition(4)
    windows = spark.createDataFrame([(0, 0), (1, 7), (2, 7), (3, 20), (4, 36), (5, 500)], "window_id long, start long")
    got = {r.window_id: (r.n_rows, np.array(r.r).reshape(3, 3)) for r in fa.window_factors(df, "t", ["a", "b", "y"], windows, 24).collect()}
    starts = dict(windows.collect())
    assert set(got) == {0, 1, 2, 3, 4}
    for w, (n, r) in got.items():
        own = x[(np.arange(300) // 5 >= starts[w]) & (np.arange(300) // 5 < starts[w] + 24)]
        assert n == len(own) and np.allclose(r.T @ r, own.T @ own)
    one = fa.window_factors(df, "t", ["a", "b", "y"], windows.where("window_id = 3"), 24).first()
    assert one.n_rows == 120 and fa.window_factors(df, "t", ["a"], windows.limit(0), 24).count() == 0


def test_retained_mass_by_nodes(spark):
    """Against plain loops over cells and nodes; at the border mass is lost and never renormalized."""
    from airledger.operators import response as rs

    rng = np.random.default_rng(12)
    puffs = [(i, i, 0, int(lag), float(x), float(y), float(a), float(b)) for i, (lag, x, y, a, b) in enumerate(zip(rng.integers(0, 4, 40), rng.uniform(-0.5, 7.5, 40), rng.uniform(-0.5, 5.5, 40), rng.normal(0, 1, 40), rng.normal(0, 1, 40)))]
    puffs += [(90, 90, 0, 1, 3.0, 3.0, 0.0, 0.0), (91, 91, 0, 1, -0.5, 3.0, 1.0, 0.0)]
    df = spark.createDataFrame(puffs, "ix long, iy long, tau long, lag long, x double, y double, wx double, wy double").repartition(3)
    got = {r.ix: r.raw for r in rs.retained(df, 8, 6, 3.0).collect()}
    for i, _, _, lag, x, y, a, b in puffs:
        old = max(lag, 0.25)
        vp, vq, norm = 0.49 * old, 0.0625 * old, np.hypot(a, b)
        ex, ey = (a / norm, b / norm) if norm > 1e-8 else (1.0, 0.0)
        radius, total = 3.0 * vp**0.5, 0.0
        for cx in range(max(0, int(np.floor(x - radius))), min(7, int(np.ceil(x + radius))) + 1):
            for cy in range(max(0, int(np.floor(y - radius))), min(5, int(np.ceil(y + radius))) + 1):
                for ox in rs.NODES:
                    for oy in rs.NODES:
                        dx, dy = cx + ox - x, cy + oy - y
                        total += np.exp(-0.5 * ((dx * ex + dy * ey) ** 2 / vp + (-dx * ey + dy * ex) ** 2 / vq)) / (2 * np.pi * (vp * vq) ** 0.5)
        assert abs(got[i] - total / 25) < 1e-9
    assert got[90] > 0.95 > 0.6 > got[91] > 0.4


def test_retained_and_dropped_are_what_was_emitted(spark, sf):
    rows = library.queries()["a32_quadrature"](spark, sf).collect()
    assert len(rows) == 8 and all(abs(r.retained + r.dropped - r.emitted) < 1e-9 * r.emitted and r.dropped > 0 and r.n_kernels > 0 and r.largest > 0 for r in rows)


def test_masked_columns_never_meet_the_kernel(spark, sf):
    from airledger.functions import bases as ba

    may = sorted(map(tuple, ba.admissible(spark.createDataFrame([*q_chain.GROUPS, (9, "fires")], "source_idx long, source_name string")).collect()))
    assert may == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 5), (2, 6), (3, 4), (9, 0)]
    own = library.queries()["f11_admissible_response"](spark, sf)
    assert {tuple(r) for r in own.select("source_idx", "basis_idx").distinct().collect()} == set(may[:-1])
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_historical_windows_cover_the_record(spark, sf):
    rows = library.queries()["a16_historical_windows"](spark, sf).collect()
    assert len(rows) == 20 and all(0 < r.n_rows <= 168 * 4 and r["rank"] <= 8 for r in rows) and min(r.start for r in rows) == 0
    r = library.queries()["a16_historical_ensemble"](spark, sf).first()
    assert 0 <= r.q05 <= r.q50 <= r.q95 and 0 <= r.p_full_effective_rank <= r.p_full_rank <= 1


def test_members_of_a_wind_ensemble_are_fitted_apart(spark, sf):
    """Without an error all members agree with the city's own fit; with one they spread; other kinds are refused."""
    from airledger.operators import fit as fi

    still = q_chain.drawn_fits(spark, sf, "perturb", 2, 0.0).collect()
    c = {(r.member_id, r.name): r.c for r in still}
    columns = spark.createDataFrame(q_chain.COLUMNS, "source_idx long, basis_idx long")
    truth = {f"h{r.source_idx}_{r.basis_idx}": r.c for r in st.synthetic_coefficients(columns, "truth").collect()}
    assert len(c) == 16 and all(abs(c[m, n] - truth[n]) < 1e-4 for m, n in c)
    moved = {r.name: r.q95 - r.q05 for r in fi.ensemble_intervals(q_chain.drawn_fits(spark, sf, "bootstrap", 3), "name").collect()}
    assert len(moved) == 8 and max(moved.values()) > 1e-6
    wrong = spark.createDataFrame([(0, 0, 1.0, 1.0, "inventory")], "member_id long, t_idx long, ux double, vy double, ensemble_kind string")
    with pytest.raises(ValueError):
        st.transport_ensemble(wrong, None, None, None, None, None, None, [], [], 1, 1, 1)


def test_report_tables_of_the_chain(spark, sf):
    tables = library.queries()["m12_identifiability_table"](spark, sf).collect()
    assert tables and all(r.status in ("uncalibrated", "insufficient_observed_rows") for r in tables)
    for r in tables:
        if r.status == "uncalibrated":
            assert r.sigma_1 >= r.sigma_j >= 0 and len(r.visibility) == 8 and "+".join(sorted(r.report_components)).count("s") == 4
    seen = library.queries()["m12_monitor_table"](spark, sf)
    assert seen.columns == ["window_id", "sensor_idx", "g0", "g1", "g2", "g3"] and seen.select("sensor_idx").distinct().count() == 4

"""Queries that must cover every hour, station and row of their tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airledger.operators import readings as rd
from airledger.operators import response as rs
from airledger.plans import queries as library
from airledger.plans.q_readings import hours, panel


@pytest.fixture(scope="module")
def n_hours(spark, sf):
    return hours(spark, sf).count()


@pytest.mark.parametrize("name, column", [
    ("j6_lagged_pairs", "t_idx"), ("j7_puff_paths", "tau"), ("j9_lagged_response", "t_idx"), ("f8_puff_density", "t_idx"), ("a32_kernel_mass", "tau"),
    ("a8_emission_field", "t_idx"), ("a41_plume_moments", "t_idx"), ("j10_space_time_neighbours", "t_idx"), ("j8_gridded_advection", "tau"), ("t7_wind_ensemble", "t_idx"),
])
def test_every_hour_has_rows(spark, sf, n_hours, name, column):
    found = library.queries()[name](spark, sf).agg(F.count_distinct(column), F.max(column)).first()
    # a release needs wind an hour later, and a drawn ensemble misses hours whose stations were not drawn
    least = {"j7_puff_paths": n_hours - 1, "t7_wind_ensemble": 0.9 * n_hours}.get(name, n_hours)
    assert found[0] >= least and found[1] >= least - 1


def test_windows_give_the_rows_of_one_window(spark):
    rng = np.random.default_rng(0)
    n, size, lag = 23, 4, 3
    field = pd.DataFrame([(t, i, j, *rng.normal(0, 1.5, 2)) for t in range(n) if t not in (7, 8, 9) for i in range(size) for j in range(size)], columns=["t_idx", "ix", "iy", "dx", "dy"])
    releases = pd.DataFrame([(i, j, t) for t in range(n + 3) for i in range(size) for j in range(size)], columns=["ix", "iy", "tau"])
    frames = spark.createDataFrame(releases, "ix long, iy long, tau long"), spark.createDataFrame(field, "t_idx long, ix long, iy long, dx double, dy double")
    keys = ["tau", "ix", "iy", "lag"]
    one, cut = (rs.gridded(*frames, rs.bilinear, lag, size, size, window=w).toPandas().sort_values(keys).reset_index(drop=True) for w in (1000, 5))
    assert set(one.tau) == set(range(n + 3)) and len(one) > len(releases)
    pd.testing.assert_frame_equal(one, cut)


def test_windows_reach_the_last_hour(spark):
    """At sf0.01 there are more hours than the 600 of w6's and w7's SQL."""
    at = "/root/testdata/sf0.01"
    last, all_rows = (f(spark, at) for f in (lambda *a: hours(*a).count() - 1, lambda *a: panel(*a).count()))
    assert last > 600
    filled = library.queries()["w7_sliding_imputation"](spark, at)
    assert filled.count() == all_rows and filled.agg(F.max("t_idx")).first()[0] == last
    starts = rd.even_windows(spark, last + 1, 168, 8).agg(F.max("start")).first()[0]
    assert starts + 167 == last
    days = panel(spark, at).where(F.col("t_idx") > last - 168).groupBy("station_id").agg(F.avg("pm25").alias("m"))
    ends = library.queries()["w6_even_windows"](spark, at).where("window_id = 7").join(days, "station_id")
    assert ends.count() == 32 and ends.where("abs(pm25 - m) > 1e-5").count() == 0


def test_missing_source_has_all_cases(spark, sf):
    got = {r.case_id: r for r in library.queries()["m9_missing_source"](spark, sf).collect()}
    assert set(got) == {0, 1, 2} and got[0].out_of_span is None and got[2].out_of_span < 1e-8 and 0.01 < got[1].out_of_span < 1
    assert got[1].inadequate and got[1].p_value < 0.002  # 1000 replicates can say so, 100 can't
    own = library.queries()["m9_missing_source"](spark, sf)
    assert abs(got[2].t0 - got[0].t0) < 1e-6 * got[0].t0 and own.columns[-1] == "out_of_span"


def test_no_order_window_or_reading_is_left_out(spark, sf):
    run = lambda name: library.queries()[name](spark, sf)
    assert run("c6_run_results").count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    assert run("m12_pair_report").select("window_id").distinct().count() == 12
    turned = run("f2_wind_from_vector")
    assert turned.count() == spark.read.parquet(f"{sf}/events.parquet").count() and turned.where("wd = 0").count() > 0 and turned.where("wd >= 360").count() == 0


@pytest.mark.parametrize("name", ["p7_fixed_zero_columns", "f11_admissible_columns"])
def test_columns_come_from_a_table(spark, sf, name):
    assert library.queries()[name](spark, sf).inputFiles()

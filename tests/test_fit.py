import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lactoscope import COVERAGE_FIT, GROUP_FIT, HERD_FILE_FIT, UNBOUNDED_FIT, FitSettings
from lactoscope.functions.expressions import energy_corrected, error_sigma
from lactoscope.operators import fit, solver

INFINITE = UNBOUNDED_FIT.lower, UNBOUNDED_FIT.upper


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.fixture(scope="module")
def weighted(lactation):
    return lactation.withColumn("ECM", energy_corrected()).withColumn("SIGMA", error_sigma("DIM", 60, strict=True))


# Published parameters of the sample lactation, and losses measured for them.
def test_unbounded_fit(weighted):
    r = one(fit.fit_records_by(weighted, ["LACT"], UNBOUNDED_FIT))
    assert r.weighted_sse == pytest.approx(461.8716, abs=1e-3)
    assert (r.a, r.b, r.c) == pytest.approx((82.742, 174.166, -183.389), rel=2e-3)
    assert round(r.d, 3) == 0.001 and r.status == 0 and r.npoints == 14


def test_bounded_fit(weighted):
    r = one(fit.fit_records_by(weighted, ["LACT"], COVERAGE_FIT))
    assert [round(v, 3) for v in (r.a, r.b, r.c, r.d)] == [76.961, 100.0, -144.894, 0.001]
    assert r.weighted_sse == pytest.approx(462.5510, abs=1e-3)


def test_fit_that_ends_on_bounds(weighted):
    r = one(fit.fit_records_by(weighted, ["LACT"], GROUP_FIT))
    assert (r.b, r.c) == (10.0, -5.0)
    assert r.weighted_sse == pytest.approx(506.1234, abs=1e-3)


def test_raw_milk_fit(lactation):
    settings_ = FitSettings((90.0, 25.0, 15.0, 0.001), *INFINITE)
    r = one(fit.fit_records_by(lactation.withColumn("SIGMA", F.lit(1.0)), ["LACT"], settings_, value="MILK"))
    assert (r.a, r.b, r.c) == pytest.approx((95.8512, 31.7547, 14.3402), rel=1e-4)
    assert r.rmse**2 == pytest.approx(4.4584, abs=1e-4)


def curve(p, t):
    return solver.curve_values(np.array([p]), np.atleast_2d(t).astype(float))[0]


parameters = st.tuples(st.floats(30, 120), st.floats(12, 45), st.floats(-4, 4), st.floats(3e-4, 1.8e-3))
BOUNDS = np.array(GROUP_FIT.lower), np.array(GROUP_FIT.upper)


def solve(t, y, w, start=GROUP_FIT.start):
    return solver.fit_batch(
        np.atleast_2d(t).astype(float), np.atleast_2d(y), np.atleast_2d(w), np.atleast_2d(start), *BOUNDS
    )


@settings(max_examples=60, deadline=None)
@given(parameters, st.lists(st.integers(5, 320), min_size=8, max_size=40, unique=True))
def test_curve_without_noise_is_found(p, days):
    t = np.sort(days)
    found, loss, _, converged, _ = solve(t, curve(p, t), np.ones(len(t)))
    assert converged[0]
    assert np.abs(curve(found[0], t) - curve(p, t)).max() < 0.05


@settings(max_examples=60, deadline=None)
@given(parameters, st.integers(0, 10**6))
def test_bounds_loss_and_gradient(p, seed):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.choice(np.arange(5, 325), 25, replace=False))
    y = curve(p, t) + rng.normal(0, 5, len(t))
    w = np.where(t > 30, 1.0, 1 / 2.25)
    found, loss, _, converged, jacobian = solve(t, y, w)
    q = found[0]
    assert (q >= BOUNDS[0]).all() and (q <= BOUNDS[1]).all()
    start_loss = (w * (y - curve(GROUP_FIT.start, t)) ** 2).sum()
    assert loss[0] <= start_loss
    pull = jacobian[0].T @ (np.sqrt(w) * (y - curve(q, t)))
    scale = np.linalg.norm(jacobian[0], axis=0) * np.sqrt(loss[0]) + 1e-12
    free = (q > BOUNDS[0]) & (q < BOUNDS[1])
    assert (np.abs(pull / scale)[free] < 1e-3).all()
    assert (pull[q <= BOUNDS[0]] / scale[q <= BOUNDS[0]] < 1e-6).all()
    assert (pull[q >= BOUNDS[1]] / scale[q >= BOUNDS[1]] > -1e-6).all()


def test_groups_of_a_batch_do_not_disturb_each_other():
    rng = np.random.default_rng(5)
    t = np.sort(rng.integers(5, 325, (20, 30)), axis=1).astype(float)
    y = np.array([curve((60 + i, 20, -1, 0.001), t[i]) for i in range(20)]) + rng.normal(0, 3, t.shape)
    w = (np.arange(30)[None, :] < rng.integers(5, 31, 20)[:, None]).astype(float)
    start = np.tile(GROUP_FIT.start, (20, 1))
    together = solver.fit_batch(t, y, w, start, *BOUNDS)
    for i in range(20):
        alone = solver.fit_batch(t[i : i + 1], y[i : i + 1], w[i : i + 1], start[:1], *BOUNDS)
        assert together[1][i] == pytest.approx(alone[1][0], rel=1e-9)


def noisy(spark, groups, per_group, seed=1, days=60):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        for _ in range(per_group):
            t = int(rng.integers(5, 5 + days * 5))
            y = float(curve((60 + 8 * g, 20, -1, 0.0012), t)[0] + rng.normal(0, 4))
            rows.append((g + 1, t, y))
    frame = spark.createDataFrame(rows, "LAGR int, DIM int, ECM double")
    return frame.withColumn("SIGMA", error_sigma())


def test_reduced_points_give_the_fit_of_all_records(spark):
    records = noisy(spark, 1, 400)
    r = one(fit.fit_records_by(records, ["LAGR"]))
    raw = records.orderBy("DIM").toPandas()
    t, y, w = raw.DIM.values, raw.ECM.values, 1 / raw.SIGMA.values**2
    found, loss, _, _, _ = solve(t, y, w)
    assert r.weighted_sse == pytest.approx(loss[0], rel=1e-8)
    assert (r.a, r.b, r.c, r.d) == pytest.approx(tuple(found[0]), rel=1e-3, abs=1e-3)
    residuals = y - curve((r.a, r.b, r.c, r.d), t)
    assert r.rmse == pytest.approx(np.sqrt((residuals**2).mean()), rel=1e-9)
    jacobian = solve(t, y, w, (r.a, r.b, r.c, r.d))[4][0]
    expected = np.linalg.inv(jacobian.T @ jacobian) * loss[0] / (len(t) - 4)
    assert np.array(r.covariance).reshape(4, 4) == pytest.approx(expected, rel=1e-2)


def test_order_and_partitions_of_records_do_not_matter(spark):
    records = noisy(spark, 3, 80)
    first = fit.fit_records_by(records.repartition(7), ["LAGR"]).orderBy("LAGR").collect()
    second = fit.fit_records_by(records.orderBy(F.desc("ECM")).coalesce(1), ["LAGR"]).orderBy("LAGR").collect()
    for x, y in zip(first, second):
        assert (x.a, x.b, x.c, x.d) == pytest.approx((y.a, y.b, y.c, y.d), rel=1e-6)


def test_herd_level_is_the_fit_of_all_groups(spark):
    records = noisy(spark, 3, 80)
    both = {r.LAGR: r for r in fit.fit_herd_and_groups(records).collect()}
    herd = one(fit.fit_records_by(records.withColumn("LAGR", F.lit(0)), ["LAGR"]))
    assert sorted(both) == [0, 1, 2, 3]
    assert both[0].weighted_sse == pytest.approx(herd.weighted_sse, rel=1e-9)
    assert both[0].npoints == herd.npoints == 240
    missing = records.withColumn("LAGR", F.when(F.col("LAGR") > 1, F.col("LAGR")))
    kept = {r.LAGR: r.npoints for r in fit.fit_herd_and_groups(missing).collect()}
    assert kept == {None: 80, 2: 80, 3: 80, 0: 240}


@pytest.mark.parametrize("points, status", [(1, 3), (3, 3), (4, 2), (5, 0), (12, 0)])
def test_status_by_number_of_points(spark, points, status):
    rows = [(1, 10 + 25 * i, float(curve((80, 20, -2, 0.001), 10 + 25 * i)[0] + (-1) ** i)) for i in range(points)]
    frame = spark.createDataFrame(rows, "LAGR int, DIM int, ECM double").withColumn("SIGMA", error_sigma())
    r = one(fit.fit_records_by(frame, ["LAGR"], HERD_FILE_FIT))
    assert (r.status, r.npoints) == (status, points)
    assert (r.a is None) == (status == 3)
    assert (r.covariance is None) == (status != 0)


def test_groups_without_values(spark):
    rows = [(1, 10, None), (1, 20, None), (2, 10, 30.0), (2, 50, None), (2, 60, 35.0)]
    frame = spark.createDataFrame(rows, "LAGR int, DIM int, ECM double").withColumn("SIGMA", error_sigma())
    found = {r.LAGR: r for r in fit.fit_records_by(frame, ["LAGR"], FitSettings(min_points=3)).collect()}
    assert (found[1].status, found[1].records, found[1].npoints) == (3, 2, 0)
    assert (found[2].status, found[2].records, found[2].npoints, found[2].last_dim) == (2, 3, 2, 60)


def test_start_beyond_a_bound_is_moved_inside(spark):
    rows = [(1, 10 + 20 * i, 260.0 - i) for i in range(12)]
    frame = spark.createDataFrame(rows, "LAGR int, DIM int, ECM double").withColumn("SIGMA", error_sigma())
    limits = FitSettings((90.0, 100.0, -15.0, 0.002), (0.0, 0.0, -250.0, 0.0), (200.0, 100.0, 1000.0, 0.01), True)
    r = one(fit.fit_records_by(frame, ["LAGR"], limits))
    assert r.status in (0, 2) and r.a <= 200.0


def test_own_starts_per_group(spark):
    records = noisy(spark, 2, 60)
    starts = spark.createDataFrame([(1, 70.0, 15.0, 0.0, 0.001)], "LAGR int, a double, b double, c double, d double")
    points = fit.day_points(records, ["LAGR"])
    default = {r.LAGR: r for r in fit.fit_points(points, ["LAGR"]).collect()}
    started = {r.LAGR: r for r in fit.fit_points(points, ["LAGR"], starts=starts).collect()}
    for g in (1, 2):
        assert started[g].weighted_sse == pytest.approx(default[g].weighted_sse, rel=1e-6)


def test_correlations(spark):
    rows = fit.correlations(fit.fit_records_by(noisy(spark, 1, 200), ["LAGR"]), ["LAGR"]).collect()
    matrix = {(r.i, r.j): r.correlation for r in rows}
    assert len(matrix) == 16
    for i in range(4):
        assert matrix[i, i] == pytest.approx(1.0)
        for j in range(4):
            assert matrix[i, j] == pytest.approx(matrix[j, i])
            assert abs(matrix[i, j]) <= 1 + 1e-9


def test_outcome_counts(spark):
    rows = [(g, 10 + 25 * i, 50.0 - i + (i * g) % 3) for g, n in ((1, 2), (2, 4), (3, 9), (4, 3)) for i in range(n)]
    frame = spark.createDataFrame(rows, "LAGR int, DIM int, ECM double").withColumn("SIGMA", error_sigma())
    r = one(fit.fit_outcomes(fit.fit_records_by(frame, ["LAGR"], HERD_FILE_FIT)))
    assert (r.cases, r.too_few_points, r.failed, r.no_covariance) == (4, 2, 0, 1)


def test_series_have_one_entry_per_day(spark):
    rows = [(1, 20, 30.0), (1, 10, 20.0), (1, 10, 40.0), (1, 30, None)]
    frame = spark.createDataFrame(rows, "LAGR int, DIM int, ECM double")
    assert [tuple(x) for x in one(fit.daily_series(frame, ["LAGR"])).series] == [(10, 2, 30.0), (20, 1, 30.0)]

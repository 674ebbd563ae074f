"""Fits by variable projection against many descents, known curves and faulty values."""

import numpy as np
import pytest

from lactoscope.operators import projection, solver
from lactoscope.settings import HERD_FILE_FIT, LACTATION_FIT, SINGLE_ANIMAL_FIT

MODELS = {"lactation": LACTATION_FIT, "herd file": HERD_FILE_FIT, "birth date": SINGLE_ANIMAL_FIT}


def noisy(n, seed, noise=5.0, most=14):
    draw = np.random.default_rng(seed)
    t = np.sort(draw.choice(np.arange(1, 380), (n, most)), axis=1).astype(float)
    p = np.column_stack([draw.uniform(30, 90, n), draw.uniform(10, 50, n), draw.uniform(-5, 5, n), draw.uniform(0.0002, 0.002, n)])
    y = solver.curve_values(p, t) + noise * draw.normal(size=t.shape)
    w = (np.arange(most) < draw.integers(1, most + 1, (n, 1))).astype(float)
    return t, y, w, p


@pytest.mark.parametrize("model", MODELS)
def test_no_descent_from_anywhere_ends_lower(model):
    settings = MODELS[model]
    lower, upper = np.array(settings.lower), np.array(settings.upper)
    t, y, w, _ = noisy(150, 3)
    p, loss, _, converged, _ = projection.fit_projected(t, y, w, settings.start, lower, upper)
    assert converged.all() and (p >= lower - 1e-9).all() and (p <= upper + 1e-9).all()
    with np.errstate(all="ignore"):
        gap = np.where(w > 0, y - solver.curve_values(p, t), 0.0)
    assert np.allclose(loss, (w * gap**2).sum(axis=1), rtol=1e-9, atol=1e-9)
    draw = np.random.default_rng(1)
    lower[1] = max(lower[1], projection.LEAST_B)
    for _ in range(12):
        start = lower + draw.random((150, 4)) * (upper - lower)
        other = solver.fit_batch(t, y, w, start, lower, upper)[1]
        # One valley in some thousands lies between the steps of the grid.
        assert (loss > other * (1 + 1e-5) + 1e-5).sum() <= 1


def test_known_curves_come_back():
    t, y, w, _ = noisy(200, 5, noise=0.0)
    _, loss, *_ = projection.fit_projected(t, y, w, LACTATION_FIT.start, LACTATION_FIT.lower, LACTATION_FIT.upper)
    inside = np.abs(y).max(axis=1) > 0
    assert (loss[inside] < 1e-4).mean() > 0.99


def test_values_that_are_not_finite_fail_alone():
    t, y, w, _ = noisy(4, 7)
    w[:] = 1
    y[1, 2], y[2, 0] = np.inf, np.nan
    _, loss, _, converged, _ = projection.fit_projected(t, y, w, LACTATION_FIT.start, LACTATION_FIT.lower, LACTATION_FIT.upper)
    assert converged.tolist() == [True, False, False, True] and np.isfinite(loss[[0, 3]]).all()


def test_same_day_single_day_and_no_level():
    t = np.array([[5.0, 5.0, 5.0], [300.0, 0.0, 0.0], [10.0, 20.0, 30.0]])
    y = np.array([[40.0, 42.0, 44.0], [30.0, 0.0, 0.0], [-5.0, -6.0, -7.0]])
    w = np.array([[1.0, 1.0, 1.0], [1.0, 0.0, 0.0], [1.0, 1.0, 1.0]])
    p, loss, _, converged, _ = projection.fit_projected(t, y, w, HERD_FILE_FIT.start, HERD_FILE_FIT.lower, HERD_FILE_FIT.upper)
    assert converged.all() and loss[0] == pytest.approx(8.0) and loss[1] == pytest.approx(0.0, abs=1e-9)
    # Negative yields are followed by a curve below 0 only as far as the bounds of c allow.
    assert loss[2] <= (y[2] ** 2).sum() + 1e-9 and p[2, 0] >= 0


def test_fits_do_not_depend_on_other_rows():
    t, y, w, _ = noisy(60, 11)
    whole = projection.fit_projected(t, y, w, HERD_FILE_FIT.start, HERD_FILE_FIT.lower, HERD_FILE_FIT.upper)[1]
    halves = [projection.fit_projected(t[i::2], y[i::2], w[i::2], HERD_FILE_FIT.start, HERD_FILE_FIT.lower, HERD_FILE_FIT.upper)[1] for i in (0, 1)]
    assert np.allclose(whole[0::2], halves[0], rtol=1e-6) and np.allclose(whole[1::2], halves[1], rtol=1e-6)

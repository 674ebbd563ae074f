import numpy as np
import pytest
from pyspark.sql import functions as F

from lactoscope.operators import proof
from lactoscope.operators.search import Grid, _unweighted

TWO = Grid(a=(0.0, 150.0, 16), b=(5.0, 200.0, 4), c=(-10.0, 5.0, 4), d=(0.0, 0.004, 5))


def wavy(days, height, period):
    y = 70 * (1 - np.exp((-1 - days) / 20) / 2) * np.exp(-0.0012 * days)
    return y + height * np.cos(days / period)


def records_of(spark, series):
    rows = [(k, int(t), float(v)) for k, (days, y) in series.items() for t, v in zip(days, y)]
    return spark.createDataFrame(rows, "LAGR int, DIM int, ECM double")


def losses(t, y, b, c, d):
    """Mean squared loss at the best level, for arrays of b, c and d."""
    f = (1 - np.exp((c[..., None] - t) / b[..., None]) / 2) * np.exp(-d[..., None] * t)
    a = np.clip((f * y).sum(-1) / (f * f).sum(-1), 0, 150)
    return ((y - a[..., None] * f) ** 2).mean(-1)


def test_two_valleys_against_a_fine_grid(spark):
    days = np.arange(5, 325, 5)
    series = {k: (days, wavy(days, h, p)) for k, h, p in ((1, 5.0, 20.0), (2, 10.0, 30.0), (None, 5.0, 30.0))}
    series[7] = (days[:2], np.array([50.0, 51.0]))
    unknown = spark.createDataFrame([(8, 10, None)], "LAGR int, DIM int, ECM double")
    records = records_of(spark, series).unionByName(unknown)
    found = {r.LAGR: r for r in proof.proven_minimum(records, ["LAGR"], TWO, 0.01).collect()}
    assert set(found) == set(series)
    short = found.pop(7)
    assert short.loss == pytest.approx(0, abs=1e-9) and short.lower <= short.loss and short.gap == 0
    b, c, d = np.meshgrid(np.geomspace(5, 200, 90), np.linspace(-10, 5, 31), np.linspace(0, 0.004, 81), indexing="ij")
    for key, r in found.items():
        t, y = series[key]
        grid = losses(t, y, b, c, d)
        along = grid.min(axis=(1, 2))
        inner = along[1:-1]
        if key != 2:
            assert ((inner < along[:-2]) & (inner < along[2:])).sum() >= 2 or along[-1] < along[-2]
        assert r.lower <= r.loss <= grid.min() * (1 + 1e-9)
        assert 0 <= r.gap <= 0.01 and r.gap == pytest.approx(1 - r.lower / r.loss)
        here = losses(t, y, *(np.array([x]) for x in (r.b, r.c, r.d)))[0]
        assert here == pytest.approx(r.loss, rel=1e-9)


def test_bounds_of_boxes_hold_for_their_curves(spark):
    """No curve drawn from a box has a loss below the box's bound; the middle's loss is one of them."""
    days, draw = np.arange(8, 300, 7), np.random.default_rng(5)
    y = wavy(days, 4.0, 25.0) + draw.normal(0, 2, len(days))
    points = _unweighted(records_of(spark, {1: (days, y)}), ["LAGR"], "ECM", "DIM")
    sides = []
    for _ in range(60):
        v, d = draw.uniform(0.005, 0.2), draw.uniform(0, 0.004)
        size = 10.0 ** draw.uniform(-4, 0)
        sides.append((1, float(v), float(min(v + 0.1 * size, 0.2)), float(d), float(min(d + 0.002 * size, 0.004))))
    boxes = spark.createDataFrame(sides, "LAGR int, v1 double, v2 double, d1 double, d2 double").withColumns(
        {"t0": F.lit(8.0), "yy": F.lit(float((y * y).sum())), "within": F.lit(0.0), "best": F.lit(1e9)}
    )
    looked = proof._looked_at(boxes, points, ["LAGR"], TWO, 0.01).collect()
    assert len(looked) == len(sides)
    useful = 0
    for r in looked:
        v, d = draw.uniform(r.v1, r.v2, 4000), draw.uniform(r.d1, r.d2, 4000)
        loss = losses(days, y, 1 / v, draw.uniform(-10, 5, 4000), d).min() * len(days)
        assert r.low <= loss * (1 + 1e-9) and r.low <= r.here.loss * (1 + 1e-9)
        useful += r.low > 0.5 * loss
        here = losses(days, y, *(np.array([x]) for x in (r.here.b, r.here.c, r.here.d)))[0]
        assert here * len(days) == pytest.approx(r.here.loss, rel=1e-8)
        assert TWO.a[0] <= r.here.a <= TWO.a[1] and TWO.c[0] <= r.here.c <= TWO.c[1]
    assert useful >= 10


def test_a_search_cut_short_says_so(spark):
    days = np.arange(5, 325, 5)
    found = proof.proven_minimum(records_of(spark, {1: (days, wavy(days, 5.0, 20.0))}), ["LAGR"], TWO, 0.001, rounds=2).first()
    assert 0.001 < found.gap <= 1 and found.lower < found.loss
    empty = proof.proven_minimum(records_of(spark, {}), ["LAGR"], TWO)
    assert empty.count() == 0
    for bad in ({"tolerance": 0.0}, {"tolerance": 1.0}):
        with pytest.raises(ValueError):
            proof.proven_minimum(records_of(spark, {}), ["LAGR"], TWO, **bad)

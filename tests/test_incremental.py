"""Runs that take in only what is new, exact quantiles, exact draws and the limit on b * d."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lactoscope.operators import profile, projection, solver
from lactoscope.operators.quantiles import exact_cuts, exact_quantiles
from lactoscope.plans import incremental
from lactoscope.plans.incremental import StoredModel, points_by_group, update
from lactoscope.sources.sample_mapping import mapped_herds, mapped_test_days
from lactoscope.sources.tables import cut_lineage, read_or_empty, replace_partitions, shared_folder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return cut_lineage(mapped_test_days(spark, SF))


def run_until(spark, events, model, day):
    rows = events.where(F.to_date("EventDateTime") <= F.lit(day))
    update(rows, mapped_herds(spark, rows), model)


def found_points(spark, model):
    rows = points_by_group(model.points(spark)).collect()
    return {(r.SourceHerdID, r.LAGR, r.t): (r.n, round(r["mean"], 6), round(r.spread, 4), r.peak) for r in rows}


def test_several_runs_equal_one(spark, events):
    once, often = StoredModel(shared_folder(spark)), StoredModel(shared_folder(spark))
    end = dt.date(2030, 1, 1)
    run_until(spark, events, once, end)
    for day in (dt.date(2021, 6, 1), dt.date(2022, 12, 15), end):
        run_until(spark, events, often, day)
    assert found_points(spark, once) == found_points(spark, often)
    curves = [{(r.SourceHerdID, r.LAGR): r.weighted_sse for r in m.curves(spark).collect()} for m in (once, often)]
    assert curves[0].keys() == curves[1].keys() and all(curves[1][k] == pytest.approx(v, rel=1e-6) for k, v in curves[0].items())
    before = found_points(spark, often)
    run_until(spark, events, often, end)  # nothing new
    assert found_points(spark, often) == before


def test_run_cut_short_is_made_good(spark, events, monkeypatch):
    model, whole = StoredModel(shared_folder(spark)), StoredModel(shared_folder(spark))
    run_until(spark, events, model, dt.date(2021, 6, 1))

    def broken(frame, path, by):
        if path.endswith("/marks"):
            raise OSError("lost")
        replace_partitions(frame, path, by)

    monkeypatch.setattr(incremental, "replace_partitions", broken)
    with pytest.raises(OSError):
        run_until(spark, events, model, dt.date(2030, 1, 1))
    monkeypatch.undo()
    run_until(spark, events, model, dt.date(2030, 1, 1))
    run_until(spark, events, whole, dt.date(2030, 1, 1))
    assert found_points(spark, model) == found_points(spark, whole)


def test_a_run_reads_only_later_events(spark, events):
    due = spark.createDataFrame([(1, 1, dt.date(2023, 1, 1), dt.date(2022, 5, 1))], "SourceCode int, SourceHerdID int, LastTestDayEventDate date, mark date")
    plan = incremental.new_points(events, due)._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan and "EventDateTime" in plan


def test_nothing_stored_yet(spark):
    assert read_or_empty(spark, shared_folder(spark), incremental._MARKS).count() == 0


def plain_quantile(values, share):
    values = sorted(values)
    return values[max(1, math.ceil(share * len(values))) - 1]


def test_exact_quantiles(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["a", "b", None]), draw.choice([draw.gauss(0, 1e6), draw.random() * 1e-9, 3.0, float(draw.randint(-5, 5))])) for _ in range(4000)]
    rows += [("c", None), ("c", float("nan")), ("d", 7.0), ("e", float("inf")), ("e", float("-inf")), ("e", 1.0), ("f", 1e308), ("f", -1e308), ("f", 5.0)]
    rows += [("g", 2.5)] * 3000  # all alike
    shares = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    found = {(r.k, r.share): r.value for r in exact_quantiles(spark.createDataFrame(rows, "k string, x double"), "x", shares, ["k"]).collect()}
    groups = {}
    for k, x in rows:
        if x is not None and not math.isnan(x):
            groups.setdefault(k, []).append(x)
    assert found == {(k, s): plain_quantile(v, s) for k, v in groups.items() for s in shares}
    everything = spark.createDataFrame([(float(i % 997),) for i in range(5000)], "x double")
    assert exact_cuts(everything, "x").first().cuts == [plain_quantile([i % 997 for i in range(5000)], s) for s in (0.25, 0.5, 0.75)]
    assert exact_quantiles(everything.where("false"), "x", [0.5]).count() == 0


def test_draws_are_exact_repeatable_and_merge(spark):
    rows = spark.range(4000).withColumn("name", F.when(F.col("id") % 3 > 0, F.concat(F.lit("n"), "id")))
    first = sorted(map(str, profile.random_rows(rows, 100).collect()))
    assert len(first) == 100 and first == sorted(map(str, profile.random_rows(rows.repartition(7), 100).collect()))
    assert first != sorted(map(str, profile.random_rows(rows, 100, seed=24).collect()))
    counts = Counter(r.id for r in profile.random_rows(spark.range(10), 2000).collect())
    assert len(counts) == 10 and max(abs(n - 200) for n in counts.values()) < 80


@pytest.mark.parametrize("limit", [0.004, 0.02, 0.5])
def test_limit_on_the_product(limit):
    draw = np.random.default_rng(8)
    t = np.tile(np.arange(5.0, 345.0, 10.0), (6, 1))
    p = np.column_stack([draw.uniform(40, 80, 6), draw.uniform(10, 40, 6), draw.uniform(-5, 5, 6), draw.uniform(0.0005, 0.0035, 6)])
    y, w = solver.curve_values(p, t) + draw.normal(size=t.shape), np.ones_like(t)
    lower, upper = np.array([0.0, 5.0, -10.0, 0.0]), np.array([150.0, 50.0, 5.0, 0.004])
    found, loss, *_ = projection.fit_projected(t, y, w, [90, 20, -2, 0.001], lower, upper, limit=limit)
    assert (found[:, 1] * found[:, 3] <= limit * (1 + 1e-9)).all()
    assert np.allclose(loss, ((y - solver.curve_values(found, t)) ** 2).sum(axis=1), rtol=1e-6)
    b, d = np.linspace(5, 50, 91), np.linspace(0, 0.004, 161)
    grid = projection.inner(t, y, w, np.tile(b, (6, 1)), np.tile(d, (6, 1)), lower, upper)[2]
    grid[:, b[:, None] * d[None, :] > limit] = np.inf
    assert (loss <= grid.min(axis=(1, 2)) * (1 + 1e-9)).all()

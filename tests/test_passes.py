"""How often rows move, are read and are laid out."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalog import QUERIES
from lactoscope import HERD_FILE_FIT, LACTATION_FIT
from lactoscope.operators import digests, history, profile, projection, solver
from lactoscope.operators.fill import fill_components
from lactoscope.operators.quantiles import exact_quantiles
from lactoscope.sources.sample_mapping import mapped_test_days

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shuffled_joins(spark):
    """No table is small enough to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if " Exchange " in line]


def test_order_lines_move_once(shuffled_joins):
    moves = exchanges(mapped_test_days(shuffled_joins, SF))
    assert len(moves) == 4 and sum("l_orderkey" in m for m in moves) == 1


def test_days_to_fill_move_once(spark):
    rows = spark.range(50).selectExpr("date '2020-01-01' + cast(id % 5 as int) as BDAT", "id % 5 as ID", "id % 5 + 1 as LACT", "id as DIM", "if(id % 3 = 0, null, id * 1e0) as PCTF", "1e0 as PCTP")
    assert len(exchanges(fill_components(rows))) <= 2
    filled = {r.DIM: r.PCTF for r in fill_components(rows).collect()}
    assert filled[0] == 5.0 and filled[15] == 10.0 and filled[16] == 16.0


def test_quantiles_make_their_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return float(x)

    rows = spark.range(200).select((F.col("id") % 2).alias("g"), counted("id").alias("x"))
    found = exact_quantiles(rows, "x", [0.5], ["g"])
    assert sorted((r.g, r.value) for r in found.collect()) == [(0, 98.0), (1, 99.0)]
    # Once in the filter and once in the values; four passes would make 1,600.
    assert made.value <= 400


def test_known_curves_are_fitted_once(spark):
    plan = QUERIES["known_lactation_curves"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_grids_are_laid_out_in_parts(monkeypatch):
    sizes, whole = [], projection._inner

    def seen(t, y, w, b, d, *rest):
        sizes.append(len(t) * b.shape[1] * d.shape[1])
        return whole(t, y, w, b, d, *rest)

    monkeypatch.setattr(projection, "_inner", seen)
    random = np.random.default_rng(5)
    t = np.sort(random.uniform(1, 399, (300, 9)), axis=1)
    y, w = random.uniform(10, 60, t.shape), np.ones(t.shape)
    b, d = np.tile(np.linspace(10, 50, 25), (300, 1)), np.tile(np.linspace(0, 0.002, 25), (300, 1))
    bounds = np.asarray(LACTATION_FIT.lower), np.asarray(LACTATION_FIT.upper)
    parts = projection.inner_loss(t, y, w, b, d, *bounds)
    assert max(sizes) <= projection._CELLS_AT_ONCE
    assert np.array_equal(parts, whole(t, y, w, b, d, *bounds, True)[2])


def test_long_series_do_not_widen_many_short_ones():
    lengths = np.array([4] * 3000 + [9] * 3000 + [49] * 20)
    groups = list(solver.chunks(lengths))
    assert sorted(np.concatenate(groups)) == list(range(len(lengths)))
    assert sum(len(rows) * lengths[rows].max() for rows in groups) <= 1.6 * lengths.sum()


def test_descents_go_on_in_parts_and_end_alike(monkeypatch):
    sizes, take = [], solver._Steps.take

    def seen(self, most):
        sizes.append(self.t.size)
        return take(self, most)

    monkeypatch.setattr(solver._Steps, "take", seen)
    random = np.random.default_rng(9)
    t = np.sort(random.uniform(1, 399, (120, 8)), axis=1)
    y, w = random.uniform(10, 60, t.shape), (random.random(t.shape) < 0.8).astype(float)
    fit = (LACTATION_FIT.start, LACTATION_FIT.lower, LACTATION_FIT.upper)
    whole = solver.fit_batch(t, y, w, *fit, 60)
    monkeypatch.setattr(solver, "_CELLS_AT_ONCE", 80)
    sizes.clear()
    parts = solver.fit_batch(t, y, w, *fit, 60)
    assert max(sizes) <= 80 and np.allclose(whole[0], parts[0]) and np.allclose(whole[1], parts[1])
    assert np.array_equal(whole[2], parts[2]) and np.array_equal(whole[3], parts[3])


def test_few_cells_of_a_grid_go_by_their_edges(monkeypatch):
    """The others have one best ratio, and no place inside the bounds is better than it."""
    cells, on_edges = [], projection._on_edges
    monkeypatch.setattr(projection, "_on_edges", lambda *sums: (cells.append(len(sums[1])), on_edges(*sums))[1])
    random = np.random.default_rng(6)
    t = np.sort(random.choice(np.arange(1, 380), (40, 9)), axis=1).astype(float)
    y, w = random.uniform(10, 90, t.shape), np.ones(t.shape)
    y[0], y[1], t[2] = 0.0, -y[1], 7.0
    lower, upper = np.asarray(HERD_FILE_FIT.lower), np.asarray(HERD_FILE_FIT.upper)
    b, d = np.tile(np.geomspace(1, 500, 25), (40, 1)), np.tile(np.linspace(0, 0.01, 25), (40, 1))
    alpha, beta, loss = projection.inner(t, y, w, b, d, lower, upper)
    assert sum(cells) <= 0.15 * loss.size
    with np.errstate(all="ignore"):
        c = np.where(alpha > 0, b[:, :, None] * np.log(2 * beta / alpha) + t[:, :1, None], 0.0)
    assert (alpha >= 0).all() and (alpha <= upper[0]).all() and (c > lower[2] - 1e-6).all() and (c < upper[2] + 1e-6).all()
    for _ in range(200):
        level, c = random.uniform(0, 500) * random.integers(0, 2), random.uniform(-250, 200)
        p = np.stack(np.broadcast_arrays(level, b[:, :, None], c, d[:, None, :]), axis=-1).reshape(-1, 4)
        with np.errstate(all="ignore"):
            gap = np.repeat(y, 625, axis=0) - solver.curve_values(p, np.repeat(t, 625, axis=0))
            other = (gap * gap).sum(axis=1).reshape(loss.shape)
        assert not (other < loss * (1 - 1e-9) - 1e-6).any()


def test_only_ends_that_gained_are_looked_at_again(monkeypatch):
    rows, around = [], projection._around

    def seen(t, y, w, u, d, *rest):
        rows.append(len(t))
        u, d, loss = around(t, y, w, u, d, *rest)
        # One row seems to have a lower place near its end.
        return u, d, np.where(np.arange(len(t)) == 0, loss - 1.0, loss)

    monkeypatch.setattr(projection, "_around", seen)
    random = np.random.default_rng(4)
    t = np.sort(random.uniform(1, 380, (50, 9)), axis=1)
    y, w = random.uniform(40, 60, t.shape), np.ones(t.shape)
    projection.fit_projected(t, y, w, LACTATION_FIT.start, LACTATION_FIT.lower, LACTATION_FIT.upper)
    assert rows[0] == 50 and sum(rows[1:]) <= 2


@pytest.mark.parametrize("rule", [history.fit_records, history.individual_records])
def test_records_are_read_once_to_accept_their_lactations(shuffled_joins, rule):
    rows = shuffled_joins.sql(
        "select if(id < 3, null, date '2020-01-01') as BDAT, id % 4 as ID, 1 as LACT, cast(195 + 3 * id as int) as DIM, if(id % 9 = 8, null, 30e0) as ECM from range(30)"
    )
    kept = rule(rows)
    assert len(exchanges(kept)) == 1 and kept.columns == rows.columns
    assert all(r.BDAT is not None and r.ECM is not None for r in kept.collect()) and kept.count() > 0


def test_stored_points_move_once_to_their_lactation(spark):
    from lactoscope.plans.incremental import _POINTS, points_by_group

    points = spark.range(40).selectExpr(
        "date '2020-01-01' + cast(id % 5 as int) as BDAT", "string(id % 5) as ID", "int(id % 5 + 1) as LACT", "int(id % 4 + 1) as LAGR",
        "date '2021-01-01' + cast(id as int) as TestDate", "int(200 + id) as t", "1e0 as sigma", "id * 0 + 1 as records", "id * 0 + 1 as n",
        "id * 1e0 as mean", "0e0 as spread", "id * 1e0 as peak", "id * 0 + 1 as accepted_rows", "int(1 + id % 2) as SourceCode", "int(id % 5) as SourceHerdID",
    )
    assert points.columns == _POINTS.fieldNames()
    found = points_by_group(points)
    moves = exchanges(found)
    assert sum("hashpartitioning(BDAT" in m or "BDAT#" in m for m in moves) == 1
    assert sum(r.n for r in found.collect()) == 80


def test_places_of_passages_move_as_plain_bytes(spark):
    from lactoscope.llm.suffixes import suffixes

    texts = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(90)))], "row_number_ long, text string")
    found = suffixes(texts, 16, 5, 35)
    assert dict(found.dtypes)["places"] == "binary"
    places = [np.frombuffer(r.places, dtype="<i4") for r in found.collect()]
    assert places and all(len(p) == 1 and 0 <= p[0] <= 55 for p in places)


def test_texts_meet_their_cuts_by_one_plan_at_every_size(spark, tmp_path):
    """A small table is measured with the join that a large one gets."""
    from lactoscope.llm.suffixes import cut_passages

    text = " ".join(f"w{i}" for i in range(90))
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, text), (2, f"first {text} last"), (3, None)], "doc_id long, text string").coalesce(1).write.parquet(path)
    left = cut_passages(spark.read.parquet(path))
    found = {r.doc_id: r.text for r in left.collect()}
    plan = left._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan
    assert found == {1: text, 2: "first last", 3: None}


def test_draws_of_any_number_read_their_input_once(spark):
    """Of an input in parts each task gives a row for a draw, and digests are those of the library."""
    rows = spark.range(0, 900, 1, 3).selectExpr("id", "if(id % 7 = 0, null, repeat('é', int(id % 90))) as name", "id % 3 = 0 as third")
    drawn = profile.random_rows(rows, 300, 5, ["id", "name"])
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1 and drawn.columns == rows.columns
    texts = {r: "".join(f"{len(t)}:{t}" for t in (str(r.id), r.name or "")) for r in rows.collect()}
    expected = [min(texts, key=lambda r: hashlib.md5(f"5:{draw}:{texts[r]}".encode()).hexdigest()) for draw in range(1, 301)]
    assert sorted(map(str, drawn.collect())) == sorted(map(str, expected))
    assert profile.random_rows(rows, 0).count() == 0


@pytest.mark.parametrize("shortest, longest, rows", [(0, 3, 700), (20, 60, 700), (100, 260, 600), (50, 58, 20)])
def test_least_digests_of_short_long_and_repeated_texts(shortest, longest, rows):
    random = np.random.default_rng(longest)
    texts = ["".join(random.choice(list("ab:é"), random.integers(shortest, longest + 1))) for _ in range(rows + 1)]
    prefixes = [f"{seed}:{draw}:".encode() for seed in (3, 12345678901) for draw in (1, 12, 123)]
    found = digests.least(prefixes, pa.array(texts)[1:], [None] * len(prefixes))
    for nth, prefix in enumerate(prefixes):
        keys = [hashlib.md5(prefix + text.encode()).hexdigest() for text in texts[1:]]
        assert found[nth][0] == min(keys) == keys[found[nth][1]]
    assert digests.least(prefixes, pa.array(texts)[1:], [found[nth][0] for nth in range(len(prefixes))]) == {}

import datetime as dt
import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog.base import ECM, FORWARD_FIRST, RAW, TO_FILL_1_399
from catalog.fits import fitted
from lactoscope import LACTATION_FIT, RunParameters
from lactoscope.functions.expressions import energy_corrected, error_sigma
from lactoscope.functions.sql import register_functions
from lactoscope.operators import fit, history, profile, score, search, trend
from lactoscope.operators.search import Grid, constrained_minimum
from lactoscope.operators.selection import primary_records
from lactoscope.plans import group_model, lactation_model, median_model, sql_model
from lactoscope.sources import tables
from lactoscope.sources.sample_mapping import mapped_herds, mapped_test_days
from lactoscope.sources.tables import shared_folder

SF = "/root/testdata/sf0.001"
RUN = RunParameters(dt.date(2022, 7, 1))


@pytest.fixture(scope="module")
def sample(spark):
    events = mapped_test_days(spark, SF).cache()
    return events, mapped_herds(spark, events).cache()


@pytest.fixture(scope="module")
def model(sample):
    return group_model.group_model(*sample, RUN, store_stages=True)


def test_model_by_dataframe_and_by_sql(spark, model):
    by_sql = sql_model.sql_group_model(spark, model.inputs)
    ours = {r.grp: r for r in model.parameters.collect()}
    theirs = {r.grp: r.parameters for r in by_sql["curve_parameters"].collect()}
    assert sorted(ours) == sorted(theirs) == ["HERD", "LAGR_1", "LAGR_2", "LAGR_3", "LAGR_4"]
    for name, r in ours.items():
        assert (r.a, r.b, r.c, r.d) == pytest.approx(tuple(theirs[name]), rel=1e-6, abs=1e-6)
    mine = {(r.BDAT, r.ID, r.LACT): r.m305 for r in model.yields.collect()}
    other = {(r.BDAT, r.ID, r.LACT): r.m305 for r in by_sql["yields"].collect()}
    assert mine == pytest.approx(other, rel=1e-6) and len(mine) == 200


def test_curves_and_results_are_stored(spark, model, tmp_path):
    model.write(str(tmp_path))
    curves = spark.read.parquet(str(tmp_path / "curves"))
    assert curves.count() == 5 * 70
    assert spark.read.parquet(str(tmp_path / "lactations")).count() == 200


def test_herds_fitted_in_one_job_as_one_by_one(sample):
    events, herds = sample
    keys = ["SourceCode", "SourceHerdID"]
    together = group_model.group_model(events, herds, RUN, by=keys)
    found = {(r.SourceHerdID, r.LAGR): r for r in together.parameters.collect()}
    yields = together.yields.groupBy("SourceHerdID").agg(F.sum("m305").alias("s"), F.count("*").alias("n")).collect()
    yields = {r.SourceHerdID: (r.s, r.n) for r in yields}
    due = [r.SourceHerdID for r in herds.where(F.col("LastTestDayEventDate") > F.lit(RUN.last_run)).collect()]
    assert len(due) == 3
    for herd in due:
        alone = group_model.group_model(events, herds, RunParameters(RUN.last_run, herd))
        rows = alone.parameters.collect()
        assert {g for h, g in found if h == herd} == {r.LAGR for r in rows}
        for r in rows:
            assert found[herd, r.LAGR].weighted_sse == pytest.approx(r.weighted_sse, rel=1e-6)
            assert found[herd, r.LAGR].npoints == r.npoints
        one = alone.yields.agg(F.sum("m305").alias("s"), F.count("*").alias("n")).first()
        assert yields[herd] == pytest.approx((one.s, one.n), rel=1e-4)


def test_accepted_points_agree_with_the_join(model):
    """The single-pass form against accepting lactations first and joining them."""
    inputs = model.inputs
    direct = fit.accepted_points(inputs.withColumn("SIGMA", error_sigma()), "LAGR")
    joined = fit.day_points(history.fit_records(inputs).withColumn("SIGMA", error_sigma()), ["LAGR"])
    order = ["LAGR", "t", "sigma"]
    left, right = (f.orderBy(*order).toPandas() for f in (direct, joined))
    assert list(left.n) == list(right.n) == list(left.records)
    for column in ("mean", "spread", "peak"):
        assert list(left[column]) == pytest.approx(list(right[column]), rel=1e-9, abs=1e-7)


def test_herds_and_dates_prune_the_scan(spark, tmp_path):
    """The plan is built without a job; herd partitions and the date bound reach the scan."""
    events = mapped_test_days(spark, SF)
    herds = mapped_herds(spark, events)
    paths = str(tmp_path / "events"), str(tmp_path / "herds")
    events.write.partitionBy("SourceHerdID").parquet(paths[0])
    herds.write.parquet(paths[1])
    events, herds = spark.read.parquet(paths[0]), spark.read.parquet(paths[1])
    spark.sparkContext.setJobGroup("plans", "plan building")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    rows = primary_records(events, herds, RUN)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plans")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "dynamicpruning" in plan
    assert "GreaterThanOrEqual(EventDateTime" in plan


def test_records_without_key_belong_to_no_lactation(spark):
    rows = [("a", 1, d, "2020-01-01") for d in (10, 40, 80, 120, 160)] + [("a", 1, d, None) for d in (10, 40, 80, 120, 160)]
    rows += [(None, 1, d, "2020-01-01") for d in (10, 40, 80, 120, 160)] + [("b", None, d, "2020-01-01") for d in (10, 40, 80, 120, 160)]
    frame = spark.createDataFrame(
        [(e, n, d, b, 40.0 + d % 7, 3.5, 3.1) for e, n, d, b in rows],
        "EarTag string, LactationNumber int, DIM int, BirthDate string, MilkWeight double, PercentFat double, PercentProtein double",
    ).withColumn("BirthDate", F.to_date("BirthDate")).withColumn("FreshDate", F.col("BirthDate"))
    assert [r.EarTag for r in lactation_model.fit_lactations(frame).collect()] == ["a"]
    working = frame.withColumnsRenamed({"LactationNumber": "LACT", "BirthDate": "BDAT", "MilkWeight": "MILK", "PercentFat": "PCTF", "PercentProtein": "PCTP"})
    assert [r.EarTag for r in lactation_model.herd_file_fits(working).collect()] == ["a"]
    means = working.withColumnsRenamed({"EarTag": "ID"}).withColumns({"LAGR": F.col("LACT"), "ECM": F.col("MILK"), "DIM": F.col("DIM") * 2})
    assert [r.ID for r in median_model.animal_quartiles(means).collect()] == ["a"]


def test_no_folder_of_one_machine(spark, monkeypatch):
    class Bare:
        conf = type("conf", (), {"get": staticmethod(lambda name, default=None: None)})
        sparkContext = type("context", (), {"getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Bare)


def test_constrained_minimum_on_the_limit(spark):
    """With the limit on b * d active, no point of a fine grid is better."""
    draw = np.random.default_rng(3)
    t = np.arange(5, 305, 10)
    y = 70 * (1 - np.exp((-1 - t) / 20) / 2) * np.exp(-0.0015 * t) + draw.normal(0, 1, len(t))
    records = spark.createDataFrame([(1, int(d), float(v)) for d, v in zip(t, y)], "LAGR int, DIM int, ECM double")
    grid = Grid(a=(0.0, 150.0, 16), b=(5.0, 50.0, 4), c=(-10.0, 5.0, 4), d=(0.0, 0.004, 5), product_limit=0.01)
    found = constrained_minimum(records, ["LAGR"], grid, rounds=3).first()
    assert found.b * found.d <= 0.01 * (1 + 1e-9) and found.b * found.d > 0.0099
    b, c = np.meshgrid(np.linspace(5, 50, 181), np.linspace(-10, 5, 61))
    best = np.inf
    for share in np.linspace(0.0, 1.0, 41):
        d = np.minimum(0.01 / b, 0.004) * share
        f = (1 - np.exp((c[..., None] - t) / b[..., None]) / 2) * np.exp(-d[..., None] * t)
        a = np.clip((f * y).sum(-1) / (f * f).sum(-1), 0, 150)
        best = min(best, ((y - a[..., None] * f) ** 2).mean(-1).min())
    assert found.loss <= best * (1 + 1e-6)


def test_one_lactation_with_most_records(spark):
    """A sentinel birth date that merges many animals is one key with most rows."""
    rows = spark.range(200000).select(
        F.when(F.col("id") % 3 == 0, F.lit("x")).otherwise((F.col("id") % 5000).cast("string")).alias("ID"),
        (F.col("id") * 7919 % 300 + 5).cast("int").alias("DIM"),
        F.lit("1900-01-01").cast("date").alias("BDAT"),
        F.lit(1).alias("LACT"),
    )
    rows = rows.withColumn("ECM", F.round(60 - F.col("DIM") * 0.05 + F.col("DIM") % 7, 1)).withColumn("SIGMA", error_sigma())
    points = fit.day_points(rows, ["BDAT", "ID", "LACT"])
    sizes = points.groupBy("ID").agg(F.count("*").alias("days"), F.sum("n").alias("n"))
    hot = sizes.where("ID = 'x'").first()
    assert hot.n > 60000 and hot.days <= 300
    fits = {r.ID: r for r in fit.fit_points(points, ["BDAT", "ID", "LACT"]).where("ID in ('x', '7')").collect()}
    assert fits["x"].npoints == hot.n and fits["x"].status == 0 and fits["7"].npoints > 0


def test_failed_fits_can_get_fixed_parameters(spark):
    frame = spark.createDataFrame(
        [(1, None, None, None, None), (3, None, None, None, None), (0, 80.0, 20.0, -1.0, 0.001)],
        "status int, a double, b double, c double, d double",
    )
    found = {r.status: tuple(r)[1:] for r in fit.with_fallback(frame).collect()}
    assert found == {1: (0.0, 10.0, 0.0, 0.0), 3: (None,) * 4, 0: (80.0, 20.0, -1.0, 0.001)}


def test_lactation_fits_against_pattern_search(sample):
    """Losses agree with an independent search, but for lactations with several minima."""
    connection = duckdb.connect()
    for table in ("lineitem", "orders", "customer"):
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    rows = f"""rows as (select BDAT, ID, LACT, DIM, {ECM} as y, case when DIM > 30 then 1e0 else 1.5e0 end as sigma from filled),
    keyed as (select BDAT, ID, LACT, row_number() over (order by BDAT, ID, LACT) as g from rows
              group by BDAT, ID, LACT having count(*) >= 5 and count(y) > 0)"""
    points = """select g, DIM as t, 1 / (sigma * sigma) as w, y from rows r join keyed k
      on r.BDAT = k.BDAT and r.ID = k.ID and r.LACT = k.LACT where y is not null"""
    text = fitted(
        [*RAW, TO_FILL_1_399, FORWARD_FIRST, rows], points, LACTATION_FIT,
        "select k.BDAT, k.ID, k.LACT, loss from fitted f join keyed k on f.g = k.g", steps=300,
    )
    expected = {tuple(r[:3]): r[3] for r in connection.execute(text).fetchall()}
    found = {(r.BDAT, r.EarTag, r.LACT): r.weighted_sse for r in lactation_model.fit_lactations(sample[0]).collect()}
    assert set(found) == set(expected)
    near = sum(v is not None and abs(v - expected[k]) <= 1e-4 * max(expected[k], 1) for k, v in found.items())
    assert near >= 0.95 * len(found)


def test_lactation_fits(sample):
    fits = lactation_model.fit_lactations(sample[0]).cache()
    status = {r.status: r["count"] for r in fits.groupBy("status").count().collect()}
    assert status.get(0, 0) > 0.9 * sum(status.values())
    assert fits.where("records < 5 or npoints < 1").count() == 0
    residuals = lactation_model.fit_residuals(sample[0], fits)
    again = residuals.groupBy(*lactation_model.KEYS).agg(F.sqrt(F.avg(F.col("error") ** 2)).alias("again"))
    gap = fits.join(again, list(lactation_model.KEYS)).agg(F.max(F.abs(F.col("again") - F.col("rmse")))).first()[0]
    assert gap < 1e-9


def test_single_animal_file(spark):
    rows = [(dt.date(1900, 1, 1), 1, 60.0 + i % 7, 10 + 9 * i, 4.0, 3.0) for i in range(36)]
    rows += [(dt.date(2012, 3, 15), 6, 70.0, 22, 4.0, 3.0)]
    frame = spark.createDataFrame(rows, tables.LACTATIONS_CSV)
    found = {r.LACT: r for r in lactation_model.single_animal_fits(frame).collect()}
    assert (found[1].npoints, found[1].status) == (36, 0)
    assert (found[6].npoints, found[6].status, found[6].a) == (1, 3, None)


def test_median_model(sample):
    records = median_model.filled_records(sample[0])
    kept = median_model.records_of(sample[0])
    assert sorted(kept.collect()) == sorted(median_model.records_with_history(records).collect())
    fits = {r.LAGR: r for r in median_model.fit_wide_median_curve(kept).collect()}
    assert sorted(fits) == ["1", "2", "3", "4+"]
    quartiles = {r.ecm_qtile: r["count"] for r in median_model.animal_quartiles(records).groupBy("ecm_qtile").count().collect()}
    assert sorted(quartiles) == [0.0, 1.0, 2.0, 3.0]
    total = sum(quartiles.values())
    assert all(abs(n - total / 4) <= 0.03 * total for n in quartiles.values())


def test_quantile_of_null_is_an_error(spark):
    frame = spark.createDataFrame([(1, 2.0), (2, None)], "id int, v double")
    with pytest.raises(Exception, match="v is null"):
        profile.quantile_buckets(frame, "v").collect()


def test_quantile_buckets_with_equal_values(spark):
    frame = spark.createDataFrame([(i, 1.0 if i < 8 else 2.0) for i in range(10)], "id int, v double")
    buckets = {r.v: r.bucket for r in profile.quantile_buckets(frame, "v", 4, 1e-6).collect()}
    assert buckets == {1.0: 1.0, 2.0: 1.0}


def test_random_rows(spark):
    assert profile.random_rows(spark.range(30), 100).count() == 100
    assert profile.random_rows(spark.range(5000), 100).count() == 100
    assert profile.random_rows(spark.range(0), 100).count() == 0


def test_trend_leaves_out_the_first_record(lactation):
    r = trend.component_trends(lactation, ["BDAT", "LACT"]).collect()[0]
    rows = lactation.orderBy("DIM").toPandas()
    slope, intercept = np.polyfit(rows.DIM[1:], rows.PCTF[1:], 1)
    assert (r.PCTF_slope, r.PCTF_intercept) == pytest.approx((slope, intercept), rel=1e-9)
    smooth = trend.smooth_components(lactation, ["BDAT", "LACT"]).orderBy("DIM").collect()
    assert len(smooth) == 14 and smooth[0].PCTF_EST == pytest.approx(intercept + 13 * slope, rel=1e-9)


def test_trend_of_short_histories(spark):
    rows = [(1, 10, 1.0, 4.0, 3.0), (2, 10, 1.0, 4.0, 3.0), (2, 20, 1.0, 5.0, None), (3, 5, 1.0, 2.0, 2.0), (3, 7, 1.0, 4.0, 3.0), (3, 7, 1.5, 6.0, 3.0)]
    frame = spark.createDataFrame(rows, "ID int, DIM int, MILK double, PCTF double, PCTP double")
    found = {r.ID: r for r in trend.component_trends(frame, ["ID"]).collect()}
    assert found[1].PCTF_slope is None and found[1].PCTF_intercept is None
    assert (found[2].PCTF_slope, found[2].PCTF_intercept, found[2].PCTP_slope) == (0.0, 5.0, None)
    assert (found[3].PCTF_slope, found[3].PCTF_intercept) == (0.0, 5.0)


def test_geometric_mean_skips_values_without_logarithm(spark):
    rows = [(dt.date(2020, 1, 1), "1", 1, 1, d, e) for d, e in ((5, 9.0), (10, 20.0), (20, 40.0), (30, 0.0), (40, -1.0), (50, 80.0), (60, 10.0), (70, 40.0), (80, None))]
    frame = spark.createDataFrame(rows, "BDAT date, ID string, LACT int, LAGR int, DIM int, ECM double")
    flat = spark.createDataFrame([(1, 20.0, 1.0, -900.0, 0.0)], "LAGR int, a double, b double, c double, d double")
    r = score.individual_scale(frame, flat).collect()[0]
    expected = math.exp(np.mean([math.log(e / 20.0) for e in (20.0, 40.0, 80.0, 10.0, 40.0)]))
    assert r.geom_mean_ratio == pytest.approx(expected) and r.a == pytest.approx(20.0 * expected)
    few = frame.where("DIM < 40 or DIM > 60")
    assert score.individual_scale(few, flat).count() == 0


def test_losses(spark):
    rows = [(1, 3.0, 2.0), (1, 5.0, 7.0), (2, 0.0, -1.0), (2, 4.0, 4.0)]
    frame = spark.createDataFrame(rows, "g int, ECM double, ecm_est double")
    found = {r.g: r for r in score.losses(frame, ["g"]).collect()}
    assert (found[1].mse, found[1].mae, found[1].mape) == pytest.approx((2.5, 1.5, (1 / 3 + 2 / 5) / 2))
    assert found[1].msle == pytest.approx(((math.log(4) - math.log(3)) ** 2 + (math.log(6) - math.log(8)) ** 2) / 2)
    assert found[2].msle is None and found[2].mse == 0.5


@pytest.mark.parametrize("loss", ["mse", "mae", "mape", "msle"])
def test_grid_search_against_all_cells(spark, lactation, loss):
    records = lactation.withColumn("ECM", energy_corrected())
    grid = search.Grid(a=(60.0, 90.0, 4), b=(10.0, 60.0, 3), c=(-100.0, 0.0, 3), d=(0.0, 0.004, 5), product_limit=0.1)
    r = search.grid_search(records, ["LACT"], grid, loss).collect()[0]
    rows = records.toPandas()
    t, y = rows.DIM.values.astype(float), rows.ECM.values
    best = math.inf
    for b in grid.axis("b"):
        for c in grid.axis("c"):
            for d in grid.axis("d"):
                if b * d > 0.1:
                    continue
                g = (1 - np.exp((c - t) / b) / 2) * np.exp(-d * t)
                levels = [float(np.clip((y @ g) / (g @ g), 60, 90))] if loss == "mse" else grid.axis("a")
                for a in levels:
                    e = a * g
                    value = {
                        "mse": lambda: ((y - e) ** 2).mean(),
                        "mae": lambda: np.abs(y - e).mean(),
                        "mape": lambda: (np.abs(y - e) / np.abs(y)).mean(),
                        "msle": lambda: ((np.log1p(y) - np.log1p(e)) ** 2).mean() if (e >= 0).all() else math.inf,
                    }[loss]()
                    best = min(best, value)
    assert r.loss == pytest.approx(best, rel=1e-9) and r.b * r.d <= 0.1


def test_constrained_minimum_and_global_search(lactation):
    records = lactation.withColumn("ECM", energy_corrected())
    grid = search.Grid(a=(0.0, 200.0, 5), b=(5.0, 100.0, 6), c=(-200.0, 0.0, 6), d=(0.0, 0.01, 6), product_limit=0.05)
    tight = search.constrained_minimum(records, ["LACT"], grid, rounds=3).collect()[0]
    free = search.global_search(records, ["LACT"], grid).collect()[0]
    assert tight.b * tight.d <= 0.05 + 1e-12
    assert free.weighted_sse / free.npoints <= tight.loss + 1e-9
    zoomed = search.grid_search(records, ["LACT"], grid, "mae", rounds=3).collect()[0]
    assert zoomed.loss <= search.grid_search(records, ["LACT"], grid, "mae").collect()[0].loss


def test_sql_functions(spark):
    register_functions(spark)
    r = spark.sql(
        """select energy_corrected(40, 4, 3) as e, error_sigma(30) as s, error_sigma(31) as t, error_sigma(null) as u,
           group_name(2) as g, group_name(9) as h, curve_yield(50, array(80d, 20d, -2d, 0.001d)) as y,
           yield_to_day(305, array(80d, 20d, -2d, 0d)) as z"""
    ).first()
    assert r.z == pytest.approx(sum(80 * (1 - math.exp((-2 - t) / 20) / 2) for t in range(1, 306)))
    assert r.e == pytest.approx(40 * (0.383 * 4 + 0.242 * 3 + 0.7832) / 3.1138)
    assert (r.s, r.t, r.u, r.g, r.h) == (1.5, 1.0, None, "LAGR_2", None)
    assert r.y == pytest.approx(80 * (1 - math.exp(-52 / 20) / 2) * math.exp(-0.05))


def test_fit_in_sql_of_many_groups(spark):
    register_functions(spark)
    lists = """select id, collect_list(double(t)) as t,
        collect_list((60 + id) * (1 - exp((-1 - t) / 20d) / 2) * exp(-0.001d * t)) as y, collect_list(1d) as s
        from (select id, explode(sequence(10, 10 + 10 * int(id), 10)) as t from range(5, 25)) group by id
        union all select -1, array(), array(), array()"""
    found = {r.id: r.p for r in spark.sql(f"select id, fit_curve(t, y, s) as p from ({lists})").collect()}
    assert found.pop(-1) is None and len(found) == 20
    for i, (a, b, c, d) in found.items():
        t = np.arange(10, 11 + 10 * i, 10)
        expected = (60 + i) * (1 - np.exp((-1 - t) / 20) / 2) * np.exp(-0.001 * t)
        assert a * (1 - np.exp((c - t) / b) / 2) * np.exp(-d * t) == pytest.approx(expected, abs=0.02)


def test_fit_as_a_table_function(spark, sample):
    """One row for each partition, the same as by the DataFrame form; other partitionings are refused."""
    points = fit.day_points(
        primary_records(*sample, RUN).withColumns({"ECM": energy_corrected(), "SIGMA": error_sigma()}).where("LAGR < 4"), ["LAGR", "LACT"]
    )
    register_functions(spark)
    tables.name_relation(points.unionByName(points.limit(2).withColumn("LACT", F.lit(None).cast("int"))), "some_points")
    by_sql = spark.sql("select * from fit_day_points(table(some_points) partition by (LAGR, LACT))")
    ours = {(r.LAGR, r.LACT): r for r in fit.fit_points(spark.table("some_points"), ["LAGR", "LACT"]).collect()}
    theirs = {(r.LAGR, r.LACT): r for r in by_sql.collect()}
    assert by_sql.columns == ["LAGR", "LACT", *[f.name for f in fit.FIT_FIELDS]] and sorted(map(str, ours)) == sorted(map(str, theirs))
    for key, r in ours.items():
        t = theirs[key]
        assert (r.status, r.records, r.npoints, r.last_dim) == (t.status, t.records, t.npoints, t.last_dim)
        for name in ("a", "b", "c", "d", "weighted_sse", "rmse"):
            assert t[name] == (None if r[name] is None else pytest.approx(r[name], rel=1e-6, abs=1e-9))
        assert (r.covariance is None) == (t.covariance is None)
    with pytest.raises(Exception, match="partition the table by"):
        spark.sql("select * from fit_day_points(table(some_points) partition by LAGR)").collect()
    with pytest.raises(Exception, match="no column"):
        spark.sql("select * from fit_day_points(table(select 1 as t) partition by t)").collect()


def test_stored_stages_go_to_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert tables.shared_folder(spark).startswith(base + "/") and tables.shared_folder(spark) != tables.shared_folder(spark)
    stored = tables.cut_lineage(spark.range(10))
    assert stored.count() == 10 and stored.inputFiles()[0].removeprefix("file://").startswith(base)


def test_count_rules(spark):
    rows = [(1, d, 1.0) for d in (10, 20, 30)] + [(2, d, 1.0) for d in (10, 20, 30, 40)]
    frame = spark.createDataFrame(rows, "ID int, DIM int, ECM double")
    assert {r.ID for r in history.with_point_count(frame, ["ID"]).collect()} == {2}
    accepted = history.accepted_lactations(frame, ("DIM >= 20",), "count >= 3", ["ID"])
    assert [(r.ID, r["count"]) for r in accepted.collect()] == [(2, 3)]


@pytest.mark.parametrize("first, last, kept", [(0, 200, True), (0, 349, True), (0, 199, False), (0, 350, False), (-1, 250, False)])
def test_history_bounds(spark, first, last, kept):
    frame = spark.createDataFrame([("b", "1", 1, first), ("b", "1", 1, last)], "BDAT string, ID string, LAGR int, DIM int")
    assert (history.history_bounds(frame).count() == 1) == kept


def test_sources_and_sinks(spark, sample, tmp_path):
    events, herds = sample
    path = str(tmp_path / "events")
    tables.write_result(events, path, ["SourceHerdID"])
    one = tables.read_test_days(spark, path, herd_id=1)
    assert one.schema.fieldNames() == tables.TEST_DAY_SCHEMA.fieldNames()
    assert [f.dataType for f in one.schema] == [f.dataType for f in tables.TEST_DAY_SCHEMA]
    assert one.count() == events.where("SourceHerdID = 1").count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(SourceHerdID" in plan
    orc = str(tmp_path / "herds")
    herds.write.format("orc").save(orc)
    assert sorted(tables.read_herds(spark, orc, "orc").collect()) == sorted(herds.collect())
    assert tables.save_table(herds, "saved_herds").count() == herds.count()
    assert tables.save_table(herds.limit(2), "saved_herds").count() == 2
    grid = [r.DIM for r in tables.day_grid(spark, 0, 345, 5).collect()]
    assert grid == list(range(0, 350, 5))


def test_random_rows_are_drawn_without_a_copy_of_the_input_per_draw(spark):
    frame = spark.range(4000).selectExpr("id", "cast(id % 7 as string) as name", "nullif(id % 5, 0) as part")
    drawn = profile.random_rows(frame, 140, 3)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence" not in plan and "Sort" not in plan
    least = {}
    for row in frame.collect():
        text = "".join(f"{len(t)}:{t}" for t in ("" if v is None else str(v) for v in row))
        for draw in range(1, 141):
            key = hashlib.md5(f"3:{draw}:{text}".encode()).hexdigest()
            least[draw] = min(least.get(draw, ("g", None)), (key, tuple(row)), key=lambda found: found[0])
    assert sorted(map(str, (tuple(r) for r in drawn.collect()))) == sorted(str(row) for _, row in least.values())

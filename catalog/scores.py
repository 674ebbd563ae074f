"""Queries on curves with given parameters: values, residuals, scale, yields."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    CURVE,
    FIT_ROWS,
    INPUTS,
    NAMES,
    PARAMETERS,
    SCALES,
    check,
    fixed_parameters,
    inputs_of,
    query,
    rounded,
)
from lactoscope.functions import expressions as X
from lactoscope.operators import history, score
from lactoscope.operators.fit import daily_series
from lactoscope.operators.profile import summary

PREDICTED = f"""predicted as (
  select i.*, a, b, c, d, {CURVE} as ecm_est from inputs i join parameters p on i.LAGR = p.LAGR)"""


def predicted(spark, sf_dir):
    return score.predict(inputs_of(spark, sf_dir), fixed_parameters(spark))


def present_groups(spark, sf_dir):
    """The fixed curves of the groups that have input records."""
    groups = inputs_of(spark, sf_dir).groupBy("LAGR").agg(F.max("DIM").alias("last_dim"))
    return groups.join(fixed_parameters(spark), ["LAGR"])


@query(
    check(
        *INPUTS,
        PARAMETERS,
        select=f"""select {NAMES} as grp, LAGR, DIM, round({CURVE}, 6) as ecm_est
from (select * from parameters where LAGR in (select LAGR from inputs)), (select unnest(range(0, 350)) as DIM)
where DIM % 5 = 0""",
    )
)
def group_curves(spark, sf_dir):
    """Curve of each group on every fifth day."""
    curves = score.curves_on_grid(present_groups(spark, sf_dir)).where(F.col("DIM") % 5 == 0)
    return curves.select(X.group_name().alias("grp"), "LAGR", F.col("DIM").cast("bigint").alias("DIM"), F.round("ecm_est", 6).alias("ecm_est"))


@query(
    check(
        *INPUTS,
        PARAMETERS,
        "last as (select BDAT, ID, LACT, LAGR, max(DIM) as last_dim from inputs group by BDAT, ID, LACT, LAGR)",
        select=f"""select BDAT, ID, LACT, DIM, round({CURVE}, 6) as ecm_est
from (select l.*, unnest(range(0, last_dim)) as DIM from last l) l join parameters p on l.LAGR = p.LAGR""",
    )
)
def curves_to_last_day(spark, sf_dir):
    """Curve of each lactation on every day before its last test day."""
    keys = ["BDAT", "ID", "LACT"]
    last = inputs_of(spark, sf_dir).groupBy(*keys, "LAGR").agg(F.max("DIM").alias("last_dim"))
    lactations = last.join(fixed_parameters(spark), ["LAGR"]).drop("last_dim")
    curves = score.curves_to_last_day(lactations, last, [*keys, "LAGR"])
    return curves.select(*keys, F.col("DIM").cast("bigint").alias("DIM"), F.round("ecm_est", 6).alias("ecm_est"))


@query(
    check(
        *INPUTS,
        PARAMETERS,
        PREDICTED,
        select=f"""select BDAT, ID, LACT, {NAMES} as grp, TestDate, DIM, ECM, round(ecm_est, 6) as ecm_est,
  round(ECM - ecm_est, 6) as error from predicted""",
    )
)
def predictions(spark, sf_dir):
    """Group curve and residual beside each record."""
    rows = score.with_residual(predicted(spark, sf_dir)).withColumn("grp", X.group_name())
    return rounded(rows.select("BDAT", "ID", "LACT", "grp", "TestDate", "DIM", "ECM", "ecm_est", "error"))


@query(
    check(
        *INPUTS,
        PARAMETERS,
        PREDICTED,
        select="""select LAGR, 'error' as variable, count(e) as n, round(avg(e), 6) as mean, round(stddev_samp(e), 6) as stddev,
  round(min(e), 6) as lowest, round(max(e), 6) as highest
from (select LAGR, ECM - ecm_est as e from predicted) group by LAGR""",
    )
)
def residual_summary(spark, sf_dir):
    return rounded(summary(score.with_residual(predicted(spark, sf_dir)), ["error"], ["LAGR"]))


@query(
    check(
        *INPUTS,
        PARAMETERS,
        select=f"""select BDAT, ID, LACT, DIM, round(ECM - {CURVE}, 6) as error
from inputs i join parameters p on i.LAGR = p.LAGR where ECM is not null""",
    )
)
def exploded_residuals(spark, sf_dir):
    """Residual series of the lactations: a row for every usable record."""
    keys = ["BDAT", "ID", "LACT"]
    return rounded(score.record_residuals(inputs_of(spark, sf_dir), fixed_parameters(spark), ["LAGR"], keys))


_LACTATION_LOSSES = """quality as (
  select BDAT, ID, LACT, any_value(a) as a, any_value(b) as b, count(*) as npoints, avg((ECM - ecm_est) ^ 2) as mse,
         sqrt(avg((ECM - ecm_est) ^ 2)) as rmse
  from predicted where ECM is not null group by BDAT, ID, LACT)"""


@query(
    check(
        *INPUTS,
        PARAMETERS,
        PREDICTED,
        _LACTATION_LOSSES,
        select="""select BDAT, ID, LACT, npoints, round(mse, 6) as mse, round(rmse, 6) as rmse, rmse > 15 as above_15,
  rmse < 5 as below_5, rmse > 20 as above_20, a > 1 as level_known, b > 20 as slow_rise,
  cast(case when a < 1 then 1 else 0 end as int) as level_too_low
from quality where rmse > 15 or rmse < 5 or b > 20""",
    )
)
def quality_selection(spark, sf_dir):
    """Lactations that the group curve describes well or badly, by rules on the fit."""
    keys = ["BDAT", "ID", "LACT", "a", "b"]
    quality = score.losses(predicted(spark, sf_dir), keys).withColumns(
        {
            "above_15": F.col("rmse") > 15,
            "below_5": F.col("rmse") < 5,
            "above_20": F.col("rmse") > 20,
            "level_known": F.col("a") > 1,
            "slow_rise": F.col("b") > 20,
            "level_too_low": X.level_too_low(),
        }
    )
    chosen = score.select_fits(quality, "rmse > 15 or rmse < 5 or b > 20")
    return rounded(chosen.drop("a", "b", "mae", "mape", "msle"))


@query(
    check(
        *INPUTS,
        PARAMETERS,
        PREDICTED,
        select="""select LAGR, count(*) as npoints, round(avg((ECM - ecm_est) ^ 2), 6) as mse,
  round(sqrt(avg((ECM - ecm_est) ^ 2)), 6) as rmse, round(avg(abs(ECM - ecm_est)), 6) as mae,
  round(avg(abs(ECM - ecm_est) / greatest(abs(ECM), 2.220446049250313e-16)), 6) as mape,
  round(case when min(least(ECM, ecm_est)) >= 0 then avg((ln(1 + greatest(ECM, 0)) - ln(1 + greatest(ecm_est, 0))) ^ 2) end, 6) as msle
from predicted where ECM is not null group by LAGR""",
    )
)
def losses_by_group(spark, sf_dir):
    return rounded(score.losses(predicted(spark, sf_dir), ["LAGR"]))


_START_CURVES = """starts as (
  select BDAT, ID, LACT, max(ECM) as a, cast(10 + LACT as double) as b, cast(min(DIM) as double) as c, 0.001e0 as d
  from inputs where ECM is not null group by BDAT, ID, LACT)"""


@query(
    check(
        *INPUTS,
        _START_CURVES,
        f"""lowest as (select BDAT, ID, LACT, min({CURVE}) as y_min
  from (select s.*, unnest(range(0, 400)) as DIM from starts s) group by BDAT, ID, LACT)""",
        select="""select s.BDAT, s.ID, s.LACT, a, b, c, d, y_min > 0 as positive
from starts s join lowest l on s.BDAT = l.BDAT and s.ID = l.ID and s.LACT = l.LACT""",
    )
)
def positive_curves(spark, sf_dir):
    """Whether a curve from each lactation's peak and first day stays above zero."""
    starts = (
        inputs_of(spark, sf_dir)
        .where(F.col("ECM").isNotNull())
        .groupBy("BDAT", "ID", "LACT")
        .agg(F.max("ECM").alias("a"), F.min("DIM").cast("double").alias("c"))
    )
    starts = starts.withColumn("b", (F.lit(10) + F.col("LACT")).cast("double")).withColumn("d", F.lit(0.001))
    return starts.select("BDAT", "ID", "LACT", "a", "b", "c", "d", X.curve_is_positive().alias("positive"))


_UNION = f"""sums as (
  select LAGR, max(ECM) as peak, count(*) as n from fit_rows group by LAGR
  union all select cast(0 as int), max(ECM), count(*) from fit_rows)"""


@query(check(*INPUTS, FIT_ROWS, _UNION, select=f"select {NAMES} as grp, LAGR, peak, n from sums"))
def herd_and_groups_union(spark, sf_dir):
    """Group rows and a keyless herd row in one relation, duplicates kept."""
    rows = history.fit_records(inputs_of(spark, sf_dir))
    values = [F.max("ECM").alias("peak"), F.count(F.lit(1)).alias("n")]
    herd = rows.agg(*values).select(F.lit(0).alias("LAGR"), "peak", "n")
    both = herd.unionByName(rows.groupBy("LAGR").agg(*values))
    return both.select(X.group_name().alias("grp"), "LAGR", "peak", "n")


@query(
    check(
        *INPUTS,
        FIT_ROWS,
        _UNION,
        PARAMETERS,
        select=f"""select {NAMES} as grp, round(p0, 6) as a, b, c, d from (
  select distinct s.LAGR, peak / 2 as p0, b, c, d from (select * from sums union all select * from sums) s
  join parameters p on s.LAGR = p.LAGR)""",
    )
)
def distinct_parameter_union(spark, sf_dir):
    """Union without duplicates of relations with a parameter array."""
    rows = history.fit_records(inputs_of(spark, sf_dir))
    groups = rows.groupBy("LAGR").agg(F.max("ECM").alias("peak"))
    herd = rows.agg(F.max("ECM").alias("peak")).select(F.lit(0).alias("LAGR"), "peak")

    peaks = groups.unionByName(herd).unionByName(groups)
    arrays = peaks.join(fixed_parameters(spark), ["LAGR"]).select(
        X.group_name().alias("grp"), X.pack(F.col("peak") / 2).alias("p")
    )
    both = arrays.distinct()
    names = ("a", "b", "c", "d")
    return rounded(both.select("grp", *[v.alias(n) for v, n in zip(X.unpack("p"), names)]))


def scaled(spark, sf_dir):
    return score.individual_scale(inputs_of(spark, sf_dir), fixed_parameters(spark))


@query(
    check(
        *INPUTS,
        PARAMETERS,
        SCALES,
        select=f"""select {NAMES} as grp, LAGR, BDAT, ID, LACT, round(geom_mean_ratio, 6) as geom_mean_ratio,
  round(a, 6) as a, b, c, d from scaled""",
    )
)
def individual_scale(spark, sf_dir):
    """Scale of each lactation against its group and the scaled curve."""
    arrays = score.with_parameter_array(scaled(spark, sf_dir))
    unpacked = [v.alias(n) for v, n in zip(X.unpack("parameters"), ("a", "b", "c", "d"))]
    return rounded(arrays.select("grp", "LAGR", "BDAT", "ID", "LACT", "geom_mean_ratio", *unpacked))


@query(
    check(
        *INPUTS,
        PARAMETERS,
        """enough as (select BDAT, ID, LACT from inputs where ECM is not null and ECM > 0
  group by BDAT, ID, LACT having count(*) >= 5)""",
        select="""select i.BDAT, i.ID, i.LACT, TestDate, DIM, ECM from inputs i join enough k
  on i.BDAT = k.BDAT and i.ID = k.ID and i.LACT = k.LACT where ECM is not null and DIM > 5""",
    )
)
def individual_records(spark, sf_dir):
    """The records that individual scaling uses."""
    return history.individual_records(inputs_of(spark, sf_dir)).select("BDAT", "ID", "LACT", "TestDate", "DIM", "ECM")


_YIELDS = f"""select {NAMES} as grp, BDAT, ID, LACT, round(sum({CURVE}), 2) as m305
from (select *, unnest(range(1, 306)) as DIM from scaled) group by LAGR, BDAT, ID, LACT"""


@query(check(*INPUTS, PARAMETERS, SCALES, select=_YIELDS))
def yields_305(spark, sf_dir):
    """305-day yield per lactation in closed form."""
    return rounded(score.yields(scaled(spark, sf_dir), ["grp", "BDAT", "ID", "LACT"]), 2)


@query(check(*INPUTS, PARAMETERS, SCALES, select=_YIELDS))
def yields_305_by_day(spark, sf_dir):
    """305-day yield per lactation as the sum of its days."""
    return rounded(score.yields_by_sum(scaled(spark, sf_dir), ["grp", "BDAT", "ID", "LACT"]), 2)

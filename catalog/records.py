"""Queries on record-level rules: weights, labels, fills, history, trends, quartiles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalog.base import (
    BACKWARD_FIRST,
    ECM,
    FIT_ROWS,
    FORWARD_FIRST,
    INPUTS,
    MEDIAN,
    NAMES,
    RAW,
    TO_FILL_1_399,
    check,
    inputs_of,
    query,
    rounded,
)
from lactoscope.functions import expressions as X
from lactoscope.operators import fit, history, profile, quantiles, trend
from lactoscope.operators.fill import fill_components
from lactoscope.plans import lactation_model, median_model
from lactoscope.settings import Settings
from lactoscope.sources.sample_mapping import mapped_test_days
from lactoscope.sources.tables import rename_test_days


def named(spark, sf_dir):
    events = rename_test_days(mapped_test_days(spark, sf_dir))
    return events.withColumn("TestDate", F.to_date("EventDateTime")).drop("EventDateTime")


def valid(spark, sf_dir):
    return history.valid_yields(named(spark, sf_dir), 1, 399)


@query(
    check(
        *RAW,
        select=f"""select ID, LACT, TestDate, DIM, round({ECM}, 6) as ECM,
  case when PCTF > 0 and PCTP > 0 then round({ECM}, 1) end as ECM_REPORTED
from named where MILK is not null and DIM > 0 and DIM < 400 and PCTF is not null and PCTP is not null""",
    )
)
def energy_corrected_yield(spark, sf_dir):
    rows = history.complete_components(valid(spark, sf_dir))
    return rows.select(
        "ID",
        "LACT",
        "TestDate",
        "DIM",
        F.round(X.energy_corrected(), 6).alias("ECM"),
        X.energy_corrected_reported().alias("ECM_REPORTED"),
    )


@query(
    check(
        *RAW,
        select="""select DIM, count(*) as n, any_value(case when DIM > 30 then 1e0 else 1.5e0 end) as up_to_30,
  any_value(case when DIM > 60 then 1e0 else 1.5e0 end) as up_to_60,
  any_value(case when DIM < 60 then 1.5e0 else 1e0 end) as below_60,
  any_value(case when DIM < 15 then 1.5e0 else 1e0 end) as below_15 from named group by DIM""",
    )
)
def error_weights(spark, sf_dir):
    weights = [
        X.error_sigma().alias("up_to_30"),
        X.error_sigma("DIM", 60).alias("up_to_60"),
        X.error_sigma("DIM", 60, strict=True).alias("below_60"),
        X.error_sigma("DIM", 15, strict=True).alias("below_15"),
    ]
    return named(spark, sf_dir).groupBy("DIM").agg(F.count(F.lit(1)).alias("n")).select("DIM", "n", *weights)


@query(
    check(
        *RAW,
        "coded as (select *, cast(case when LACT >= 4 then 4 else LACT end as int) as LAGR from named)",
        select=f"""select LACT, LAGR, case when LACT < 4 then cast(LACT as varchar) else '4+' end as label,
  {NAMES} as grp, cast(0 as int) as herd_code, count(*) as n from coded group by LACT, LAGR, label, grp""",
    )
)
def lactation_groups(spark, sf_dir):
    rows = named(spark, sf_dir).groupBy("LACT").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("LAGR", X.group_code()).withColumn("label", X.group_label())
    return rows.select("LACT", "LAGR", "label", X.group_name().alias("grp"), F.lit(0).alias("herd_code"), "n")


_FILLED = """select SourceAnimalID, ID, BDAT, LACT, DIM, round(MILK, 6) as MILK,
  round(PCTF, 6) as PCTF, round(PCTP, 6) as PCTP from filled"""


def _filled(frame):
    return rounded(frame.select("SourceAnimalID", "ID", "BDAT", "LACT", "DIM", "MILK", "PCTF", "PCTP"))


@query(check(*RAW, TO_FILL_1_399, FORWARD_FIRST, select=_FILLED))
def filled_forward_first(spark, sf_dir):
    return _filled(fill_components(valid(spark, sf_dir)))


@query(check(*RAW, TO_FILL_1_399, BACKWARD_FIRST, select=_FILLED))
def filled_backward_first(spark, sf_dir):
    return _filled(fill_components(valid(spark, sf_dir), backward_first=True))


@query(
    check(
        *RAW,
        TO_FILL_1_399,
        FORWARD_FIRST,
        "counts as (select BDAT, ID, LACT, count(*) as npoints from filled group by BDAT, ID, LACT having count(*) >= 4)",
        select=f"""select f.BDAT, f.EarTag, f.LACT, DIM, round(MILK, 6) as MILK, round(PCTF, 6) as PCTF,
  round(PCTP, 6) as PCTP, npoints, round({ECM}, 6) as ECM, case when DIM > 30 then 1e0 else 1.5e0 end as SIGMA
from filled f join counts k on f.BDAT = k.BDAT and f.ID = k.ID and f.LACT = k.LACT
where PCTF is not null and PCTP is not null""",
    )
)
def lactation_records(spark, sf_dir):
    """Filled records of lactations with at least four of them, with yield and weight."""
    return rounded(lactation_model.lactation_records(mapped_test_days(spark, sf_dir)))


@query(
    check(
        *INPUTS,
        select="""select BDAT, ID, LACT, count(*) as count from inputs
where ECM is not null and ECM > 0 and DIM >= 200 and DIM < 350 group by BDAT, ID, LACT having count(*) >= 2""",
    )
)
def accepted_lactations(spark, sf_dir):
    """Lactations with enough late test days; the rules are configured text."""
    s = Settings()
    return history.accepted_lactations(inputs_of(spark, sf_dir), (s.accept_ecm, s.accept_dim), s.accept_count)


@query(check(*INPUTS, FIT_ROWS, select="select BDAT, ID, LACT, LAGR, TestDate, DIM, ECM, SIGMA from fit_rows"))
def fit_records(spark, sf_dir):
    rows = history.fit_records(inputs_of(spark, sf_dir)).withColumn("SIGMA", X.error_sigma())
    return rows.select("BDAT", "ID", "LACT", "LAGR", "TestDate", "DIM", "ECM", "SIGMA")


@query(check(*INPUTS, FIT_ROWS, select="select LAGR, count(*) as n from fit_rows group by LAGR"))
def fit_record_counts(spark, sf_dir):
    return history.point_counts(history.fit_records(inputs_of(spark, sf_dir)), ["LAGR"], "n")


@query(check(*MEDIAN, select="select * from bounds"))
def history_bounds(spark, sf_dir):
    return history.history_bounds(median_model.filled_records(mapped_test_days(spark, sf_dir)))


@query(check(*MEDIAN, select="select LAGR, count(*) as n from bounds group by LAGR"))
def long_histories_per_group(spark, sf_dir):
    bounds = median_model.bounds_of(mapped_test_days(spark, sf_dir))
    return history.point_counts(bounds, ["LAGR"], "n")


@query(
    check(
        *MEDIAN,
        select="""select BDAT, ID, LAGR, LACT, DIM, round(MILK, 6) as MILK, round(PCTF, 6) as PCTF,
  round(PCTP, 6) as PCTP, round(ECM, 6) as ECM, SIGMA, DIM_MIN, DIM_MAX from with_history""",
    )
)
def records_with_history(spark, sf_dir):
    return rounded(median_model.records_of(mapped_test_days(spark, sf_dir)))


@query(
    check(
        *MEDIAN,
        select="""select BDAT, ID, LAGR, DIM, round(ECM, 6) as ECM from with_history
where BDAT = date '2015-02-01' and LAGR = '1'""",
    )
)
def selected_birth_date(spark, sf_dir):
    """First lactations of the animals born on one day."""
    rows = median_model.records_of(mapped_test_days(spark, sf_dir))
    chosen = rows.where((F.col("BDAT") == F.lit("2015-02-01").cast("date")) & (F.col("LAGR") == "1"))
    return rounded(chosen.select("BDAT", "ID", "LAGR", "DIM", "ECM"))


@query(
    check(
        *RAW,
        select="""select BDAT, ID, LACT, max(DIM) as last_dim, count(*) as npoints, count(*) < 6 as few_points,
  count(*) > 10 as many_points, max(DIM) < 150 as ends_early, max(DIM) > 300 as ends_late
from named where MILK is not null and DIM > 0 and DIM < 400 group by BDAT, ID, LACT
having max(DIM) < 150 or max(DIM) > 300 or count(*) < 6 or count(*) > 10""",
    )
)
def coverage_selection(spark, sf_dir):
    """Lactations that end early or late, or have few or many test days."""
    n, last = F.col("npoints"), F.col("last_dim")
    flags = {"few_points": n < 6, "many_points": n > 10, "ends_early": last < 150, "ends_late": last > 300}
    rows = history.coverage(valid(spark, sf_dir)).withColumns(flags)
    return rows.where("few_points or many_points or ends_early or ends_late")


def _off_ties(frame, *columns):
    # Few short decimals give results half-way between two roundings; both sides step off.
    return frame.withColumns({c: F.col(c) + 1e-8 for c in columns})


_LATER = """later as (
  select * from (select *, row_number() over (
      partition by BDAT, ID, LACT order by DIM, MILK, PCTF nulls first, PCTP nulls first) as place from to_fill)
  where place > 1),
trends as (
  select BDAT, ID, LACT,
    case when count(PCTF) > 0 then coalesce(nullif(regr_slope(PCTF, DIM), 'nan'::double), 0) end as PCTF_slope,
    case when count(PCTP) > 0 then coalesce(nullif(regr_slope(PCTP, DIM), 'nan'::double), 0) end as PCTP_slope,
    avg(PCTF) as fat, avg(PCTP) as protein,
    avg(DIM) filter (PCTF is not null) as fat_day, avg(DIM) filter (PCTP is not null) as protein_day
  from later group by BDAT, ID, LACT),
lines as (select *, fat - PCTF_slope * fat_day as PCTF_intercept, protein - PCTP_slope * protein_day as PCTP_intercept
  from trends)"""


@query(
    check(
        *RAW,
        TO_FILL_1_399,
        _LATER,
        select="""select k.BDAT, k.ID, k.LACT, round(PCTF_slope + 1e-8, 6) as PCTF_slope,
  round(PCTF_intercept + 1e-8, 6) as PCTF_intercept, round(PCTP_slope + 1e-8, 6) as PCTP_slope,
  round(PCTP_intercept + 1e-8, 6) as PCTP_intercept
from (select distinct BDAT, ID, LACT from to_fill) k left join lines l
  on k.BDAT = l.BDAT and k.ID = l.ID and k.LACT = l.LACT""",
    )
)
def component_trends(spark, sf_dir):
    trends = trend.component_trends(valid(spark, sf_dir))
    return rounded(_off_ties(trends, "PCTF_slope", "PCTF_intercept", "PCTP_slope", "PCTP_intercept"))


@query(
    check(
        *RAW,
        TO_FILL_1_399,
        _LATER,
        select="""select t.SourceAnimalID, t.BDAT, t.ID, t.LACT, DIM, round(MILK, 6) as MILK,
  round(PCTF_intercept + PCTF_slope * DIM + 1e-8, 6) as PCTF_EST,
  round(PCTP_intercept + PCTP_slope * DIM + 1e-8, 6) as PCTP_EST
from to_fill t left join lines l on t.BDAT = l.BDAT and t.ID = l.ID and t.LACT = l.LACT""",
    )
)
def smoothed_components(spark, sf_dir):
    """Components replaced by their trend over the lactation."""
    rows = trend.smooth_components(valid(spark, sf_dir))
    rows = rows.select("SourceAnimalID", "BDAT", "ID", "LACT", "DIM", "MILK", "PCTF_EST", "PCTP_EST")
    return rounded(_off_ties(rows, "PCTF_EST", "PCTP_EST"))


@query(
    check(
        *MEDIAN,
        select="""select LAGR, DIM, round(quantile_disc(ECM, 0.5), 6) as ECM_MEDIAN,
  case when DIM < 15 then 1.5e0 else 1e0 end as SIGMA from with_history group by LAGR, DIM""",
    )
)
def median_curve(spark, sf_dir):
    return rounded(median_model.median_curve(median_model.records_of(mapped_test_days(spark, sf_dir))))


_QUARTILES = """means as (select BDAT, ID, LAGR, avg(ECM) as ecm_avg from with_history group by BDAT, ID, LAGR),
cuts as (select quantile_disc(ecm_avg, 0.25) as q1, quantile_disc(ecm_avg, 0.5) as q2,
  quantile_disc(ecm_avg, 0.75) as q3 from means),
quartiles as (select means.*, case when ecm_avg < q1 then 0e0 when ecm_avg < q2 then 1e0
  when ecm_avg < q3 then 2e0 else 3e0 end as ecm_qtile from means, cuts)"""


@query(
    check(
        *MEDIAN,
        _QUARTILES,
        select="""select q.BDAT, q.ID, q.LAGR, DIM_MIN, DIM_MAX, round(ecm_avg, 6) as ecm_avg, ecm_qtile
from quartiles q join bounds b on q.BDAT = b.BDAT and q.ID = b.ID and q.LAGR = b.LAGR""",
    )
)
def animal_quartiles(spark, sf_dir):
    """Mean yield per animal and its quartile; the error is set below one animal."""
    return rounded(median_model.animal_quartiles(median_model.filled_records(mapped_test_days(spark, sf_dir)), 1e-6))


@query(
    check(
        *MEDIAN,
        _QUARTILES,
        select="""select w.BDAT, w.ID, w.LAGR, w.LACT, DIM, round(w.ECM, 6) as ECM, DIM_MIN, DIM_MAX, ecm_qtile
from with_history w join quartiles q on w.BDAT = q.BDAT and w.ID = q.ID and w.LAGR = q.LAGR""",
    )
)
def records_with_quartile(spark, sf_dir):
    rows = median_model.records_with_quartile(median_model.filled_records(mapped_test_days(spark, sf_dir)), 1e-6)
    return rounded(rows.select("BDAT", "ID", "LAGR", "LACT", "DIM", "ECM", "DIM_MIN", "DIM_MAX", "ecm_qtile"))


_DRAWN = ("SourceAnimalID", "LACT", "DIM", "TestDate")
_DRAW_TEXT = " || ".join(f"length(coalesce({c}::varchar, '')) || ':' || coalesce({c}::varchar, '')" for c in _DRAWN)


@query(
    check(
        *RAW,
        f"texts as (select distinct {', '.join(_DRAWN)}, {_DRAW_TEXT} as text from named where MILK is not null and DIM > 0 and DIM < 400)",
        select=f"""select {', '.join(_DRAWN)} from (
  select draw, unnest(arg_min(struct_pack({', '.join(f'{c} := {c}' for c in _DRAWN)}), md5('23:' || draw || ':' || text)))
  from texts, range(1, 101) d(draw) group by draw)""",
    )
)
def random_records(spark, sf_dir):
    """One hundred draws with replacement, exactly."""
    return profile.random_rows(valid(spark, sf_dir).select(*_DRAWN), 100, 23)


@query(
    check(
        *MEDIAN,
        select="""select LAGR, DIM, round(quantile_disc(ECM, 0.5), 6) as ECM_MEDIAN,
  case when DIM < 15 then 1.5e0 else 1e0 end as SIGMA from with_history group by LAGR, DIM""",
    )
)
def exact_median_curve(spark, sf_dir):
    """Median yield per group and day by rank, without a sketch."""
    return rounded(median_model.exact_medians(median_model.records_of(mapped_test_days(spark, sf_dir))))


@query(
    check(
        *MEDIAN,
        select="""select LAGR, share, round(case share when 0 then min(ECM) when 0.25 then quantile_disc(ECM, 0.25) when 0.9 then quantile_disc(ECM, 0.9) else max(ECM) end, 6) as ECM
from with_history, (values (0e0), (0.25e0), (0.9e0), (1e0)) s(share) group by LAGR, share""",
    )
)
def exact_quantiles_of_groups(spark, sf_dir):
    """Quantiles of all yields of a group, a few groups that hold all rows."""
    records = median_model.records_of(mapped_test_days(spark, sf_dir))
    return rounded(quantiles.exact_quantiles(records, "ECM", [0.0, 0.25, 0.9, 1.0], ["LAGR"]).withColumnRenamed("value", "ECM"))


@query(
    check(
        *MEDIAN,
        "means as (select BDAT, ID, LAGR, avg(ECM) as ecm_avg from with_history group by BDAT, ID, LAGR)",
        select="""select b.bucket, n.n > 0 as within_error, n.n from (values (0e0), (1e0), (2e0), (3e0)) b(bucket), (select count(*) as n from means) n""",
    )
)
def quartiles_at_default_accuracy(spark, sf_dir):
    """Whether each bucket of the default sketch holds a quarter of the animals to its stated error, two cuts each."""
    quartiles = median_model.animal_quartiles(median_model.filled_records(mapped_test_days(spark, sf_dir)))
    counts = quartiles.groupBy(F.col("ecm_qtile").alias("bucket")).agg(F.count(F.lit(1)).alias("held"))
    total = F.sum("held").over(W.partitionBy(F.lit(0)))
    near = F.abs(F.col("held") - total / 4) <= 2 * 0.01 * total + 1
    return counts.select("bucket", near.alias("within_error"), total.alias("n"))


@query(
    check(
        *INPUTS,
        """days as (select BDAT, ID, LACT, DIM, count(*) as n, avg(ECM) as mean from inputs
  where ECM is not null group by BDAT, ID, LACT, DIM)""",
        select="""select BDAT, ID, LACT, string_agg(DIM || ':' || n || ':' || cast(round(mean * 1000) as bigint), ' ' order by DIM)
  as series, count(*) as days from days group by BDAT, ID, LACT""",
    )
)
def daily_series(spark, sf_dir):
    """Series per lactation in day order, as one array and here shown as text."""
    series = fit.daily_series(inputs_of(spark, sf_dir), ["BDAT", "ID", "LACT"])
    shown = F.transform(
        "series", lambda s: F.concat_ws(":", s["DIM"], s["n"], F.round(s["mean"] * 1000).cast("bigint"))
    )
    return series.select("BDAT", "ID", "LACT", F.array_join(shown, " ").alias("series"), F.size("series").cast("bigint").alias("days"))

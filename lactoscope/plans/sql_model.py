"""The group model as SQL text over named relations.

For users who write SQL: the same steps as the DataFrame form, with the model
functions registered in the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lactoscope.functions.sql import register_functions
from lactoscope.settings import GROUP_FIT, FitSettings
from lactoscope.sources.tables import cut_lineage, day_grid, name_relation

FIT_ROWS_SQL = """
select i.*, error_sigma(DIM) as SIGMA
from test_day_inputs i
left semi join (
  select BDAT, ID, LACT from test_day_inputs
  where ECM > 0 and DIM >= 200 and DIM < 350
  group by BDAT, ID, LACT having count(*) >= 2
) late using (BDAT, ID, LACT)
where ECM is not null and DIM < 325
"""

# Records are reduced to days, and days of groups to days of the herd; the fit gets one row per day.
PARAMETERS_SQL = """
with days as (
  select LAGR, DIM, SIGMA, count(*) as n, avg(ECM) as ecm, var_pop(ECM) * count(*) as spread, max(ECM) as peak
  from fit_rows group by LAGR, DIM, SIGMA
), levels as (
  select case when grouping(LAGR) = 1 then 0 else LAGR end as LAGR, DIM as t, double(SIGMA) as sigma, sum(n) as records, sum(n) as n,
         sum(n * ecm) / sum(n) as mean, max(peak) as peak,
         greatest(sum(spread) + sum(n * ecm * ecm) - sum(n * ecm) * sum(n * ecm) / sum(n), 0d) as spread
  from days group by grouping sets ((LAGR, DIM, SIGMA), (DIM, SIGMA))
)
select group_name(LAGR) as grp, LAGR, case when a is not null then array(a, b, c, d) end as parameters, npoints, weighted_sse, status, covariance
from fit_day_points(table(levels) partition by LAGR)
"""

CURVES_SQL = """
select grp, DIM, curve_yield(DIM, parameters) as ecm_est
from (select grp, parameters, explode(sequence(0, 349)) as DIM from curve_parameters)
where DIM % 5 = 0
"""

LACTATIONS_SQL = """
with rows as (
  select p.grp, i.BDAT, i.ID, i.LACT, p.parameters,
         try_divide(i.ECM, curve_yield(i.DIM, p.parameters)) as ratio
  from test_day_inputs i
  left semi join (
    select BDAT, ID, LACT from test_day_inputs where ECM > 0
    group by BDAT, ID, LACT having count(*) >= 5
  ) enough using (BDAT, ID, LACT)
  join curve_parameters p on i.LAGR = p.LAGR
  where i.ECM is not null and i.DIM > 5
), scales as (
  select grp, BDAT, ID, LACT, exp(avg(case when ratio > 0 then ln(ratio) end)) as geom_mean_ratio
  from rows group by grp, BDAT, ID, LACT
)
select s.*, array(geom_mean_ratio * get(parameters, 0), get(parameters, 1),
                  get(parameters, 2), get(parameters, 3)) as scaled_parameters
from scales s join curve_parameters p on s.grp = p.grp
"""

YIELDS_SQL = """
select grp, BDAT, ID, LACT, yield_to_day(305, scaled_parameters) as m305 from lactation_scales
"""

STORED = ("curve_parameters", "lactation_scales")


def sql_group_model(spark: SparkSession, inputs: DataFrame, settings: FitSettings = GROUP_FIT) -> dict[str, DataFrame]:
    """Run the text step by step; each result is also a named relation.

    The fitted curves and the scales are stored, since later steps read them again.
    """
    register_functions(spark, settings)
    name_relation(day_grid(spark), "day_grid")
    name_relation(inputs, "test_day_inputs")
    results = {}
    for name, text in (
        ("fit_rows", FIT_ROWS_SQL),
        ("curve_parameters", PARAMETERS_SQL),
        ("curves", CURVES_SQL),
        ("lactation_scales", LACTATIONS_SQL),
        ("yields", YIELDS_SQL),
    ):
        result = spark.sql(text)
        results[name] = name_relation(cut_lineage(result) if name in STORED else result, name)
    return results

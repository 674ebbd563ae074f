"""Shared parts of the queries and of their checks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lactoscope.operators.selection import SLOTS, qualifying_records
from lactoscope.settings import RunParameters
from lactoscope.sources.sample_mapping import HERD_SQL, TEST_DAY_SQL, mapped_herds, mapped_test_days

RUN = RunParameters(last_run=dt.date(2022, 7, 1))
ONE_HERD = 1

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None):
    """Register a query under its function name, with the SQL that checks it."""

    def register(function):
        QUERIES[function.__name__] = function
        if check is not None:
            CHECKS[function.__name__] = check
        return function

    return register


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = mapped_test_days(spark, sf_dir)
    return events, mapped_herds(spark, events)


def inputs_of(spark: SparkSession, sf_dir: str, run: RunParameters = RUN) -> DataFrame:
    return qualifying_records(*tables(spark, sf_dir), run)


def rounded(frame: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round all doubles, so that the order of summation does not show."""
    return frame.select(
        *[
            F.round(name, special.get(name, digits)).alias(name) if kind == "double" else F.col(name)
            for name, kind in frame.dtypes
        ]
    )


# Fixed curve per group for queries that need parameters but no fit.
PARAMETER_ROWS = (
    (0, 70.0, 14.0, 0.5, 0.0012),
    (1, 54.0, 10.0, -5.0, 0.0011),
    (2, 62.5, 22.0, -1.5, 0.00125),
    (3, 69.5, 21.0, -2.0, 0.0012),
    (4, 80.5, 19.0, -0.25, 0.0012),
)


def fixed_parameters(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({g}, {a}d, {b}d, {c}d, {d}d)" for g, a, b, c, d in PARAMETER_ROWS)
    return spark.sql(f"select * from values {rows} as t(LAGR, a, b, c, d)")


_PARAMETER_VALUES = ", ".join(
    f"(cast({g} as int), {a}::double, {b}::double, {c}::double, {d}::double)" for g, a, b, c, d in PARAMETER_ROWS
)

# Building blocks of the checks, as common table expressions.
ECM = "(MILK * (0.383e0 * PCTF + 0.242e0 * PCTP + 0.7832e0) / 3.1138e0)"
CURVE = "(a * (1e0 - exp((c - DIM) / b) / 2e0) * exp(-d * DIM))"

TEST_DAY = "testday as ({})".format(TEST_DAY_SQL.format(lineitem="lineitem", orders="orders", customer="customer"))
HERD = "herd as ({})".format(HERD_SQL.format(testday="testday"))

NAMED = """named as (
  select SourceCode, SourceHerdID, SourceAnimalID, EarTag, EarTag as ID, LactationNumber as LACT, BirthDate as BDAT,
         FreshDate as FDAT, cast(EventDateTime as date) as TestDate, DIM, MilkWeight as MILK,
         PercentFat as PCTF, PercentProtein as PCTP
  from testday)"""


def primary(lookback: str = "LastTestDayEventDate - interval 36 month") -> str:
    return f"""valid as (
  select n.SourceCode, n.SourceHerdID, LastTestDayEventDate, SourceAnimalID, ID, LACT,
         cast(case when LACT >= 4 then 4 else LACT end as int) as LAGR, BDAT, FDAT, TestDate, DIM, MILK,
         case when PCTF > 0 and PCTP > 0 then round({ECM}, 1) end as ECM, PCTF, PCTP
  from named n join herd h on n.SourceCode = h.SourceCode and n.SourceHerdID = h.SourceHerdID
  where LastTestDayEventDate > date '{RUN.last_run}' and TestDate >= {lookback}
    and LACT > 0 and MILK is not null and DIM between 5 and 350),
ptd as (
  select *, cast(ntile(100) over (
      partition by SourceCode, SourceHerdID, TestDate, LAGR
      order by DIM, SourceAnimalID % {SLOTS}, SourceAnimalID, LACT, MILK, PCTF nulls first, PCTP nulls first
    ) as int) as PercentileDIM,
    percent_rank() over (partition by SourceCode, SourceHerdID, TestDate, LAGR order by DIM) as RankDIM
  from valid)"""


def selected(rule: str = "PercentileDIM <= 90") -> str:
    return f"""dates as (
  select SourceCode, SourceHerdID, TestDate, count(*) as N from ptd where {rule}
  group by SourceCode, SourceHerdID, TestDate having count(*) >= 20),
inputs as (
  select p.* from ptd p join dates s
    on p.SourceCode = s.SourceCode and p.SourceHerdID = s.SourceHerdID and p.TestDate = s.TestDate
  where {rule})"""


FIT_ROWS = """fit_rows as (
  select i.*, case when DIM > 30 then 1e0 else 1.5e0 end as SIGMA from inputs i
  join (select BDAT, ID, LACT from inputs where ECM is not null and ECM > 0 and DIM >= 200 and DIM < 350
        group by BDAT, ID, LACT having count(*) >= 2) k
    on i.BDAT = k.BDAT and i.ID = k.ID and i.LACT = k.LACT
  where i.ECM is not null and i.DIM < 325)"""

PARAMETERS = f"parameters as (select * from (values {_PARAMETER_VALUES}) as t(LAGR, a, b, c, d))"
NAMES = """(case LAGR when 0 then 'HERD' when 1 then 'LAGR_1' when 2 then 'LAGR_2'
            when 3 then 'LAGR_3' when 4 then 'LAGR_4' end)"""


def _fill(first: str, second: str) -> str:
    # first and second are window calls with {c} for the column in question.
    def step(c: str, call: str, source: str) -> str:
        return call.format(c=c, source=source)

    return f"""once as (
  select *, {step('PCTF', first, 'PCTF')} as PCTF_1, {step('PCTP', first, 'PCTP')} as PCTP_1 from to_fill),
twice as (
  select *, {step('PCTF', second, 'PCTF_1')} as PCTF_2, {step('PCTP', second, 'PCTP_1')} as PCTP_2 from once),
filled as (
  select * exclude (PCTF, PCTP, PCTF_1, PCTP_1, PCTF_2, PCTP_2), PCTF_2 as PCTF, PCTP_2 as PCTP from twice)"""


_BEFORE = (
    "last_value({{source}} ignore nulls) over (partition by BDAT, ID, LACT order by DIM, {{c}} asc nulls {0} "
    "rows between unbounded preceding and current row)"
)
_AFTER = (
    "first_value({{source}} ignore nulls) over (partition by BDAT, ID, LACT order by DIM, {{c}} asc nulls {0} "
    "rows between current row and unbounded following)"
)
FORWARD_FIRST = _fill(_BEFORE.format("last"), _AFTER.format("last"))
BACKWARD_FIRST = _fill(_AFTER.format("first"), _BEFORE.format("first"))

TO_FILL_1_399 = "to_fill as (select * from named where MILK is not null and DIM > 0 and DIM < 400)"
TO_FILL_ALL = "to_fill as (select * from named where MILK is not null and DIM is not null)"

# Records of the median model: filled, complete, with labels.
LABELLED = f"""labelled as (
  select BDAT, ID, case when LACT < 4 then cast(LACT as varchar) else '4+' end as LAGR, LACT, MILK, DIM, PCTF, PCTP,
         {ECM} as ECM, case when DIM > 30 then 1e0 else 1.5e0 end as SIGMA
  from filled where PCTF is not null and PCTP is not null),
bounds as (
  select BDAT, ID, LAGR, min(DIM) as DIM_MIN, max(DIM) as DIM_MAX from labelled group by BDAT, ID, LAGR
  having min(DIM) >= 0 and max(DIM) >= 200 and max(DIM) < 350),
with_history as (
  select l.*, DIM_MIN, DIM_MAX from labelled l join bounds b
    on l.BDAT = b.BDAT and l.ID = b.ID and l.LAGR = b.LAGR)"""


SCALES = f"""enough as (select BDAT, ID, LACT from inputs where ECM is not null and ECM > 0
  group by BDAT, ID, LACT having count(*) >= 5),
scales as (
  select i.LAGR, i.BDAT, i.ID, i.LACT, exp(avg(case when ECM / {CURVE} > 0 then ln(ECM / {CURVE}) end)) as geom_mean_ratio
  from inputs i join enough k on i.BDAT = k.BDAT and i.ID = k.ID and i.LACT = k.LACT
  join parameters p on i.LAGR = p.LAGR
  where ECM is not null and DIM > 5 group by i.LAGR, i.BDAT, i.ID, i.LACT),
scaled as (select s.*, geom_mean_ratio * a as a, b, c, d from scales s join parameters p on s.LAGR = p.LAGR)"""


def check(*parts: str, select: str) -> str:
    return "with " + ",\n".join(parts) + "\n" + select


RAW = (TEST_DAY, NAMED)
PRIMARY = (TEST_DAY, HERD, NAMED, primary())
INPUTS = (*PRIMARY, selected())
MEDIAN = (*RAW, TO_FILL_ALL, FORWARD_FIRST, LABELLED)

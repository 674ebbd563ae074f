"""Queries on sources and on the selection of input records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog.base import (
    HERD,
    INPUTS,
    NAMED,
    ONE_HERD,
    PRIMARY,
    RAW,
    RUN,
    TEST_DAY,
    check,
    inputs_of,
    primary,
    query,
    rounded,
    selected,
    tables,
)
from lactoscope.operators import profile
from lactoscope.operators.selection import (
    herds_due as due_herds,
)
from lactoscope.operators.selection import (
    primary_records as primary_of,
)
from lactoscope.operators.selection import (
    qualifying_records as qualifying_of,
)
from lactoscope.operators.selection import (
    selected_test_dates as dates_of,
)
from lactoscope.operators.selection import (
    with_percentile,
)
from lactoscope.settings import RunParameters, Settings
from lactoscope.sources.sample_mapping import mapped_test_days
from lactoscope.sources.tables import (
    LACTATIONS_CSV,
    name_relation,
    read_csv,
    read_herds,
    read_query,
    read_test_days,
    rename_test_days,
    shared_folder,
    write_csv,
    write_result,
)

INPUT_COLUMNS = """SourceCode, SourceHerdID, LastTestDayEventDate, SourceAnimalID, ID, LACT, LAGR, BDAT, FDAT, TestDate,
  DIM, round(MILK, 6) as MILK, ECM, round(PCTF, 6) as PCTF, round(PCTP, 6) as PCTP"""


@query(
    check(
        *RAW,
        select="""select SourceCode, SourceHerdID, SourceAnimalID, ID, LACT, BDAT, FDAT, TestDate, DIM,
  round(MILK, 6) as MILK, round(PCTF, 6) as PCTF, round(PCTP, 6) as PCTP from named""",
    )
)
def source_test_days(spark, sf_dir):
    events = rename_test_days(mapped_test_days(spark, sf_dir))
    return rounded(events.withColumn("TestDate", F.to_date("EventDateTime")).drop("EventDateTime"))


@query(check(TEST_DAY, HERD, select="select * from herd"))
def source_herds(spark, sf_dir):
    return tables(spark, sf_dir)[1]


@query(check(*RAW, select="""select BDAT, LACT, round(MILK, 6) as MILK, DIM, round(PCTF, 6) as PCTF,
  round(PCTP, 6) as PCTP from named"""))
def csv_round_trip(spark, sf_dir):
    """Records written to CSV in the shared folder and read back with their schema."""
    rows = rename_test_days(mapped_test_days(spark, sf_dir))
    path = shared_folder(spark)
    write_csv(rows.select(*LACTATIONS_CSV.fieldNames()), path)
    return rounded(read_csv(spark, path, LACTATIONS_CSV))


@query(
    check(
        TEST_DAY,
        HERD,
        NAMED,
        select=f"""select h.LastTestDayEventDate, n.LACT, count(*) as n, round(sum(MILK), 2) as milk
from named n join herd h on n.SourceCode = h.SourceCode and n.SourceHerdID = h.SourceHerdID
where n.SourceHerdID = {ONE_HERD} group by h.LastTestDayEventDate, n.LACT""",
    )
)
def stored_table_round_trip(spark, sf_dir):
    """Both tables stored by herd, then read back for one herd."""
    events, herds = tables(spark, sf_dir)
    event_path, herd_path = shared_folder(spark), shared_folder(spark)
    write_result(events, event_path, ["SourceHerdID"])
    write_result(herds, herd_path)
    rows = rename_test_days(read_test_days(spark, event_path, "parquet", ONE_HERD))
    joined = rows.join(read_herds(spark, herd_path), ["SourceCode", "SourceHerdID"])
    return joined.groupBy("LastTestDayEventDate", "LACT").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("MILK"), 2).alias("milk")
    )


@query(
    check(
        *INPUTS,
        select=f"""select LAGR, count(*) as n, round(avg(ECM), 6) as ecm from inputs
where SourceHerdID = {ONE_HERD} and DIM >= 60 group by LAGR""",
    )
)
def named_relation_with_parameters(spark, sf_dir):
    """A named relation read by configured text with typed parameters."""
    name_relation(inputs_of(spark, sf_dir), "named_inputs")
    return read_query(
        spark,
        """select LAGR, count(*) as n, round(avg(ECM), 6) as ecm from named_inputs
           where SourceHerdID = :herd and DIM >= :first_day group by LAGR""",
        herd=ONE_HERD,
        first_day=60,
    )


@query(check(TEST_DAY, HERD, select=f"select * from herd where LastTestDayEventDate > date '{RUN.last_run}'"))
def herds_due(spark, sf_dir):
    return due_herds(tables(spark, sf_dir)[1], RUN)


@query(check(*PRIMARY, select=f"select {INPUT_COLUMNS}, PercentileDIM from ptd"))
def primary_records(spark, sf_dir):
    """Valid records with their percentile of days in milk, before the trim."""
    return rounded(with_percentile(primary_of(*tables(spark, sf_dir), RUN)))


@query(check(*INPUTS, select="select * from dates"))
def selected_test_dates(spark, sf_dir):
    return dates_of(primary_of(*tables(spark, sf_dir), RUN))


@query(check(*INPUTS, select=f"select {INPUT_COLUMNS}, PercentileDIM from inputs"))
def qualifying_records(spark, sf_dir):
    """The input relation of the group model, for all herds due."""
    return rounded(inputs_of(spark, sf_dir))


@query(check(*INPUTS, select=f"select {INPUT_COLUMNS}, PercentileDIM from inputs where SourceHerdID = {ONE_HERD}"))
def qualifying_records_one_herd(spark, sf_dir):
    return rounded(inputs_of(spark, sf_dir, RunParameters(RUN.last_run, ONE_HERD)))


@query(
    check(
        TEST_DAY,
        HERD,
        NAMED,
        primary("LastTestDayEventDate - 1095"),
        selected("RankDIM <= 0.9e0"),
        select=f"select {INPUT_COLUMNS}, round(RankDIM, 6) as PercentileDIM from inputs",
    )
)
def qualifying_records_percent_rank(spark, sf_dir):
    """The older rules: percent rank, and a look-back counted in days."""
    records = qualifying_of(*tables(spark, sf_dir), RUN, Settings(lookback_days=1095), "percent_rank")
    return rounded(records)


@query(
    check(
        *INPUTS,
        select="""select BDAT, ID, LAGR, LACT, DIM, round(MILK, 6) as MILK, ECM from inputs
order by BDAT, ID, LAGR, LACT, DIM, MILK limit 100""",
    )
)
def first_sorted_records(spark, sf_dir):
    """The first records in the order of the sort keys."""
    order = [*Settings().sort_keys, "MILK"]
    return rounded(profile.first_rows(inputs_of(spark, sf_dir).select(*order, "ECM"), order, 100))


@query(
    check(
        *INPUTS,
        select="""select 'test_days' as relation, count(*) as n from named
union all select 'primary', count(*) from ptd union all select 'dates', count(*) from dates
union all select 'inputs', count(*) from inputs""",
    )
)
def row_counts(spark, sf_dir):
    events, herds = tables(spark, sf_dir)
    records = primary_of(events, herds, RUN)
    stages = {
        "test_days": events,
        "primary": records,
        "dates": dates_of(records),
        "inputs": qualifying_of(events, herds, RUN),
    }
    counts = [f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n") for name, f in stages.items()]
    return reduce(lambda x, y: x.unionByName(y), counts)


@query(
    check(
        *INPUTS,
        select="""select count(*) as N, count(*) filter (MILK is null) as milk_null,
  count(*) filter (ECM is null) as ecm_null, count(*) filter (PCTF is null) as pctf_null,
  count(*) filter (PCTP is null) as pctp_null from inputs""",
    )
)
def null_profile(spark, sf_dir):
    return profile.null_profile(inputs_of(spark, sf_dir))


def _summary_part(column: str) -> str:
    return f"""select LAGR, '{column}' as variable, count({column}) as n, round(avg({column}), 6) as mean,
  round(stddev_samp({column}), 6) as stddev, round(min({column})::double, 6) as lowest,
  round(max({column})::double, 6) as highest from inputs group by LAGR"""


@query(check(*INPUTS, select=" union all ".join(_summary_part(c) for c in ("DIM", "MILK", "ECM", "PCTF", "PCTP"))))
def summary_statistics(spark, sf_dir):
    return rounded(profile.summary(inputs_of(spark, sf_dir), ["DIM", "MILK", "ECM", "PCTF", "PCTP"], ["LAGR"]))

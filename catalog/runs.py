"""Queries on runs that take in only what is new, and on catalog tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from catalog.base import ECM, HERD, NAMED, TEST_DAY, check, query, selected, tables
from lactoscope.plans.incremental import StoredModel, points_by_group, update
from lactoscope.sources.sample_mapping import mapped_herds
from lactoscope.sources.tables import cut_lineage, replace_in_table, shared_folder

# After this date two of the five herds have no test day.
CUT = dt.date(2022, 12, 15)

_ALL_HERDS = f"""valid as (
  select n.SourceCode, n.SourceHerdID, SourceAnimalID, ID, LACT, cast(case when LACT >= 4 then 4 else LACT end as int) as LAGR, BDAT, TestDate, DIM,
    MILK, case when PCTF > 0 and PCTP > 0 then round({ECM}, 1) end as ECM, PCTF, PCTP
  from named n join herd h on n.SourceCode = h.SourceCode and n.SourceHerdID = h.SourceHerdID
  where TestDate >= LastTestDayEventDate - interval 36 month and LACT > 0 and MILK is not null and DIM between 5 and 350),
ptd as (
  select *, cast(ntile(100) over (partition by SourceCode, SourceHerdID, TestDate, LAGR
    order by DIM, SourceAnimalID % 61, SourceAnimalID, LACT, MILK, PCTF nulls first, PCTP nulls first) as int) as PercentileDIM from valid)"""
_HERD_ROWS = """fit_rows as (
  select i.*, case when DIM > 30 then 1e0 else 1.5e0 end as SIGMA from inputs i
  join (select SourceHerdID, BDAT, ID, LACT from inputs where ECM is not null and ECM > 0 and DIM >= 200 and DIM < 350
        group by all having count(*) >= 2) k
    on i.SourceHerdID = k.SourceHerdID and i.BDAT = k.BDAT and i.ID = k.ID and i.LACT = k.LACT
  where i.ECM is not null and i.DIM < 325),
levels as (select SourceHerdID, LAGR, DIM, SIGMA, ECM from fit_rows union all select SourceHerdID, cast(0 as int), DIM, SIGMA, ECM from fit_rows)"""


def _two_runs(spark, sf_dir):
    """A model brought up to the cut date and then up to the end, with its files after each run."""
    events, herds = tables(spark, sf_dir)
    events, model, files = cut_lineage(events), StoredModel(shared_folder(spark)), []
    first = events.where(F.to_date("EventDateTime") <= F.lit(CUT))
    for rows in (first, events):
        update(rows, mapped_herds(spark, rows), model)
        found = spark.read.parquet(f"{model.folder}/points")
        files.append(cut_lineage(found.groupBy("SourceHerdID").agg(F.max("_metadata.file_path").alias("file"), F.max("_metadata.file_modification_time").alias("written"))))
    return model, files


@query(
    check(
        TEST_DAY, HERD, NAMED, _ALL_HERDS, selected(), _HERD_ROWS,
        select="""select SourceHerdID, LAGR, DIM as t, count(*) as n, round(sum(ECM), 1) as total, round(sum(ECM * ECM), 2) as squares, max(ECM) as peak
from levels group by all""",
    )
)
def incremental_points(spark, sf_dir):
    """Points of every herd and group after two runs; they equal those of one run over everything."""
    model, _ = _two_runs(spark, sf_dir)
    # Sums of yields with one decimal have no half-way roundings, as means would.
    total, squares = F.col("n") * F.col("mean"), F.col("spread") + F.col("n") * F.col("mean") * F.col("mean")
    points = points_by_group(model.points(spark))
    return points.select("SourceHerdID", "LAGR", "t", "n", F.round(total, 1).alias("total"), F.round(squares, 2).alias("squares"), "peak")


@query(
    check(
        TEST_DAY, NAMED,
        select=f"""select SourceHerdID, max(TestDate) > date '{CUT}' as replaced, max(TestDate) as mark from named group by SourceHerdID""",
    )
)
def incremental_files(spark, sf_dir):
    """Herds whose stored points the second run replaced, and every herd's mark after it."""
    model, (before, after) = _two_runs(spark, sf_dir)
    was = before.withColumnsRenamed({"file": "file_before", "written": "written_before"})
    same = (F.col("file") == F.col("file_before")) & (F.col("written") == F.col("written_before"))
    both = after.join(was, "SourceHerdID", "left").select("SourceHerdID", (~F.coalesce(same, F.lit(False))).alias("replaced"))
    return both.join(model.marks(spark).select("SourceHerdID", "mark"), "SourceHerdID")


@query(
    check(
        TEST_DAY, NAMED,
        select=f"""select SourceHerdID, LACT, count(*) filter (SourceHerdID = 1 or TestDate <= date '{CUT}') as n from named group by all having n > 0""",
    )
)
def catalog_table_replaced_for_one_herd(spark, sf_dir):
    """A catalog table of counts, of which the rows of one herd are replaced."""
    events, _ = tables(spark, sf_dir)
    name = f"lactation_counts_{uuid.uuid4().hex}"
    counts = events.groupBy("SourceHerdID", F.col("LactationNumber").alias("LACT"))
    early = events.where(F.to_date("EventDateTime") <= F.lit(CUT)).groupBy("SourceHerdID", F.col("LactationNumber").alias("LACT"))
    replace_in_table(early.agg(F.count(F.lit(1)).alias("n")), name, ["SourceHerdID"])
    table = replace_in_table(counts.agg(F.count(F.lit(1)).alias("n")).where("SourceHerdID = 1"), name, ["SourceHerdID"])
    found = cut_lineage(table)
    spark.sql(f"drop table {name}")
    return found

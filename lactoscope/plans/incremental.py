"""Group model of all herds, kept up to date by runs that read only what is new.

A run knows each herd's high-water mark, the last test date it has taken in. Of a herd with
a later test day it reads the events after the mark, selects the qualifying records of
their test dates and reduces them to points per test date, lactation and day. Selection
goes by test date alone, so dates taken in before need not be read again. The new points
join the herd's stored ones, those that have left the look-back period drop out, and the
herd's curves are fitted anew from all of them.

Points, curves and marks are partitioned by herd, and a run replaces the partitions of the
herds that are due; other herds' files stay as they are. Marks are written last. A run that
was cut short leaves points later than the mark behind, which the next run drops and reads
anew, so nothing counts twice.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lactoscope.functions.expressions import error_sigma, group_name
from lactoscope.operators.fit import FIT_FIELDS, accept_days, fit_points, lactation_days, merge_points, with_herd_level
from lactoscope.operators.selection import qualifying_records
from lactoscope.settings import RunParameters, Settings
from lactoscope.sources.tables import cut_lineage, read_or_empty, replace_partitions

BY = ("SourceCode", "SourceHerdID")
_HERD = [T.StructField(c, T.IntegerType()) for c in BY]
_POINTS = T.StructType(
    [
        T.StructField("BDAT", T.DateType()),
        T.StructField("ID", T.StringType()),
        T.StructField("LACT", T.IntegerType()),
        T.StructField("LAGR", T.IntegerType()),
        T.StructField("TestDate", T.DateType()),
        T.StructField("t", T.IntegerType()),
        T.StructField("sigma", T.DoubleType()),
        T.StructField("records", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("spread", T.DoubleType()),
        T.StructField("peak", T.DoubleType()),
        T.StructField("accepted_rows", T.LongType()),
        *_HERD,
    ]
)
_MARKS = T.StructType([T.StructField("mark", T.DateType()), *_HERD])
_CURVES = T.StructType([T.StructField("LAGR", T.IntegerType()), *FIT_FIELDS, T.StructField("grp", T.StringType()), *_HERD])
# Earlier than any test day, for herds without a mark.
_NEVER = dt.date(1950, 1, 1)


@dataclass(frozen=True)
class StoredModel:
    """Where the points, curves and marks of all herds are kept."""

    folder: str

    def points(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, f"{self.folder}/points", _POINTS)

    def marks(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, f"{self.folder}/marks", _MARKS)

    def curves(self, spark: SparkSession) -> DataFrame:
        """Fitted curve of each herd and of each of its lactation groups."""
        return read_or_empty(spark, f"{self.folder}/curves", _CURVES)


def due_herds(herds: DataFrame, marks: DataFrame) -> DataFrame:
    """Herds with a test day after their mark, which comes along; herds without one are new."""
    mark = F.coalesce("mark", F.lit(_NEVER)).alias("mark")
    return herds.join(marks, list(BY), "left").select(*herds.columns, mark).where(F.col("LastTestDayEventDate") > F.col("mark"))


def new_points(events: DataFrame, due: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Points per test date, lactation and day of the events after their herd's mark.

    No event before the earliest mark is needed, and that bound reaches the scan.
    """
    earliest = due.agg(F.min("mark")).scalar()
    later = events.where(F.to_date("EventDateTime") > earliest).join(due.select(*BY, "mark"), list(BY))
    later = later.where(F.to_date("EventDateTime") > F.col("mark")).select(*events.columns)
    rows = qualifying_records(later, due.drop("mark"), RunParameters(_NEVER), settings)
    return lactation_days(rows.withColumn("SIGMA", error_sigma()), "LAGR", settings, [*BY, "TestDate"])


def _in_look_back(date: Column, last: Column, settings: Settings) -> Column:
    if settings.lookback_days is None:
        return date >= F.add_months(last, -settings.lookback_months)
    return date >= F.date_sub(last, settings.lookback_days)


def points_by_group(points: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Stored points as the points of each herd's groups, and of the herd as group 0."""
    lactation = [*BY, *settings.lactation_keys]
    keys = [*lactation, "LAGR"]
    # Dealt by lactation, so that its days are merged and then accepted where they are.
    days = merge_points(points.repartition(*lactation), keys, [F.sum("accepted_rows").alias("accepted_rows")])
    return with_herd_level(accept_days(days, "LAGR", settings, BY), BY)


def update(events: DataFrame, herds: DataFrame, model: StoredModel, settings: Settings = Settings()) -> None:
    """Take in what is new and replace the points, curves and marks of the herds due."""
    spark = events.sparkSession
    due = cut_lineage(due_herds(herds, model.marks(spark)))
    last = F.col("LastTestDayEventDate")
    known = model.points(spark).join(due.select(*BY, "LastTestDayEventDate", "mark"), list(BY))
    known = known.where((F.col("TestDate") <= F.col("mark")) & _in_look_back(F.col("TestDate"), last, settings))
    fresh = new_points(events, due, settings)
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in _POINTS]
    # Stored first, as the partitions that are read are the ones that are replaced.
    points = cut_lineage(known.select(*columns).unionByName(fresh.select(*columns)))
    curves = fit_points(points_by_group(points, settings), [*BY, "LAGR"], settings.fit).withColumn("grp", group_name("LAGR"))
    replace_partitions(points, f"{model.folder}/points", BY)
    replace_partitions(curves.select(*[f.name for f in _CURVES]), f"{model.folder}/curves", BY)
    replace_partitions(due.select(last.alias("mark"), *BY), f"{model.folder}/marks", BY)

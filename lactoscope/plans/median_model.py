"""Median model: curves through the median yield per lactation group and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lactoscope.functions.expressions import energy_corrected, error_sigma, group_label
from lactoscope.operators.fill import fill_components
from lactoscope.operators.fit import fit_records_by
from lactoscope.operators.history import (
    complete_components,
    history_bounds,
    history_columns,
    long_enough,
    valid_yields,
    with_history_bounds,
)
from lactoscope.operators.profile import mean_of, median_by_day, quantile_buckets
from lactoscope.operators.quantiles import exact_quantiles
from lactoscope.settings import EARLY_MEDIAN_FIT, GROUP_FIT, FitSettings
from lactoscope.sources.tables import cut_lineage, rename_test_days

KEYS = ("BDAT", "ID", "LAGR")
MEDIAN_SIGMA_DAYS = 15


def filled_records(events: DataFrame) -> DataFrame:
    """Filled test days with yield, error weight and group label."""
    rows = valid_yields(rename_test_days(events), None, None).withColumn("LAGR", group_label())
    rows = complete_components(fill_components(rows))
    return rows.select("BDAT", "ID", "LAGR", "LACT", "MILK", "DIM", "PCTF", "PCTP").withColumns(
        {"ECM": energy_corrected(), "SIGMA": error_sigma()}
    )


def bounds_of(events: DataFrame) -> DataFrame:
    """History bounds of the filled records, found without filling them.

    A lactation is complete after filling if each component is known at least
    once, and else has no complete record at all.
    """
    rows = valid_yields(rename_test_days(events), None, None).withColumn("LAGR", group_label())
    lactations = rows.groupBy(*KEYS, "LACT").agg(
        *history_columns(), F.count("PCTF").alias("fat"), F.count("PCTP").alias("protein")
    )
    known = lactations.where((F.col("fat") > 0) & (F.col("protein") > 0))
    return (
        known.groupBy(*KEYS)
        .agg(F.min("DIM_MIN").alias("DIM_MIN"), F.max("DIM_MAX").alias("DIM_MAX"))
        .where(long_enough())
    )


def records_with_history(records: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Records of animals with long enough history; ``bounds`` saves a pass over the fills."""
    bounds = history_bounds(records, KEYS) if bounds is None else bounds
    return with_history_bounds(records, bounds, KEYS)


def records_of(events: DataFrame) -> DataFrame:
    """Filled records of animals with long enough history."""
    return records_with_history(filled_records(events), bounds_of(events))


def median_curve(records: DataFrame) -> DataFrame:
    """Median yield per group and day with its own error weight.

    This and the fits take records that have passed the history rule.
    """
    medians = median_by_day(records)
    return medians.withColumn("SIGMA", error_sigma("DIM", MEDIAN_SIGMA_DAYS, strict=True))


def fit_median_curve(records: DataFrame, settings: FitSettings = GROUP_FIT, weighted: bool = True) -> DataFrame:
    medians = median_curve(records)
    if not weighted:
        medians = medians.withColumn("SIGMA", F.lit(1.0))
    return fit_records_by(medians, ["LAGR"], settings, value="ECM_MEDIAN")


def fit_wide_median_curve(records: DataFrame) -> DataFrame:
    """The unweighted fit on wide bounds."""
    return fit_median_curve(records, EARLY_MEDIAN_FIT, weighted=False)


def fit_all_records(records: DataFrame, settings: FitSettings = GROUP_FIT) -> DataFrame:
    return fit_records_by(records, ["LAGR"], settings)


def animal_quartiles(records: DataFrame, relative_error: float = 0.01) -> DataFrame:
    """Animals with long enough history, in four buckets of mean yield.

    This and the next take filled records of all animals.
    """
    # Means and bounds come from one aggregation; records without a key are no animal's.
    means = records.dropna(subset=list(KEYS)).groupBy(*KEYS).agg(*history_columns(), mean_of("ECM")).where(long_enough())
    # One row per animal, read twice: for the cut points and for the buckets.
    return quantile_buckets(cut_lineage(means), "ecm_avg", 4, relative_error, "ecm_qtile")


def exact_medians(records: DataFrame) -> DataFrame:
    """Exact median yield per group and day, with its error weight."""
    found = exact_quantiles(records, "ECM", [0.5], ["LAGR", "DIM"]).withColumnRenamed("value", "ECM_MEDIAN")
    return found.drop("share").withColumn("SIGMA", error_sigma("DIM", MEDIAN_SIGMA_DAYS, strict=True))


def records_with_quartile(records: DataFrame, relative_error: float = 0.01) -> DataFrame:
    """Records beside the yield quartile of their animal."""
    quartiles = animal_quartiles(records, relative_error).select(*KEYS, "DIM_MIN", "DIM_MAX", "ecm_qtile")
    return records.join(quartiles, list(KEYS))

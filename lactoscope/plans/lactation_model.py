"""Lactation model: one curve per animal and lactation, with fit statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lactoscope.functions.expressions import energy_corrected, error_sigma
from lactoscope.operators.fill import fill_components
from lactoscope.operators.fit import day_points, fit_points, fit_records_by
from lactoscope.operators.history import complete_components, point_counts, valid_yields, with_point_count
from lactoscope.operators.score import predict_each, with_residual
from lactoscope.settings import HERD_FILE_FIT, LACTATION_FIT, SINGLE_ANIMAL_FIT, FitSettings
from lactoscope.sources.tables import rename_test_days

KEYS = ("BDAT", "EarTag", "LACT")


def filled_lactations(events: DataFrame) -> DataFrame:
    """Test days 1 to 399 with filled components, before any count rule.

    Records without birth date, animal or lactation belong to no lactation and go.
    """
    rows = valid_yields(rename_test_days(events, animal="EarTag"), 1, 399).dropna(subset=list(KEYS))
    return fill_components(rows, KEYS).select(*KEYS, "MILK", "DIM", "PCTF", "PCTP")


def lactation_records(events: DataFrame, at_least: int = 4) -> DataFrame:
    """Usable test days of lactations with enough of them.

    Records are counted before those without known components are left out, and
    so before filling, which neither adds nor drops any.
    """
    counts = point_counts(valid_yields(rename_test_days(events, animal="EarTag"), 1, 399), KEYS)
    rows = complete_components(with_point_count(filled_lactations(events), KEYS, at_least, counts))
    return rows.withColumns({"ECM": energy_corrected(), "SIGMA": error_sigma()})


def fit_lactations(events: DataFrame, settings: FitSettings = LACTATION_FIT) -> DataFrame:
    """Fit of every lactation with enough records and some usable value.

    The count rule is applied to the records per lactation that the day points
    carry along, so no record has to be joined to its lactation's count.
    """
    rows = filled_lactations(events).withColumns({"ECM": energy_corrected(), "SIGMA": error_sigma()})
    fits = fit_points(day_points(rows, KEYS), KEYS, settings)
    return fits.where((F.col("records") >= settings.min_points) & (F.col("npoints") > 0))


def fit_residuals(events: DataFrame, fits: DataFrame) -> DataFrame:
    """One row per record with the residual to its lactation's curve."""
    rows = lactation_records(events).where("npoints > 4").select(*KEYS, "DIM", "ECM")
    predicted = predict_each(rows, fits.where(F.col("a") > 1.0), KEYS)
    return with_residual(predicted).select(*KEYS, "DIM", "ECM", "ecm_est", "error")


def herd_file_fits(records: DataFrame, settings: FitSettings = HERD_FILE_FIT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fits of the lactations of a herd file, filled backward first.

    All lactations give a row; those with too few records say so in the status. Records are
    moved to their lactation once, and are filled, reduced to points and fitted there.
    """
    rows = fill_components(records.dropna(subset=list(keys)), keys, backward_first=True, beside=True)
    rows = rows.withColumns({"ECM": energy_corrected(), "SIGMA": error_sigma()})
    return fit_records_by(rows, keys, settings)


def single_animal_fits(
    records: DataFrame, settings: FitSettings = SINGLE_ANIMAL_FIT, keys: Sequence[str] = ("BDAT", "LACT")
) -> DataFrame:
    """Fits of a file without animal numbers: keyed by birth date and lactation."""
    rows = records.dropna(subset=list(keys)).withColumns({"ECM": energy_corrected(), "SIGMA": error_sigma("DIM", 60)})
    return fit_records_by(rows, keys, settings)

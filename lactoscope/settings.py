"""Settings of the models: thresholds, keys, start values and bounds.

A run is described by three small frozen dataclasses that are passed as plain
function arguments. Nothing is read from files or from the environment.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

# Energy-corrected milk (international formula).
ECM_FAT = 0.383
ECM_PROTEIN = 0.242
ECM_BASE = 0.7832
ECM_DIVISOR = 3.1138

# Names of the group codes 0 to 4.
GROUP_NAMES = ("HERD", "LAGR_1", "LAGR_2", "LAGR_3", "LAGR_4")
HERD_CODE = 0

# Error allowance of early test days.
EARLY_DIM = 30
EARLY_SIGMA = 1.5


@dataclass(frozen=True)
class FitSettings:
    """Start, bounds and limits of one curve fit; order is a, b, c, d."""

    start: tuple[float, float, float, float] = (100.0, 10.0, -1.0, 0.001)
    lower: tuple[float, float, float, float] = (0.0, 10.0, -5.0, 0.0001)
    upper: tuple[float, float, float, float] = (500.0, 50.0, 5.0, 0.002)
    start_at_peak: bool = False
    min_points: int = 1  # records a group needs, known value or not
    max_iterations: int = 500
    # Few points allow several minima: search all of b and d for the least, whatever the start.
    everywhere: bool = False
    product_limit: float | None = None  # bounds b * d of a search everywhere


_INF = math.inf

# Start and bounds per model.
GROUP_FIT = FitSettings()
LACTATION_FIT = FitSettings(
    start=(90.0, 50.0, -5.0, 0.001),
    lower=(0.0, 10.0, -5.0, 0.0),
    upper=(500.0, 50.0, 6.0, 0.002),
    min_points=5,
    everywhere=True,
)
EARLY_MEDIAN_FIT = FitSettings(
    start=(90.0, 10.0, -5.0, 0.001),
    lower=(0.0, 0.0, -500.0, 0.0),
    upper=(500.0, 500.0, 600.0, 1.0),
)
HERD_FILE_FIT = FitSettings(
    start=(90.0, 100.0, -15.0, 0.002),
    lower=(0.0, 1.0, -250.0, 0.0),
    upper=(500.0, 500.0, 200.0, 0.01),
    min_points=4,
    everywhere=True,
)
SINGLE_ANIMAL_FIT = FitSettings(
    start=(90.0, 100.0, -15.0, 0.002),
    lower=(0.0, 0.0, -250.0, 0.0),
    upper=(200.0, 100.0, 1000.0, 0.01),
    start_at_peak=True,
    min_points=4,
    everywhere=True,
)
COVERAGE_FIT = FitSettings(
    start=(90.0, 100.0, -15.0, 0.002),
    lower=(0.0, 0.0, -1000.0, 0.0),
    upper=(200.0, 100.0, 1000.0, 0.01),
)
UNBOUNDED_FIT = FitSettings(
    start=(90.0, 100.0, -15.0, 0.002),
    lower=(-_INF, -_INF, -_INF, -_INF),
    upper=(_INF, _INF, _INF, _INF),
)


@dataclass(frozen=True)
class RunParameters:
    """What one run covers: herds with test days after ``last_run``, or one herd."""

    last_run: dt.date = dt.date(2023, 3, 1)
    herd_id: int | None = None


@dataclass(frozen=True)
class Settings:
    """Keys and thresholds of input selection and of the group model."""

    herd_keys: tuple[str, ...] = ("SourceCode", "SourceHerdID")
    lactation_keys: tuple[str, ...] = ("BDAT", "ID", "LACT")
    animal_group_keys: tuple[str, ...] = ("BDAT", "ID", "LAGR")
    sort_keys: tuple[str, ...] = ("BDAT", "ID", "LAGR", "LACT", "DIM")

    # Input selection.
    lookback_months: int = 36
    lookback_days: int | None = None  # set: counts days instead of months
    dim_range: tuple[int, int] = (5, 350)
    percentile_buckets: int = 100
    percentile_limit: int = 90
    min_rows_per_test_date: int = 20

    # Predicates as text, so that a run can be tuned without code.
    accept_ecm: str = "ECM is not null and ECM > 0"
    accept_dim: str = "DIM >= 200 and DIM < 350"
    accept_count: str = "count >= 2"
    fit_rows: str = "ECM is not null and DIM < 325"
    individual_count: str = "count >= 5"
    individual_rows: str = "ECM is not null and DIM > 5"

    fit: FitSettings = GROUP_FIT

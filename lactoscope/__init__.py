"""Lactation-curve analytics on Spark DataFrames."""

from lactoscope.settings import (
    COVERAGE_FIT,
    EARLY_MEDIAN_FIT,
    GROUP_FIT,
    HERD_FILE_FIT,
    LACTATION_FIT,
    SINGLE_ANIMAL_FIT,
    UNBOUNDED_FIT,
    FitSettings,
    RunParameters,
    Settings,
)

__all__ = [
    "COVERAGE_FIT",
    "EARLY_MEDIAN_FIT",
    "GROUP_FIT",
    "HERD_FILE_FIT",
    "LACTATION_FIT",
    "SINGLE_ANIMAL_FIT",
    "UNBOUNDED_FIT",
    "FitSettings",
    "RunParameters",
    "Settings",
]

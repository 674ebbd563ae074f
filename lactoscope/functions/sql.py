"""The model formulas as functions for SQL text.

All but the fit are SQL functions that the optimizer inlines. The fit is a table function
over the day points of each partition, or a function of the lists of one group; lists collected over day averages, with sigma divided by the
square root of the count, give the same result as lists of all records and stay
as short as the number of days.
"""

from __future__ import annotations

import dataclasses
import sys
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lactoscope.operators import solver
from lactoscope.operators.fit import _POINT, FIT_FIELDS, _solve_batch
from lactoscope.settings import (
    EARLY_DIM,
    EARLY_SIGMA,
    ECM_BASE,
    ECM_DIVISOR,
    ECM_FAT,
    ECM_PROTEIN,
    GROUP_FIT,
    GROUP_NAMES,
    FitSettings,
)

for _module in (solver, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)


def register_functions(spark: SparkSession, settings: FitSettings = GROUP_FIT) -> None:
    """Make the formulas known: energy_corrected, error_sigma, group_name, curve_yield, yield_to_day, fit_curve, fit_day_points."""
    names = ", ".join(f"'{name}'" for name in GROUP_NAMES)
    bodies = {
        "energy_corrected(milk double, fat double, protein double) returns double": (
            f"milk * ({ECM_FAT}d * fat + {ECM_PROTEIN}d * protein + {ECM_BASE}d) / {ECM_DIVISOR}d"
        ),
        "error_sigma(dim int) returns double": (
            f"case when dim > {EARLY_DIM} then 1.0d when dim <= {EARLY_DIM} then {EARLY_SIGMA}d end"
        ),
        "group_name(code int) returns string": f"get(array({names}), code)",
        "curve_yield(dim int, p array<double>) returns double": (
            "get(p, 0) * (1d - exp(try_divide(get(p, 2) - dim, get(p, 1))) / 2d) * exp(-get(p, 3) * dim)"
        ),
        # Geometric series, as in the column form: no row per day.
        "decay_sum(rate double, days int) returns double": (
            "case when rate = 0d then double(days) else try_divide(-expm1(-rate * days), expm1(rate)) end"
        ),
        "yield_to_day(days int, p array<double>) returns double": (
            "get(p, 0) * (decay_sum(get(p, 3), days) - exp(try_divide(get(p, 2), get(p, 1))) / 2d"
            " * decay_sum(get(p, 3) + try_divide(1d, get(p, 1)), days))"
        ),
    }
    for signature, body in bodies.items():
        spark.sql(f"create or replace temporary function {signature} return {body}")

    limits = SimpleNamespace(**dataclasses.asdict(settings))

    @F.pandas_udf("array<double>")
    def fit_curve(t: pd.Series, y: pd.Series, sigma: pd.Series) -> pd.Series:
        return _fit_lists(t, y, sigma, limits)

    spark.udf.register("fit_curve", fit_curve)
    spark.udtf.register("fit_day_points", F.udtf(type("FitDayPoints", (_FitDayPoints,), {"limits": limits})))


class _FitDayPoints:
    """The fit as a table function: ``fit_day_points(table(points) partition by keys)``.

    The table has a row per key and day as ``operators.fit.day_points`` gives them: columns
    ``t, sigma, records, n, mean, spread, peak`` and the keys, in any order. Each partition
    gives one row: its keys, parameters, status (0 fitted, 1 failed, 2 fitted without
    covariance, 3 too few points) and covariance. A partition holds a few hundred days at
    most, whatever the number of records.
    """

    limits: SimpleNamespace

    @staticmethod
    def analyze(points: AnalyzeArgument) -> AnalyzeResult:
        if not points.isTable:
            raise ValueError("fit_day_points takes a table of day points")
        missing = sorted(set(_POINT) - set(points.dataType.names))
        if missing:
            raise ValueError(f"the table of day points has no column {', '.join(missing)}")
        keys = [field for field in points.dataType.fields if field.name not in _POINT]
        return AnalyzeResult(T.StructType([*keys, *FIT_FIELDS]))

    def __init__(self) -> None:
        self.key, self.days = None, []

    def eval(self, row) -> None:
        values = row.asDict()
        key = tuple(v for name, v in values.items() if name not in _POINT)
        if self.key is None:
            self.key = key
        elif key != self.key:
            raise ValueError("partition the table by all its columns but those of the day points")
        self.days.append([values[name] for name in _POINT])

    def terminate(self):
        if self.key is None:
            return
        days = sorted(self.days)
        columns = [pa.array([[float("nan") if v is None else float(v) for v in c]], pa.list_(pa.float64())) for c in zip(*days)]
        batch = pa.RecordBatch.from_arrays([*columns, pa.array([None], pa.list_(pa.float64()))], [*_POINT, "start"])
        solved = _solve_batch(batch, 0, self.limits).to_pylist()[0]
        yield (*self.key, *[solved[field.name] for field in FIT_FIELDS])


def _fit_lists(t: pd.Series, y: pd.Series, sigma: pd.Series, settings: SimpleNamespace) -> pd.Series:
    results = np.full(len(t), None, dtype=object)
    lengths = np.array([len(days) for days in t])
    for rows in solver.chunks(lengths):
        width = max(1, lengths[rows].max())
        days, values, errors = (np.zeros((len(rows), width)) for _ in range(3))
        for i, row in enumerate(rows):
            order = np.argsort(np.asarray(t.iloc[row], dtype=float), kind="stable")
            for matrix, lists in ((days, t), (values, y), (errors, sigma)):
                matrix[i, : len(order)] = np.asarray(lists.iloc[row], dtype=float)[order]
        weights = np.where(errors > 0, 1.0 / np.where(errors > 0, errors, 1.0) ** 2, 0.0)
        start = np.tile(np.asarray(settings.start), (len(rows), 1))
        bounds = np.asarray(settings.lower), np.asarray(settings.upper)
        p, _, _, converged, _ = solver.fit_batch(days, values, weights, start, *bounds, settings.max_iterations)
        for i in np.flatnonzero(converged & (lengths[rows] > 0)):
            results[rows[i]] = p[i].tolist()
    return pd.Series(results, dtype=object)

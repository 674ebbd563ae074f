"""Curve fits as Spark jobs.

The day in milk is an integer and the error weight depends on it, so the loss of a
group is fixed by count, mean and spread per (group, day, sigma). Spark reduces
any number of records to these points with partial aggregation; a fit then needs
at most a few hundred points per group, whatever the group's share of the rows.
Groups travel as rows of arrays, and each Arrow batch of groups is solved at once.
"""

from __future__ import annotations

import dataclasses
import sys
from collections.abc import Iterator, Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lactoscope.operators import projection, solver
from lactoscope.settings import GROUP_FIT, HERD_CODE, FitSettings, Settings

# Executors get the solver with the task and need no installed copy of it.
for _module in (solver, projection, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

_POINT = ("t", "sigma", "records", "n", "mean", "spread", "peak")

FIT_FIELDS = [
    T.StructField("a", T.DoubleType()),
    T.StructField("b", T.DoubleType()),
    T.StructField("c", T.DoubleType()),
    T.StructField("d", T.DoubleType()),
    T.StructField("records", T.LongType()),
    T.StructField("npoints", T.LongType()),
    T.StructField("last_dim", T.IntegerType()),
    T.StructField("weighted_sse", T.DoubleType()),
    T.StructField("within_days", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("iterations", T.IntegerType()),
    T.StructField("covariance", T.ArrayType(T.DoubleType())),
]


def day_points(
    records: DataFrame,
    keys: Sequence[str],
    value: str = "ECM",
    dim: str = "DIM",
    sigma: str = "SIGMA",
    also: Sequence[Column] = (),
) -> DataFrame:
    """One row per key, day and sigma: counts, mean, squared spread and peak.

    ``records`` counts all records of the day and ``n`` those with a value;
    ``also`` adds aggregates.
    """
    n = F.count(value)
    return (
        records.where(F.col(dim).isNotNull() & F.col(sigma).isNotNull())
        .groupBy(*keys, F.col(dim).alias("t"), F.col(sigma).cast("double").alias("sigma"))
        .agg(
            F.count(F.lit(1)).alias("records"),
            n.alias("n"),
            F.avg(value).alias("mean"),
            (F.var_pop(value) * n).alias("spread"),
            F.max(value).alias("peak"),
            *also,
        )
    )


def with_herd_level(points: DataFrame, by: Sequence[str] = (), group: str = "LAGR") -> DataFrame:
    """Points per group plus points over all groups, coded as group 0.

    The grouping sets run over the reduced points, not over the records, and tell
    the herd level from a missing group by its grouping id.
    """
    day = [*by, "t", "sigma"]
    levels = (
        points.groupingSets([[*day, group], day], *day, group)
        .agg(*_merged(), F.grouping(group).alias("all_groups"))
        .withColumn(group, F.when(F.col("all_groups") == 1, F.lit(HERD_CODE)).otherwise(F.col(group)))
    )
    return levels.select(*by, group, *[_unmarked(name) for name in _POINT])


def merge_points(points: DataFrame, keys: Sequence[str], also: Sequence[Column] = ()) -> DataFrame:
    """Points of finer keys put together to points per key, day and sigma; ``also`` adds aggregates."""
    merged = points.groupBy(*keys, "t", "sigma").agg(*_merged(), *also)
    others = [c for c in merged.columns[len(keys) + 2 + len(_POINT) - 2 :]]
    return merged.select(*keys, *[_unmarked(name) for name in _POINT], *others)


def _merged() -> list[Column]:
    mean = F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))
    # Spread about the common mean: within points plus between them.
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - F.sum("n") * mean * mean
    return [
        F.sum("records").alias("records_"),
        F.sum("n").alias("n_"),
        mean.alias("mean_"),
        F.greatest(F.sum("spread") + between, F.lit(0.0)).alias("spread_"),
        F.max("peak").alias("peak_"),
    ]


def _unmarked(name: str) -> Column:
    return F.col(name) if name in ("t", "sigma") else F.col(f"{name}_").alias(name)


def accepted_points(
    records: DataFrame,
    group: str,
    settings: Settings = Settings(),
    by: Sequence[str] = (),
    value: str = "ECM",
    dim: str = "DIM",
    sigma: str = "SIGMA",
) -> DataFrame:
    """Points per group from the lactations that are accepted for group fits.

    Records are reduced to lactation days first. How often a lactation meets the
    acceptance rules is then a sum over its few days, so the records are read once
    and need not be joined to the list of accepted lactations.
    """
    return accept_days(lactation_days(records, group, settings, by, value, dim, sigma), group, settings, by)


def lactation_days(
    records: DataFrame,
    group: str,
    settings: Settings = Settings(),
    by: Sequence[str] = (),
    value: str = "ECM",
    dim: str = "DIM",
    sigma: str = "SIGMA",
) -> DataFrame:
    """Points per lactation and group, with the number of records that count for acceptance.

    These points can be merged with later ones of the same lactations.
    """
    lactation = [*by, *settings.lactation_keys]
    accepts = F.count_if(F.expr(f"({settings.accept_ecm}) and ({settings.accept_dim})"))
    usable = F.expr(settings.fit_rows)
    return day_points(
        records.dropna(subset=lactation).withColumn("_value", F.when(usable, F.col(value))),
        [*lactation, group],
        "_value",
        dim,
        sigma,
        [accepts.alias("accepted_rows")],
    )


def accept_days(days: DataFrame, group: str, settings: Settings = Settings(), by: Sequence[str] = ()) -> DataFrame:
    """Points per group of the lactations whose days meet the acceptance rules."""
    accepted = F.sum("accepted_rows").over(W.partitionBy(*by, *settings.lactation_keys))
    rows = days.withColumn("count", accepted).where(settings.accept_count).where("n > 0")
    # Only records with a value take part in the fit.
    return merge_points(rows.withColumn("records", F.col("n")), [*by, group])


def fit_points(
    points: DataFrame,
    keys: Sequence[str],
    settings: FitSettings = GROUP_FIT,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Fit each key. ``starts`` may give own start values (a, b, c, d) per key.

    Every key gives one row: with parameters, or with null ones and the reason in
    ``status`` (0 fitted, 1 failed, 2 fitted without covariance, 3 too few points).
    ``within_days`` is the part of ``weighted_sse`` that no curve can remove. With
    ``everywhere`` the least loss inside the bounds is found whatever the start, and a fit
    fails only on values that are not finite.
    """
    keys = list(keys)
    series = F.array_sort(F.collect_list(F.struct(*_POINT)))
    packed = points.groupBy(*keys).agg(series.alias("series"))
    own_start = F.lit(None).cast("array<double>")
    if starts is not None:
        packed = packed.join(starts.select(*keys, F.array("a", "b", "c", "d").alias("start")), keys, "left")
        own_start = F.col("start")
    arrays = [F.col(f"series.{name}").cast("array<double>").alias(f"_{name}") for name in _POINT]
    packed = packed.select(*keys, *arrays, own_start.alias("_start"))
    schema = T.StructType([*packed.select(*keys).schema.fields, *FIT_FIELDS])

    # A plain object: tasks need no class of this package.
    limits = SimpleNamespace(**dataclasses.asdict(settings))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _solve_batch(batch, len(keys), limits)

    return packed.mapInArrow(solve, schema)


def _solve_batch(batch: pa.RecordBatch, key_count: int, settings: SimpleNamespace) -> pa.RecordBatch:
    column = {name: batch.column(key_count + i) for i, name in enumerate(_POINT)}
    offsets = column["t"].offsets.to_numpy()
    lengths = np.diff(offsets)
    flat = {name: col.values.to_numpy(zero_copy_only=False) for name, col in column.items()}
    own = batch.column(key_count + len(_POINT)).to_pylist()

    groups = batch.num_rows
    bounded = bool(np.isfinite([settings.lower, settings.upper]).any())
    p = np.full((groups, 4), np.nan)
    loss, pure, rmse = (np.full(groups, np.nan) for _ in range(3))
    points, records = np.zeros(groups, dtype=np.int64), np.zeros(groups, dtype=np.int64)
    last_day, iterations = np.full(groups, np.nan), np.zeros(groups, dtype=np.int32)
    status = np.full(groups, solver.TOO_FEW, dtype=np.int32)
    spread_matrix = np.full((groups, 4, 4), np.nan)

    for rows in solver.chunks(lengths):
        width = max(1, int(lengths[rows].max()))
        inside = np.arange(width)[None, :] < lengths[rows][:, None]
        source = (offsets[rows][:, None] + np.arange(width)[None, :])[inside]

        def matrix(name, inside=inside, source=source):
            values = np.zeros(inside.shape)
            values[inside] = flat[name][source]
            return values

        n = matrix("n")
        known = n > 0
        mean, within = np.where(known, matrix("mean"), 0.0), np.where(known, matrix("spread"), 0.0)
        sigma = np.where(inside, matrix("sigma"), 1.0)
        points[rows] = n.sum(axis=1).astype(np.int64)
        records[rows] = matrix("records").sum(axis=1).astype(np.int64)
        last_day[rows] = np.where(known, matrix("t"), -np.inf).max(axis=1)
        start = np.tile(np.asarray(settings.start, dtype=float), (len(rows), 1))
        if settings.start_at_peak:
            start[:, 0] = np.where(known, matrix("peak"), -np.inf).max(axis=1)
        for i, row in enumerate(rows):
            if own[row] is not None and None not in own[row]:
                start[i] = own[row]

        enough = (records[rows] >= settings.min_points) & (points[rows] > 0)
        if not enough.any():
            continue
        rows, start = rows[enough], start[enough]
        t, y, weight = matrix("t")[enough], mean[enough], (n / sigma**2)[enough]
        lower, upper = np.asarray(settings.lower), np.asarray(settings.upper)
        everywhere = settings.everywhere and projection.solvable(lower, upper)
        if everywhere:
            found = projection.fit_projected(t, y, weight, start, lower, upper, settings.max_iterations, settings.product_limit)
        else:
            found = solver.fit_batch(t, y, weight, start, lower, upper, settings.max_iterations)
        fitted, mean_loss, used, converged, jacobian = found
        within = within[enough]
        pure[rows] = (within / sigma[enough] ** 2).sum(axis=1)
        total = mean_loss + pure[rows]
        matrices = solver.covariance(jacobian, total, points[rows], bounded)
        good = converged & np.isfinite(fitted).all(axis=1)
        estimable = np.isfinite(matrices).all(axis=(1, 2))
        status[rows] = np.where(~good, solver.FAILED, np.where(estimable, solver.FITTED, solver.NO_COVARIANCE))
        iterations[rows] = used
        with np.errstate(all="ignore"):
            plain = n[enough] * (y - solver.curve_values(fitted, np.where(weight > 0, t, 1.0))) ** 2
        squares = np.where(weight > 0, plain, 0.0).sum(axis=1) + within.sum(axis=1)
        kept = rows[good]
        p[kept] = fitted[good]
        loss[kept] = total[good]
        rmse[kept] = np.sqrt(squares[good] / points[kept])
        spread_matrix[kept] = matrices[good]

    def nullable(values):
        return pa.array(values, mask=~np.isfinite(values))

    estimated = np.isfinite(spread_matrix).all(axis=(1, 2))
    covariances = pa.array(
        [m.ravel().tolist() if ok else None for m, ok in zip(spread_matrix, estimated)], pa.list_(pa.float64())
    )
    results = [
        *[nullable(p[:, i].copy()) for i in range(4)],
        pa.array(records),
        pa.array(points),
        pa.array(np.nan_to_num(last_day, neginf=0.0).astype(np.int32), mask=~np.isfinite(last_day)),
        nullable(loss),
        nullable(pure),
        nullable(rmse),
        pa.array(status),
        pa.array(iterations),
        covariances,
    ]
    names = [*batch.schema.names[:key_count], *[f.name for f in FIT_FIELDS]]
    return pa.RecordBatch.from_arrays([*batch.columns[:key_count], *results], names=names)


def fit_records_by(
    records: DataFrame,
    keys: Sequence[str],
    settings: FitSettings = GROUP_FIT,
    value: str = "ECM",
    dim: str = "DIM",
    sigma: str = "SIGMA",
) -> DataFrame:
    """Reduce records to points and fit each key."""
    return fit_points(day_points(records, keys, value, dim, sigma), keys, settings)


def fit_herd_and_groups(
    records: DataFrame, settings: FitSettings = GROUP_FIT, by: Sequence[str] = (), group: str = "LAGR", value: str = "ECM"
) -> DataFrame:
    """Fit each group and the herd as a whole (code 0) from one pass over the records."""
    points = with_herd_level(day_points(records, [*by, group], value), by, group)
    return fit_points(points, [*by, group], settings)


def with_fallback(fits: DataFrame, values: Sequence[float] = (0.0, 10.0, 0.0, 0.0)) -> DataFrame:
    """Give failed fits fixed parameters, for users who read failure from the level."""
    failed = F.col("status") == solver.FAILED
    return fits.withColumns(
        {p: F.when(failed, F.lit(float(v))).otherwise(F.col(p)) for p, v in zip(("a", "b", "c", "d"), values)}
    )


def correlations(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation matrix of the parameters in long form: key, i, j, correlation."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(4) for j in range(4)])
    i, j = F.col("i"), F.col("j")

    def entry(row: Column, column: Column) -> Column:
        return F.get("covariance", row * 4 + column)

    correlation = F.try_divide(entry(i, j), F.sqrt(entry(i, i) * entry(j, j)))
    known = fits.where(F.col("covariance").isNotNull()).select(*keys, "covariance", F.inline(cells))
    return known.select(*keys, "i", "j", correlation.alias("correlation"))


def fit_outcomes(fits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of cases, of too small ones, of failures and of fits without covariance."""
    status = F.col("status")
    return fits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(status == solver.TOO_FEW).alias("too_few_points"),
        F.count_if(status == solver.FAILED).alias("failed"),
        F.count_if(status == solver.NO_COVARIANCE).alias("no_covariance"),
    )


def peak_starts(records: DataFrame, keys: Sequence[str], value: str = "ECM") -> DataFrame:
    """Highest value per key, the start for the level of the curve."""
    return records.groupBy(*keys).agg(F.max(value).alias("peak"))


def daily_series(records: DataFrame, keys: Sequence[str], value: str = "ECM", dim: str = "DIM") -> DataFrame:
    """Series per key as one array of (day, records, mean), in day order.

    Days are reduced before they are collected, so an array has one entry per day
    at most and not one per record.
    """
    days = (
        records.where(F.col(value).isNotNull() & F.col(dim).isNotNull())
        .groupBy(*keys, dim)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    )
    return days.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(dim, "n", "mean"))).alias("series"))

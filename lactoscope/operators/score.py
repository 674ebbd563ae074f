"""Scores of curves: predictions, residuals, losses, individual scale, yields.

Parameter tables hold one row per group with columns a, b, c, d. They are joined on
their keys; Spark broadcasts a table that is small enough and splits hot keys otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lactoscope.functions.expressions import PARAMETERS, curve, group_name, pack, yield_to_day
from lactoscope.settings import Settings
from lactoscope.sources.tables import grid_days

EPSILON = 2.220446049250313e-16


def predict(
    records: DataFrame,
    parameters: DataFrame,
    keys: Sequence[str] = ("LAGR",),
    dim: str = "DIM",
    output: str = "ecm_est",
) -> DataFrame:
    """Attach the parameters of each record's group and the curve value of its day."""
    joined = records.join(parameters.select(*keys, *PARAMETERS), list(keys))
    return joined.withColumn(output, curve(dim))


def predict_each(records: DataFrame, parameters: DataFrame, keys: Sequence[str], output: str = "ecm_est") -> DataFrame:
    """The same for parameters per lactation, of which there are too many to check."""
    return records.join(parameters.select(*keys, *PARAMETERS), list(keys)).withColumn(output, curve())


def curves_on_grid(
    parameters: DataFrame, keys: Sequence[str] = ("LAGR",), first: int = 0, last: int = 349, step: int = 5
) -> DataFrame:
    """Curve values of each parameter row on a day grid, exploded beside the row."""
    days = grid_days(first, last, step)
    return (
        parameters.select(*keys, *PARAMETERS, F.explode(days).alias("DIM"))
        .withColumn("ecm_est", curve("DIM"))
    )


def curves_to_last_day(parameters: DataFrame, last_days: DataFrame, keys: Sequence[str], step: int = 1) -> DataFrame:
    """Curve values from day 0 up to, and without, the last observed day of each key."""
    bounded = parameters.join(last_days.where(F.col("last_dim") > 0), list(keys))
    return (
        bounded.select(*keys, *PARAMETERS, F.explode(grid_days(0, F.col("last_dim") - 1, step)).alias("DIM"))
        .withColumn("ecm_est", curve("DIM"))
    )


def with_residual(predicted: DataFrame, value: str = "ECM", estimate: str = "ecm_est", output: str = "error") -> DataFrame:
    return predicted.withColumn(output, F.col(value) - F.col(estimate))


def record_residuals(
    records: DataFrame, parameters: DataFrame, group: Sequence[str], keys: Sequence[str], value: str = "ECM"
) -> DataFrame:
    """The residual series of each key in long form: one row for every usable record."""
    usable = records.where(F.col(value).isNotNull() & F.col("DIM").isNotNull())
    return with_residual(predict(usable, parameters, group), value).select(*keys, "DIM", "error")


def losses(predicted: DataFrame, keys: Sequence[str], value: str = "ECM", estimate: str = "ecm_est") -> DataFrame:
    """Squared, absolute, relative and squared-log losses per key, in one pass.

    The squared-log loss is null where a value or an estimate is negative.
    """
    y, e = F.col(value), F.col(estimate)
    return predicted.where(y.isNotNull() & e.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("npoints"),
        loss_of("mse", y, e).alias("mse"),
        F.sqrt(loss_of("mse", y, e)).alias("rmse"),
        loss_of("mae", y, e).alias("mae"),
        loss_of("mape", y, e).alias("mape"),
        loss_of("msle", y, e).alias("msle"),
    )


def loss_of(name: str, y: Column, e: Column, weight: Column | None = None) -> Column:
    """A loss as an aggregate column; ``weight`` counts equal records."""

    def mean(term: Column) -> Column:
        if weight is None:
            return F.avg(term)
        return F.try_divide(F.sum(term * weight), F.sum(weight))

    if name == "mse":
        return mean((y - e) * (y - e))
    if name == "mae":
        return mean(F.abs(y - e))
    if name == "mape":
        return mean(F.abs(y - e) / F.greatest(F.abs(y), F.lit(EPSILON)))
    if name == "msle":
        gap = F.log1p(F.greatest(y, F.lit(0.0))) - F.log1p(F.greatest(e, F.lit(0.0)))
        return F.when(F.min(F.least(y, e)) >= 0, mean(gap * gap))
    raise ValueError(f"unknown loss: {name}")


def individual_scale(
    records: DataFrame, parameters: DataFrame, settings: Settings = Settings(), group: str = "LAGR", by: Sequence[str] = ()
) -> DataFrame:
    """Geometric mean of observed over group yield per lactation, and scaled curves.

    Records without a positive value or estimate have no logarithm and are skipped.
    The rule on the number of usable test days is counted in the same aggregation,
    so records are reduced before they move and no join on lactations is needed.
    """
    keys = [*by, group, *settings.lactation_keys]
    known = records.dropna(subset=list(settings.lactation_keys))
    rows = predict(known, parameters, [*by, group], output="ecm_est0")
    ratio = F.try_divide(F.col("ECM"), F.col("ecm_est0"))
    log_ratio = F.when(F.expr(settings.individual_rows) & (ratio > 0), F.log(ratio))
    scale = (
        rows.groupBy(*keys)
        .agg(
            F.count_if(F.expr(settings.accept_ecm)).alias("count"),
            F.count_if(F.expr(settings.individual_rows)).alias("used"),
            F.exp(F.avg(log_ratio)).alias("geom_mean_ratio"),
            # The curve is the same for all records of a lactation.
            *[F.max(p).alias(p) for p in PARAMETERS],
        )
        .where(settings.individual_count)
        .where("used > 0")
    )
    return (
        scale.withColumn("a", F.col("geom_mean_ratio") * F.col("a"))
        .select(group_name(group).alias("grp"), *keys, "geom_mean_ratio", *PARAMETERS)
    )


def with_parameter_array(scaled: DataFrame, output: str = "parameters") -> DataFrame:
    return scaled.withColumn(output, pack()).drop(*PARAMETERS)


def yields(parameters: DataFrame, keys: Sequence[str], days: int = 305, output: str = "m305") -> DataFrame:
    """Yield over the first days per parameter row, without a row per day."""
    return parameters.select(*keys, yield_to_day(days).alias(output))


def yields_by_sum(parameters: DataFrame, keys: Sequence[str], days: int = 305, output: str = "m305") -> DataFrame:
    """The same yield as a sum over exploded days; the check of the closed form."""
    return curves_on_grid(parameters, keys, 1, days, 1).groupBy(*keys).agg(F.sum("ecm_est").alias(output))


def select_fits(fits: DataFrame, rule: str) -> DataFrame:
    """Fits under a rule on a, b, c, d, rmse, npoints or last day, as predicate text."""
    return fits.where(rule)

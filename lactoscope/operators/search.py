"""Parameter search by grid, for any loss and with the limit on b * d.

Cells of the grid are exploded beside points that Spark has already reduced, and
the loss of every (key, cell) is a partial aggregate. A search can zoom: each
round lays a finer grid around the best cell of the round before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lactoscope.functions.expressions import PARAMETERS, curve
from lactoscope.operators.fit import day_points, fit_points
from lactoscope.operators.score import loss_of
from lactoscope.settings import FitSettings
from lactoscope.sources.tables import cut_lineage


@dataclass(frozen=True)
class Grid:
    """Range and number of steps per parameter; ``product_limit`` bounds b * d.

    The ranges are bounds of the search: callers give those of their question.

    The level a is solved for and not gridded when the loss is the squared one.
    """

    a: tuple[float, float, int] = (0.0, 150.0, 16)
    b: tuple[float, float, int] = (5.0, 50.0, 10)
    c: tuple[float, float, int] = (-40.0, 0.0, 9)
    d: tuple[float, float, int] = (0.0, 0.004, 9)
    product_limit: float | None = 0.1

    def axis(self, name: str) -> list[float]:
        low, high, steps = getattr(self, name)
        if steps == 1:
            return [low]
        return [low + (high - low) * i / (steps - 1) for i in range(steps)]


def _explode_axes(frame: DataFrame, axes: dict[str, Column], grid: Grid) -> DataFrame:
    for name, values in axes.items():
        frame = frame.withColumn(name, F.explode(values))
    if grid.product_limit is not None:
        frame = frame.where(F.col("b") * F.col("d") <= grid.product_limit)
    return frame


def _axes(grid: Grid, names: Sequence[str], around: bool, round_: int) -> dict[str, Column]:
    axes = {}
    for name in names:
        low, high, steps = getattr(grid, name)
        if not around or steps == 1:
            axes[name] = F.array(*[F.lit(float(v)) for v in grid.axis(name)])
            continue
        # Five values around the best one; each round halves the step.
        step = (high - low) / (steps - 1) / 2.0**round_
        near = [F.col(f"best.{name}") + F.lit(step * k) for k in (-2, -1, 0, 1, 2)]
        clipped = [F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high))) for v in near]
        axes[name] = F.array_distinct(F.array(*clipped))
    return axes


def _best(
    points: DataFrame, keys: list[str], grid: Grid, loss: str, round_: int, per: Sequence[str] = ()
) -> DataFrame:
    around = round_ > 0
    if loss == "mse":
        cells = _explode_axes(points, _axes(grid, ("b", "c", "d"), around, round_), grid)
        unit = curve("t", F.lit(1.0))
        n, y = F.col("n"), F.col("mean")
        sums = cells.groupBy(*keys, "b", "c", "d").agg(
            F.sum(n).alias("n"),
            F.sum(n * y * unit).alias("yg"),
            F.sum(n * unit * unit).alias("gg"),
            F.sum(n * y * y + F.col("spread")).alias("yy"),
        )
        level = F.coalesce(F.try_divide(F.col("yg"), F.col("gg")), F.lit(0.0))
        level = F.least(F.greatest(level, F.lit(float(grid.a[0]))), F.lit(float(grid.a[1])))
        a = F.col("a")
        squares = F.col("yy") - 2 * a * F.col("yg") + a * a * F.col("gg")
        scored = sums.withColumn("a", level).withColumn("loss", F.greatest(squares, F.lit(0.0)) / F.col("n"))
    else:
        cells = _explode_axes(points, _axes(grid, PARAMETERS, around, round_), grid)
        scored = cells.groupBy(*keys, *PARAMETERS).agg(
            loss_of(loss, F.col("y"), curve("t"), F.col("n")).alias("loss")
        )
    least = F.min(F.struct("loss", *PARAMETERS))
    return scored.where(F.col("loss").isNotNull() & ~F.isnan("loss")).groupBy(*keys, *per).agg(least.alias("best"))


def grid_search(
    records: DataFrame,
    keys: Sequence[str],
    grid: Grid = Grid(),
    loss: str = "mse",
    rounds: int = 1,
    value: str = "ECM",
    dim: str = "DIM",
) -> DataFrame:
    """Best cell per key under the loss (mse, mae, mape or msle)."""
    keys = list(keys)
    points = _points(records, keys, loss, value, dim)
    if rounds > 1:
        # Every round reads the points again, so they are stored once.
        points = cut_lineage(points)
    best = _best(points, keys, grid, loss, 0)
    for round_ in range(1, rounds):
        best = cut_lineage(best)
        best = _best(points.join(best, keys), keys, grid, loss, round_)
    return best.select(*keys, *[F.col(f"best.{p}").alias(p) for p in PARAMETERS], F.col("best.loss").alias("loss"))


def _points(records: DataFrame, keys: list[str], loss: str, value: str, dim: str) -> DataFrame:
    if loss == "mse":
        return _unweighted(records, keys, value, dim)
    # Other losses need each value; equal ones on a day are counted together.
    known = F.col(value).isNotNull() & F.col(dim).isNotNull()
    return (
        records.where(known)
        .groupBy(*keys, F.col(dim).alias("t"), F.col(value).alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _unweighted(records: DataFrame, keys: list[str], value: str, dim: str) -> DataFrame:
    known = records.where(F.col(value).isNotNull()).withColumn("_one", F.lit(1.0))
    return day_points(known, keys, value, dim, "_one")


def constrained_minimum(
    records: DataFrame,
    keys: Sequence[str],
    grid: Grid = Grid(),
    loss: str = "mse",
    rounds: int = 6,
    value: str = "ECM",
    dim: str = "DIM",
) -> DataFrame:
    """Least loss under the bounds and the limit on b * d.

    The squared loss is searched everywhere inside the bounds by projection onto b and d,
    and along b * d = limit where the limit binds. For any other loss the zoomed grid gives
    the answer.
    """
    keys = list(keys)
    if loss != "mse":
        return grid_search(records, keys, grid, loss, rounds, value, dim)
    settings = replace(_bounds(grid), everywhere=True, product_limit=grid.product_limit)
    fits = fit_points(_unweighted(records, keys, value, dim), keys, settings)
    return fits.select(*keys, *PARAMETERS, F.try_divide("weighted_sse", "npoints").alias("loss"))


def _bounds(grid: Grid) -> FitSettings:
    return FitSettings(
        lower=tuple(getattr(grid, p)[0] for p in PARAMETERS),
        upper=tuple(getattr(grid, p)[1] for p in PARAMETERS),
    )


def global_search(
    records: DataFrame,
    keys: Sequence[str],
    grid: Grid,
    value: str = "ECM",
    dim: str = "DIM",
) -> DataFrame:
    """Least squared loss inside the grid's bounds, by fits from many starts.

    The best cell of every b on the grid starts a fit; the best fit is kept. So a
    valley that looks poor on the grid is still followed to its floor.
    """
    keys = list(keys)
    points = _unweighted(records, keys, value, dim)
    cells = _best(points, keys, replace(grid, product_limit=None), "mse", 0, per=("b",))
    starts = cells.select(*keys, F.col("b").alias("_b"), *[F.col(f"best.{p}").alias(p) for p in PARAMETERS])
    trials = points.join(starts.select(*keys, "_b"), keys)
    fits = fit_points(trials, [*keys, "_b"], _bounds(grid), starts)
    results = [c for c in fits.columns if c not in (*keys, "_b")]
    return fits.groupBy(*keys).agg(F.min_by(F.struct(*results), F.struct("weighted_sse", "_b")).alias("best")).select(
        *keys, "best.*"
    )

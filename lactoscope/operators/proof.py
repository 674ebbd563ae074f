"""Least squared loss inside bounds with a proof: branch and bound over b and d.

With v = 1 / b, t0 the first day and k = exp((c - t0) * v) / 2 the curve is
a * exp(-d * t) * (1 - k * exp(-v * (t - t0))): linear in a and a * k for fixed v and d.
At the middle of a box of v and d the best two inside the widest bounds that k has in the
box follow in closed form from five sums over days. No curve of the box is farther from
the one with the same a and k at the middle than a times a sixth sum. So the loss of
every curve of the box is at least

    (root of the least loss at the middle - greatest a * root of the sixth sum) ^ 2.

A box whose bound is within the tolerance of the loss of a fit is closed, the others are
cut and looked at again. All boxes of all keys are one aggregate a round, over points that
are reduced to days.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lactoscope.functions.expressions import PARAMETERS
from lactoscope.operators.fit import fit_points
from lactoscope.operators.search import Grid, _bounds, _unweighted
from lactoscope.sources.tables import cut_lineage

# Pieces of the first round along v and d, and of a box that is cut.
FIRST, PIECES = (16, 16), 4
_BOX = ("v1", "v2", "d1", "d2")
_LARGEST = 300.0


def _half_exp(x: Column) -> Column:
    return F.exp(F.least(F.greatest(x, F.lit(-_LARGEST)), F.lit(_LARGEST))) / 2


def _clipped(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(F.coalesce(x, F.lit(0.0)), low), high)


def _least_loss(a: tuple[Column, Column], k: tuple[Column, Column]) -> Column:
    """``loss, x, y`` of the best x = a and y = a * k, from the sums of a box."""
    g11, g12, g22, r1, r2 = (F.col(c) for c in ("g11", "g12", "g22", "r1", "r2"))

    def at(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    def with_loss(p: Column) -> Column:
        loss = F.col("yy") + p.x * (p.x * g11 - 2 * p.y * g12 - 2 * r1) + p.y * (p.y * g22 + 2 * r2)
        return F.struct(F.greatest(F.coalesce(loss, F.lit(float("inf"))), F.lit(0.0)).alias("loss"), p.x.alias("x"), p.y.alias("y"))

    determinant = g11 * g22 - g12 * g12
    x, y = F.try_divide(r1 * g22 - r2 * g12, determinant), F.try_divide(r1 * g12 - r2 * g11, determinant)
    inside = x.between(*a) & (y >= k[0] * x) & (y <= k[1] * x)
    tried = [F.when(inside, at(x, y))]
    for slope in k:
        on_edge = _clipped(F.try_divide(r1 - slope * r2, g11 - 2 * slope * g12 + slope * slope * g22), *a)
        tried.append(at(on_edge, slope * on_edge))
    for level in a:
        tried.append(at(level, _clipped(F.try_divide(level * g12 - r2, g22), k[0] * level, k[1] * level)))
    # A function of the array, not five copies of it in the generated code.
    return F.array_min(F.transform(F.array_compact(F.array(*tried)), with_loss))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [left[k].eqNullSafe(right[k]) for k in keys])


def _looked_at(boxes: DataFrame, points: DataFrame, keys: list[str], grid: Grid, tolerance: float) -> DataFrame:
    """Boxes with ``low``, a bound of the loss of all their curves, and the best curve at their middle."""
    (a_low, a_high), (c_low, c_high) = grid.a[:2], grid.c[:2]
    v1, v2, d1, d2, t0 = (F.col(c) for c in (*_BOX, "t0"))
    v, d = (v1 + v2) / 2, (d1 + d2) / 2

    def k_at(c: float, pick) -> Column:
        return pick(_half_exp((F.lit(float(c)) - t0) * v1), _half_exp((F.lit(float(c)) - t0) * v2))

    boxes = boxes.withColumns({"k_low": k_at(c_low, F.least), "k_high": k_at(c_high, F.greatest)})
    beside = boxes.join(points, _same(boxes, points, keys)).select(
        *[boxes[k] for k in keys], *_BOX, "t0", "yy", "within", "best", "k_low", "k_high", "t", "n", "mean"
    )
    n, y, t, k_high = F.col("n"), F.col("mean"), F.col("t"), F.col("k_high")
    fall, ramp = F.exp(-d * t), F.exp(-v * (t - t0))
    slow, fast = F.exp(-v1 * (t - t0)), F.exp(-v2 * (t - t0))
    rest = F.greatest(F.lit(1.0), k_high * slow - 1)
    by_d = F.greatest(F.exp(-d1 * t) - fall, fall - F.exp(-d2 * t)) * rest
    by_v = fall * k_high * F.greatest(slow - ramp, ramp - fast)
    floor = F.exp(-d2 * t) * F.greatest(F.lit(0.0), 1 - k_high * slow)
    sums = {
        "g11": n * fall * fall,
        "g12": n * fall * fall * ramp,
        "g22": n * fall * fall * ramp * ramp,
        "r1": n * y * fall,
        "r2": n * y * fall * ramp,
        "off": n * (by_d + by_v) * (by_d + by_v),
        "off_d": n * by_d * by_d,
        "off_v": n * by_v * by_v,
        "floor": n * floor * floor,
    }
    same = ("t0", "yy", "within", "best", "k_low", "k_high")
    summed = beside.groupBy(*keys, *_BOX).agg(
        *[F.max(c).alias(c) for c in same], *[F.sum(x).alias(c) for c, x in sums.items()]
    )
    # A curve no worse than the fit cannot be larger than the data and the fit's loss allow.
    between = F.sqrt(F.greatest(F.col("best") - F.col("within"), F.lit(0.0)))
    most = F.try_divide(F.sqrt("yy") + between, F.sqrt("floor"))
    most = F.least(F.lit(float(a_high)), F.coalesce(most, F.lit(float(a_high))))
    summed = summed.withColumn("most", most)
    low, most = F.lit(float(a_low)), F.col("most")
    relaxed = _least_loss((low, most), (F.col("k_low"), F.col("k_high")))["loss"]
    reach = F.greatest(F.sqrt(relaxed) - most * F.sqrt("off"), F.lit(0.0))
    bound = F.when(most < low, F.lit(float("inf"))).otherwise(reach * reach + F.col("within"))
    bound = F.when(F.isnan(bound) | bound.isNull(), F.lit(0.0)).otherwise(bound)
    k_here = [_half_exp((F.lit(float(c)) - t0) * v) for c in (c_low, c_high)]
    middle = _least_loss((low, F.lit(float(a_high))), tuple(k_here))
    found = summed.withColumns({"low": bound, "middle": middle})
    level, share = F.col("middle.x"), F.try_divide(F.col("middle.y"), F.col("middle.x"))
    c = F.when(share > 0, t0 + F.log(2 * share) / v).otherwise(F.lit(float(c_low)))
    c = F.least(F.greatest(c, F.lit(float(c_low))), F.lit(float(c_high)))
    here = F.struct(
        (F.col("middle.loss") + F.col("within")).alias("loss"), level.alias("a"), (1 / v).alias("b"), c.alias("c"), d.alias("d")
    )
    return found.select(
        *keys, *_BOX, "t0", "yy", "within", "best", "low", here.alias("here"),
        (F.col("off_d") > F.col("off_v")).alias("cut_d"),
        (F.col("low") < F.col("best") * (1 - tolerance)).alias("open"),
    )


def _steps(low: Column, high: Column, n: int) -> list[tuple[Column, Column]]:
    ends = [low + (high - low) * (i / n) for i in range(1, n)]
    return list(zip([low, *ends], [*ends, high]))


def _cut(boxes: DataFrame) -> DataFrame:
    """Each box in pieces along the side on which its curves differ more."""
    v1, v2, d1, d2 = (F.col(c) for c in _BOX)

    def pieces(sides) -> Column:
        return F.array(*[F.struct(*[x.alias(c) for c, x in zip(_BOX, side)]) for side in sides])

    along_d = pieces([(v1, v2, low, high) for low, high in _steps(d1, d2, PIECES)])
    along_v = pieces([(low, high, d1, d2) for low, high in _steps(v1, v2, PIECES)])
    cut = boxes.withColumn("piece", F.explode(F.when(F.col("cut_d"), along_d).otherwise(along_v)))
    others = [c for c in boxes.columns if c not in (*_BOX, "low", "here", "cut_d", "open")]
    return cut.select(*others, "piece.*")


def proven_minimum(
    records: DataFrame,
    keys: Sequence[str],
    grid: Grid = Grid(),
    tolerance: float = 0.01,
    rounds: int = 12,
    value: str = "ECM",
    dim: str = "DIM",
) -> DataFrame:
    """``keys, a, b, c, d, loss, lower, gap, boxes``: the least mean squared loss and what is proven of it.

    No curve inside the grid's ranges has a loss below ``lower``, up to rounding of doubles;
    ``gap`` is 1 - lower / loss, and ``boxes`` counts those looked at. A search ends when
    the gap is at most ``tolerance`` for every key or after so many rounds, so keys with
    a greater gap are not proven. ``product_limit`` has no part. Keys without a value
    have no row, keys whose fit fails have nulls; a null key is a key.
    """
    if not 0 < tolerance < 1 or grid.b[0] <= 0 or grid.a[0] < 0:
        raise ValueError("tolerance between 0 and 1, b above 0 and a not below 0")
    keys = list(keys)
    points = cut_lineage(_unweighted(records, keys, value, dim).where("n > 0"))
    settings = replace(_bounds(grid), everywhere=True)
    fits = cut_lineage(fit_points(points, keys, settings))
    facts = points.groupBy(*keys).agg(
        F.min("t").cast("double").alias("t0"), F.sum(F.col("n") * F.col("mean") ** 2).alias("yy"), F.sum("spread").alias("within")
    )
    known = fits.where(F.col("weighted_sse").isNotNull()).select(*keys, F.col("weighted_sse").alias("best"))
    start = known.join(facts, _same(known, facts, keys)).select(*[known[k] for k in keys], "best", "t0", "yy", "within")
    sides = [
        F.explode(F.array(*[F.struct(low.alias(f"{c}1"), high.alias(f"{c}2")) for low, high in _steps(F.lit(x), F.lit(y), n)]))
        for c, x, y, n in (("v", 1 / grid.b[1], 1 / grid.b[0], FIRST[0]), ("d", float(grid.d[0]), float(grid.d[1]), FIRST[1]))
    ]
    boxes = start.withColumn("v", sides[0]).withColumn("d", sides[1]).select(*keys, "best", "t0", "yy", "within", "v.*", "d.*")
    looked = []
    for round_ in range(rounds):
        stage = cut_lineage(_looked_at(boxes, points, keys, grid, tolerance))
        last = round_ == rounds - 1 or stage.where("open").isEmpty()
        # A box that is cut is spoken for by its pieces.
        looked.append(stage.withColumn("counts", F.lit(True) if last else ~F.col("open")))
        if last:
            break
        boxes = _cut(stage.where("open"))
    every = reduce(DataFrame.unionByName, looked)
    proof = every.groupBy(*keys).agg(
        F.min(F.when(F.col("counts"), F.col("low"))).alias("low"), F.min("here").alias("here"), F.count(F.lit(1)).alias("boxes")
    )
    proof = cut_lineage(proof)
    # The best middle of a box may lie in a valley that the fit has not seen.
    starts = proof.select(*keys, "here.*").drop("loss")
    again = fit_points(points, keys, _bounds(grid), starts)
    both = fits.unionByName(again).groupBy(*keys).agg(
        F.min_by(F.struct(*PARAMETERS, "weighted_sse", "npoints"), F.coalesce("weighted_sse", F.lit(float("inf")))).alias("fit")
    )
    total = F.col("fit.weighted_sse")
    lower = F.least("low", total)
    return both.join(proof, _same(both, proof, keys), "left").select(
        *[both[k] for k in keys],
        *[F.col(f"fit.{p}").alias(p) for p in PARAMETERS],
        F.try_divide(total, F.col("fit.npoints")).alias("loss"),
        F.when(F.col("low").isNotNull(), F.try_divide(lower, F.col("fit.npoints"))).alias("lower"),
        F.when(F.col("low").isNotNull(), F.coalesce(1 - F.try_divide(lower, total), F.lit(0.0))).alias("gap"),
        "boxes",
    )

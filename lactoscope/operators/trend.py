"""Linear trend of milk components over a lactation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def component_trends(
    records: DataFrame,
    keys: Sequence[str] = ("BDAT", "ID", "LACT"),
    columns: Sequence[str] = ("PCTF", "PCTP"),
    dim: str = "DIM",
    tie_break: Sequence[str] = ("MILK", "PCTF", "PCTP"),
) -> DataFrame:
    """Slope and intercept per key over all records but the first.

    The first record is found as the least one and its share is taken off the
    sums, so every part is a plain aggregate with partial results per task.
    """
    first = F.min(F.struct(dim, *tie_break, *[F.col(c).alias(f"_{c}") for c in columns])).alias("first")
    day = F.col(dim).cast("double")
    aggregates = [first]
    for c in columns:
        known = F.col(c).isNotNull() & day.isNotNull()
        aggregates += [
            F.count(F.when(known, 1)).cast("double").alias(f"{c}_n"),
            F.sum(F.when(known, day)).alias(f"{c}_x"),
            F.sum(F.when(known, F.col(c))).alias(f"{c}_y"),
            F.sum(F.when(known, day * F.col(c))).alias(f"{c}_xy"),
            F.sum(F.when(known, day * day)).alias(f"{c}_xx"),
        ]
    sums = records.groupBy(*keys).agg(*aggregates)
    output = []
    for c in columns:
        x0 = F.col(f"first.{dim}").cast("double")
        y0 = F.col(f"first._{c}")
        skip = y0.isNotNull() & x0.isNotNull()

        def rest(name: str, share, c=c, skip=skip):
            return F.col(f"{c}_{name}") - F.when(skip, share).otherwise(F.lit(0.0))

        n, sx, sy = rest("n", F.lit(1.0)), rest("x", x0), rest("y", y0)
        sxy, sxx = rest("xy", x0 * y0), rest("xx", x0 * x0)
        spread = n * sxx - sx * sx
        # One distinct day has no direction: the least-norm solution is flat.
        slope = F.when(spread > 0, F.try_divide(n * sxy - sx * sy, spread)).otherwise(F.lit(0.0))
        slope = F.when(n > 0, slope)
        output += [slope.alias(f"{c}_slope"), F.try_divide(sy - slope * sx, n).alias(f"{c}_intercept")]
    return sums.select(*keys, *output)


def smooth_components(
    records: DataFrame,
    keys: Sequence[str] = ("BDAT", "ID", "LACT"),
    columns: Sequence[str] = ("PCTF", "PCTP"),
    dim: str = "DIM",
) -> DataFrame:
    """Add the trend value of each component for every record, the first included."""
    trends = component_trends(records, keys, columns, dim)
    estimates = [
        (F.col(f"{c}_intercept") + F.col(f"{c}_slope") * F.col(dim)).alias(f"{c}_EST") for c in columns
    ]
    return records.join(trends, list(keys), "left").select(*records.columns, *estimates)

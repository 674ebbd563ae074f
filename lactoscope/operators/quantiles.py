"""Exact quantiles per group, by rank and without a sketch or a sort.

The range of a group is cut into cells of equal width and the values in each are counted,
with partial aggregation. The running counts say which cell holds a wanted rank; that cell
alone is cut again between its own least and greatest value. After two such rounds a cell
is a millionth of the range, and the distinct values of the wanted cells are counted one by
one. No pass gathers the values of a group, however large it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lactoscope.sources.tables import cut_lineage

CELLS = 1024


def _cell(value: Column, low: Column, high: Column) -> Column:
    """The cell of a value between the bounds; a greater value has no lesser cell."""
    share = F.try_divide(value / 2 - low / 2, high / 2 - low / 2)
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * CELLS), F.lit(CELLS - 1)).cast("int")


def _holding(counts: DataFrame, wanted: DataFrame, group: list[str], cell: str) -> DataFrame:
    """Wanted ranks beside the cell that holds each, counted from the start of the cell."""
    running = F.sum("n").over(W.partitionBy(*group).orderBy(cell).rowsBetween(W.unboundedPreceding, 0))
    placed = counts.withColumn("upto", running)
    rank = F.col("rank")
    found = wanted.join(placed, group).where((rank > F.col("upto") - F.col("n")) & (rank <= F.col("upto")))
    return found.withColumn("rank", rank - (F.col("upto") - F.col("n"))).drop("upto", "n")


def exact_quantiles(frame: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by, share, value``: the least value with at least that share of the group's values at or below it.

    Nulls and values that are not numbers do not count; a group without values gives no row.
    Infinite values are values. The rows are read four times, so their keys and values are
    stored first.
    """
    group = [f"by{i}_" for i in range(len(by))] + ["all_"]
    value = F.col(column).cast("double")
    keys = [F.coalesce(F.struct(F.col(c).alias("k")), F.struct(F.lit(None).alias("k"))).alias(f"by{i}_") for i, c in enumerate(by)]
    rows = frame.where(value.isNotNull() & ~F.isnan(value)).select(*keys, F.lit(0).alias("all_"), value.alias("x"))
    # Infinities have no place between bounds; they stand for the ends of all doubles.
    largest = F.lit(1.7976931348623157e308)
    rows = cut_lineage(rows).withColumn("v", F.greatest(F.least(F.col("x"), largest), -largest))
    span = [F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")]
    whole = cut_lineage(rows.groupBy(*group).agg(*span))
    ranked = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share")) for s in shares])).alias("s")
    rank = F.greatest(F.ceil(F.col("s.share") * F.col("n")), F.lit(1)).alias("rank")
    wanted = whole.select(*group, "n", ranked).select(*group, F.col("s.share").alias("share"), rank)
    bounds = whole.drop("n")
    for level in ("first_", "second_"):
        cells = rows.join(bounds, group).withColumn(level, _cell(F.col("v"), F.col("low"), F.col("high"))).drop("low", "high")
        counts = cut_lineage(cells.groupBy(*group, level).agg(*span))
        wanted = cut_lineage(_holding(counts.select(*group, level, "n"), wanted, group, level))
        bounds = counts.join(wanted.select(*group, level).distinct(), [*group, level]).drop("n")
        rows, group = cells.join(bounds.select(*group, level), [*group, level], "left_semi"), [*group, level]
    values = cut_lineage(rows.groupBy(*group, "v").agg(F.max("x").alias("x"), F.count(F.lit(1)).alias("n")))
    found = _holding(values, wanted, group, "v")
    return found.select(*[F.col(f"by{i}_.k").alias(c) for i, c in enumerate(by)], "share", F.col("x").alias("value"))


def exact_cuts(frame: DataFrame, column: str, buckets: int = 4) -> DataFrame:
    """One row with the exact inner cut points of equal-frequency buckets, equal ones once."""
    found = exact_quantiles(frame, column, [i / buckets for i in range(1, buckets)])
    return found.agg(F.sort_array(F.collect_set("value")).alias("cuts"))

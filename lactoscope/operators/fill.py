"""Filling of missing milk components inside a lactation.

A missing value takes the last known one before it, then the first known one
after it (or the other way round). The known values are first reduced to one row
per lactation and day, which bounds what a window has to hold; only records with
a missing value are then joined to it. Complete records are not moved at all. Where records
are costly to make, they can all be moved to their lactation and filled there instead, which
makes them once and not three times.

Records of one day are ordered so that known values come before missing ones when
filling forward first, and after them when filling backward first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fill_components(
    records: DataFrame,
    keys: Sequence[str] = ("BDAT", "ID", "LACT"),
    columns: Sequence[str] = ("PCTF", "PCTP"),
    dim: str = "DIM",
    backward_first: bool = False,
    beside: bool = False,
) -> DataFrame:
    """Fill ``columns`` within each key; other columns are unchanged.

    With ``beside`` all records are read once and moved to their key, as what follows may need them anyway.
    """
    if beside:
        return _filled_beside(records, keys, columns, dim, backward_first)
    place = [*keys, dim]
    # Dealt by lactation, as its days and then its windows need them.
    days = records.select(*place, *columns).repartition(*keys).groupBy(*place).agg(
        *[F.max(c).alias(f"{c}_high") for c in columns], *[F.min(c).alias(f"{c}_low") for c in columns]
    )
    series = W.partitionBy(*keys).orderBy(dim)
    so_far = series.rowsBetween(W.unboundedPreceding, W.currentRow)
    from_here = series.rowsBetween(W.currentRow, W.unboundedFollowing)

    def filler(c: str):
        known_before = F.last(f"{c}_high", ignorenulls=True).over(so_far)
        known_after = F.first(f"{c}_low", ignorenulls=True).over(from_here)
        order = (known_after, known_before) if backward_first else (known_before, known_after)
        return F.coalesce(*order).alias(f"{c}_fill")

    fills = days.select(*[F.col(k).alias(f"{k}_day") for k in place], *[filler(c) for c in columns])
    incomplete = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in columns])
    # Null-safe keys: records without a key form one group, as in a window.
    same_day = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}_day")) for k in place])
    filled = records.where(incomplete).join(fills, same_day).select(
        *[F.coalesce(c, f"{c}_fill").alias(c) if c in columns else F.col(c) for c in records.columns]
    )
    return records.where(~incomplete).unionByName(filled)


def _filled_beside(records: DataFrame, keys: Sequence[str], columns: Sequence[str], dim: str, backward_first: bool) -> DataFrame:
    series = W.partitionBy(*keys)
    # By range, so that all records of a day have part in it; each frame grows by a day and is never begun again.
    so_far = series.orderBy(F.asc(dim)).rangeBetween(W.unboundedPreceding, W.currentRow)
    from_here = series.orderBy(F.desc(dim)).rangeBetween(W.unboundedPreceding, W.currentRow)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(dim).alias("day"), F.col(c).alias("value"))) for c in columns}
    # The last known day so far with its highest value, the first one from here with its lowest.
    before = {f"{c}_before": F.max(known[c]).over(so_far)["value"] for c in columns}
    after = {f"{c}_after": F.min(known[c]).over(from_here)["value"] for c in columns}
    order = ("after", "before") if backward_first else ("before", "after")
    filled = {c: F.coalesce(c, *[F.col(f"{c}_{way}") for way in order]) for c in columns}
    return records.withColumns(before | after).select(*[filled[c].alias(c) if c in filled else F.col(c) for c in records.columns])

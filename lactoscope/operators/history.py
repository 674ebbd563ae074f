"""Rules on how much history an animal or lactation must have."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lactoscope.settings import Settings


def valid_yields(records: DataFrame, first: int | None = 1, last: int | None = 399) -> DataFrame:
    """Records with a yield and a day in milk between first and last."""
    valid = records.where(F.col("MILK").isNotNull() & F.col("DIM").isNotNull())
    if first is not None:
        valid = valid.where(F.col("DIM") >= first)
    if last is not None:
        valid = valid.where(F.col("DIM") <= last)
    return valid


def complete_components(records: DataFrame) -> DataFrame:
    return records.where(F.col("PCTF").isNotNull() & F.col("PCTP").isNotNull())


def point_counts(records: DataFrame, keys: Sequence[str], name: str = "npoints") -> DataFrame:
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def with_point_count(
    records: DataFrame, keys: Sequence[str], at_least: int = 4, counts: DataFrame | None = None
) -> DataFrame:
    """Attach the number of records per key; keep keys with enough of them.

    ``counts`` may come from an earlier stage that has the same records.
    """
    counts = point_counts(records, keys) if counts is None else counts
    return records.join(counts.where(F.col("npoints") >= at_least), list(keys))


def accepted_lactations(
    records: DataFrame,
    row_rules: Sequence[str],
    count_rule: str,
    keys: Sequence[str] = ("BDAT", "ID", "LACT"),
) -> DataFrame:
    """Keys with enough records under the row rules; rules are predicate text."""
    for rule in row_rules:
        records = records.where(rule)
    return point_counts(records, keys, "count").where(count_rule)


def keep_accepted(records: DataFrame, accepted: DataFrame, keys: Sequence[str] = ("BDAT", "ID", "LACT")) -> DataFrame:
    return records.join(accepted, list(keys), "left_semi")


def of_accepted(records: DataFrame, row_rules: Sequence[str], count_rule: str, keys: Sequence[str]) -> DataFrame:
    """Records of the lactations that ``accepted_lactations`` gives, counted beside the records.

    The records are read and moved once; those without a key belong to no lactation.
    """
    meets = reduce(lambda x, y: x & y, [F.expr(f"({rule})") for rule in row_rules])
    counted = records.dropna(subset=list(keys)).select("*", F.count_if(meets).over(W.partitionBy(*keys)).alias("count"))
    # A lactation without a record under the rules is never accepted.
    return counted.where(F.col("count") > 0).where(count_rule).select(*records.columns)


def fit_records(records: DataFrame, settings: Settings = Settings(), by: Sequence[str] = ()) -> DataFrame:
    """Records for the group fits: lactations seen late enough, inside the fit window."""
    keys = [*by, *settings.lactation_keys]
    rules = (settings.accept_ecm, settings.accept_dim)
    return of_accepted(records, rules, settings.accept_count, keys).where(settings.fit_rows)


def individual_records(records: DataFrame, settings: Settings = Settings(), by: Sequence[str] = ()) -> DataFrame:
    """Records for individual scaling: lactations with enough usable test days."""
    keys = [*by, *settings.lactation_keys]
    rows = of_accepted(records, (settings.accept_ecm,), settings.individual_count, keys)
    return rows.where(settings.individual_rows)


def history_columns() -> list[Column]:
    return [F.min("DIM").alias("DIM_MIN"), F.max("DIM").alias("DIM_MAX")]


def long_enough(first: int = 0, last: tuple[int, int] = (200, 350)) -> Column:
    return (F.col("DIM_MIN") >= first) & (F.col("DIM_MAX") >= last[0]) & (F.col("DIM_MAX") < last[1])


def history_bounds(records: DataFrame, keys: Sequence[str] = ("BDAT", "ID", "LAGR")) -> DataFrame:
    """First and last day per key, where the last one is late enough but in range."""
    return records.groupBy(*keys).agg(*history_columns()).where(long_enough())


def with_history_bounds(records: DataFrame, bounds: DataFrame, keys: Sequence[str] = ("BDAT", "ID", "LAGR")) -> DataFrame:
    return records.join(bounds, list(keys))


def coverage(records: DataFrame, keys: Sequence[str] = ("BDAT", "ID", "LACT")) -> DataFrame:
    """Last day and number of records per key, without collecting the series."""
    return records.groupBy(*keys).agg(F.max("DIM").alias("last_dim"), F.count(F.lit(1)).alias("npoints"))

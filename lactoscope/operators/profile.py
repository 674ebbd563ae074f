"""Profiles: null counts, summaries, quantile buckets, samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lactoscope.operators import digests

# Executors get it with the task and need no installed copy.
cloudpickle.register_pickle_by_value(digests)


def null_profile(records: DataFrame, columns: Sequence[str] = ("MILK", "ECM", "PCTF", "PCTP")) -> DataFrame:
    """Row count and number of nulls per column, in one pass."""
    return records.agg(
        F.count(F.lit(1)).alias("N"), *[F.count_if(F.col(c).isNull()).alias(f"{c.lower()}_null") for c in columns]
    )


def summary(records: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, standard deviation, minimum and maximum, one row per column.

    All columns are aggregated in one pass and only the result is unpivoted.
    """
    statistics = ("n", "mean", "stddev", "lowest", "highest")
    wide = records.groupBy(*by).agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.avg(c).cast("double").alias("mean"),
                F.stddev_samp(c).alias("stddev"),
                F.min(c).cast("double").alias("lowest"),
                F.max(c).cast("double").alias("highest"),
            ).alias(c)
            for c in columns
        ]
    )
    named = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("s")) for c in columns])
    return wide.select(*by, F.inline(named)).select(*by, "variable", *[F.col(f"s.{s}").alias(s) for s in statistics])


def median_by_day(
    records: DataFrame, value: str = "ECM", keys: Sequence[str] = ("LAGR", "DIM"), accuracy: int = 10000
) -> DataFrame:
    """Approximate median of a value per group and day, from a mergeable sketch."""
    return records.groupBy(*keys).agg(F.percentile_approx(value, 0.5, accuracy).alias(f"{value}_MEDIAN"))


def animal_means(
    records: DataFrame, value: str = "ECM", keys: Sequence[str] = ("BDAT", "ID", "LAGR")
) -> DataFrame:
    return records.groupBy(*keys).agg(mean_of(value))


def mean_of(value: str) -> Column:
    return F.avg(value).alias(f"{value.lower()}_avg")


def quantile_cuts(frame: DataFrame, column: str, buckets: int = 4, relative_error: float = 0.01) -> DataFrame:
    """One row with the inner cut points of equal-frequency buckets.

    The sketch behind it has a size set by the error, whatever the row count.
    """
    accuracy = max(1, round(1 / relative_error))
    shares = [i / buckets for i in range(1, buckets)]
    return frame.agg(F.array_distinct(F.percentile_approx(column, shares, accuracy)).alias("cuts"))


def quantile_buckets(
    frame: DataFrame, column: str, buckets: int = 4, relative_error: float = 0.01, output: str = "bucket"
) -> DataFrame:
    """Number the equal-frequency bucket of each row from 0.

    The cut points reach the rows as a scalar subquery. A null value is an error,
    since it has no bucket.
    """
    cuts = quantile_cuts(frame, column, buckets, relative_error)
    value = F.when(F.col(column).isNull(), F.raise_error(F.lit(f"{column} is null"))).otherwise(F.col(column))
    at_or_below = F.filter(F.col("_cuts"), lambda cut: cut <= F.col("_value"))
    return (
        frame.select("*", cuts.scalar().alias("_cuts"), value.alias("_value"))
        .withColumn(output, F.size(at_or_below).cast("double"))
        .drop("_cuts", "_value")
    )


def first_rows(frame: DataFrame, order: Sequence[str | Column], rows: int = 100) -> DataFrame:
    """The first rows in a total order, so that the choice is repeatable."""
    return frame.orderBy(*order).limit(rows)


def random_rows(frame: DataFrame, rows: int = 100, seed: int = 23, keys: Sequence[str] | None = None) -> DataFrame:
    """Exactly ``rows`` draws with replacement, the same on every run.

    Each draw takes the row whose keyed hash is least, so parts of a table can be drawn from
    apart and merged. ``keys`` (all columns if not given) name a row; rows alike in them are
    drawn as one. An empty input gives none. The input is read once: a task holds one row for
    each draw, hashes a batch of rows for some draws at a time, and gives its rows at the end.
    """
    names = list(keys or frame.columns)
    # A length before each key, so that no two rows have the same text.
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
    text = F.concat(*[F.concat(F.char_length(t).cast("string"), F.lit(":"), t) for t in texts])
    keyed = frame.select(F.struct("*").alias("row"), text.alias("text"))
    prefixes = [f"{seed}:{draw}:".encode() for draw in range(1, rows + 1)]
    schema = T.StructType([T.StructField("draw", T.IntegerType()), T.StructField("digest", T.StringType()), keyed.schema["row"]])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[str | None] = [None] * len(prefixes)
        held, places = None, {}
        for batch in batches:
            found = digests.least(prefixes, batch.column(1), known)
            if found:
                taken = pa.table([batch.column(0).take(pa.array([row for _, row in found.values()]))], names=["row"])
                begin = 0 if held is None else len(held)
                places |= {draw: begin + i for i, draw in enumerate(found)}
                both = taken if held is None else pa.concat_tables([held, taken])
                held = both.take(pa.array(list(places.values()))).combine_chunks()
                places = {draw: i for i, draw in enumerate(places)}
                for draw, (digest, _) in found.items():
                    known[draw] = digest
        if held is not None:
            given = pa.array([draw + 1 for draw in places], pa.int32()), pa.array([known[draw] for draw in places])
            yield pa.RecordBatch.from_arrays([*given, held.column(0).combine_chunks()], names=["draw", "digest", "row"])

    least = keyed.mapInArrow(drawn, schema).groupBy("draw").agg(F.min_by("row", "digest").alias("row"))
    return least.select("row.*")

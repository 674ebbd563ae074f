"""Selection of the test-day records a model run may use.

The percentile of days in milk ranks each record inside its herd, test date and
lactation group. A window over that group would put a whole group into one task,
so the rank is built from two parts instead:

* a small table of cells (group, day, slot) with counts, whose running sum gives
  the number of records before each cell, and
* the place of a record inside its own cell.

A slot is the animal number modulo a prime. It breaks ties of equal days the same
way on every run and splits a group that holds a large share of all rows into
thousands of cells, each ranked in its own task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lactoscope.functions.expressions import energy_corrected_reported, group_code
from lactoscope.settings import RunParameters, Settings

SLOTS = 61
TEST_DATE_KEYS = ("SourceCode", "SourceHerdID", "TestDate")
RANK_GROUP = (*TEST_DATE_KEYS, "LAGR")


def herds_due(herds: DataFrame, run: RunParameters) -> DataFrame:
    """Herds with a test day after the last run."""
    return herds.where(F.col("LastTestDayEventDate") > F.lit(run.last_run))


def primary_records(
    events: DataFrame, herds: DataFrame, run: RunParameters, settings: Settings = Settings()
) -> DataFrame:
    """Valid test days of the herds due, inside each herd's look-back period.

    The join is a plain one on the filtered herd table, so Spark broadcasts it if it is
    small, splits a big herd if not, and prunes partitions of a table stored by herd. A
    due herd has a test day after the last run, so no herd's look-back begins before
    that of the last run itself; this bound reaches the scan.
    """
    low, high = settings.dim_range
    valid = events.where(
        (F.col("LactationNumber") > 0) & F.col("MilkWeight").isNotNull() & F.col("DIM").between(low, high)
    )
    due = herds_due(herds, run)
    if run.herd_id is not None:
        valid = valid.where(F.col("SourceHerdID") == run.herd_id)
        due = due.where(F.col("SourceHerdID") == run.herd_id)
    last = F.col("LastTestDayEventDate")

    def look_back(day: Column) -> Column:
        if settings.lookback_days is None:
            return F.add_months(day, -settings.lookback_months)
        return F.date_sub(day, settings.lookback_days)

    earliest = look_back(last)
    valid = valid.where(F.col("EventDateTime") >= look_back(F.lit(run.last_run)).cast("timestamp"))
    return (
        valid.join(due.select(*settings.herd_keys, "LastTestDayEventDate"), list(settings.herd_keys))
        .withColumn("TestDate", F.to_date("EventDateTime"))
        .where(F.col("TestDate") >= earliest)
        .select(
            "SourceCode",
            "SourceHerdID",
            "LastTestDayEventDate",
            "SourceAnimalID",
            F.col("EarTag").alias("ID"),
            F.col("LactationNumber").alias("LACT"),
            group_code("LactationNumber").alias("LAGR"),
            F.col("BirthDate").alias("BDAT"),
            F.col("FreshDate").alias("FDAT"),
            "TestDate",
            "DIM",
            F.col("MilkWeight").alias("MILK"),
            energy_corrected_reported("MilkWeight", "PercentFat", "PercentProtein").alias("ECM"),
            F.col("PercentFat").alias("PCTF"),
            F.col("PercentProtein").alias("PCTP"),
        )
    )


def _slot() -> Column:
    return F.pmod(F.coalesce(F.col("SourceAnimalID"), F.lit(0)), F.lit(SLOTS)).cast("int")


def _cells(records: DataFrame, cell: list[str]) -> DataFrame:
    """Record counts per cell of a ranked group."""
    return records.groupBy(*RANK_GROUP, *cell).agg(F.count(F.lit(1)).alias("cell_rows"))


def _placed(cells: DataFrame, cell: list[str]) -> DataFrame:
    """Cells with the records before them and those of their whole group."""
    group = W.partitionBy(*RANK_GROUP)
    before = group.orderBy(*cell).rowsBetween(W.unboundedPreceding, -1)
    return cells.select(
        *RANK_GROUP,
        *cell,
        "cell_rows",
        F.coalesce(F.sum("cell_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("cell_rows").over(group).alias("group_rows"),
    )


def ntile_of(place: str, rows: str, buckets: int) -> Column:
    """Bucket of the ``place``-th of ``rows`` ordered rows, as SQL ntile deals them."""
    size, extra = f"({rows} div {buckets})", f"({rows} % {buckets})"
    wide = f"({extra} * ({size} + 1))"
    return F.expr(
        f"cast(case when {place} <= {wide} then ({place} - 1) div ({size} + 1) + 1 "
        f"else {extra} + ({place} - 1 - {wide}) div greatest({size}, 1) + 1 end as int)"
    )


def _percent_rank() -> Column:
    # Records of one day are peers and share the rank of the first of them.
    return F.when(F.col("group_rows") > 1, F.col("rows_before") / (F.col("group_rows") - 1)).otherwise(F.lit(0.0))


def _kept_by_ntile(rows: str, settings: Settings) -> Column:
    # Records of a group in the first buckets follow from its row count alone.
    b, limit = settings.percentile_buckets, settings.percentile_limit
    return F.expr(f"{limit} * ({rows} div {b}) + least({rows} % {b}, {limit})")


def _in_cells(records: DataFrame, method: str) -> tuple[DataFrame, list[str]]:
    """Records with their cell; the percent rank needs no order inside a day."""
    if method == "percent_rank":
        return records, ["DIM"]
    if method == "ntile":
        return records.withColumn("slot", _slot()), ["DIM", "slot"]
    raise ValueError(f"unknown percentile method: {method}")


def with_percentile(
    records: DataFrame, settings: Settings = Settings(), method: str = "ntile", cells: DataFrame | None = None
) -> DataFrame:
    """Add PercentileDIM: the ntile bucket 1..100, or the percent rank 0..1.

    ``cells`` restricts the records to chosen cells; their places must be known.
    """
    rows, cell = _in_cells(records, method)
    if cells is None:
        cells = _placed(_cells(rows, cell), cell)
    placed = rows.join(cells.drop("cell_rows"), [*RANK_GROUP, *cell])
    if method == "percent_rank":
        return placed.withColumn("PercentileDIM", _percent_rank()).select(*records.columns, "PercentileDIM")
    inside = W.partitionBy(*RANK_GROUP, *cell).orderBy(
        "SourceAnimalID", "LACT", "MILK", F.asc_nulls_first("PCTF"), F.asc_nulls_first("PCTP")
    )
    return (
        placed.withColumn("place", F.col("rows_before") + F.row_number().over(inside))
        .withColumn("PercentileDIM", ntile_of("place", "group_rows", settings.percentile_buckets))
        .select(*records.columns, "PercentileDIM")
    )


def _kept_in_cell(settings: Settings, method: str) -> Column:
    """How many records of a cell are at or below the percentile limit."""
    if method == "percent_rank":
        share = settings.percentile_limit / settings.percentile_buckets
        return F.when(_percent_rank() <= share, F.col("cell_rows")).otherwise(F.lit(0))
    left = F.least(_kept_by_ntile("group_rows", settings) - F.col("rows_before"), F.col("cell_rows"))
    return F.greatest(left, F.lit(0))


def selected_test_dates(
    records: DataFrame, settings: Settings = Settings(), method: str = "ntile"
) -> DataFrame:
    """Herd test dates with enough records after the percentile trim."""
    if method == "percent_rank":
        groups = _placed(_cells(records, ["DIM"]), ["DIM"])
        kept = _kept_in_cell(settings, method)
    else:
        groups = records.groupBy(*RANK_GROUP).agg(F.count(F.lit(1)).alias("group_rows"))
        kept = _kept_by_ntile("group_rows", settings)
    return (
        groups.groupBy(*TEST_DATE_KEYS)
        .agg(F.sum(kept).cast("bigint").alias("N"))
        .where(F.col("N") >= settings.min_rows_per_test_date)
    )


def qualifying_records(
    events: DataFrame,
    herds: DataFrame,
    run: RunParameters,
    settings: Settings = Settings(),
    method: str = "ntile",
) -> DataFrame:
    """Records at or below the percentile limit on test dates with enough of them.

    How many records of a cell are kept follows from its place, so test dates are
    chosen on the cells and the wide records move once: to their cell.
    """
    records = primary_records(events, herds, run, settings)
    rows, cell = _in_cells(records, method)
    date = W.partitionBy(*TEST_DATE_KEYS)
    # Dates with too few records at all go first. Cells are then together by date,
    # which serves the windows over its groups as well.
    cells = _cells(rows, cell).withColumn("date_rows", F.sum("cell_rows").over(date))
    cells = cells.where(F.col("date_rows") >= settings.min_rows_per_test_date)
    wanted = (
        _placed(cells, cell)
        .withColumn("kept", _kept_in_cell(settings, method))
        .withColumn("N", F.sum("kept").over(date))
        .where((F.col("kept") > 0) & (F.col("N") >= settings.min_rows_per_test_date))
        .drop("kept", "N")
    )
    ranked = with_percentile(records, settings, method, wanted)
    if method == "percent_rank":
        return ranked
    return ranked.where(F.col("PercentileDIM") <= settings.percentile_limit)

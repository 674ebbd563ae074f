import random

import pytest
from pyspark.sql import functions as F

from lactoscope.operators.fill import fill_components

SCHEMA = "BDAT string, ID string, LACT int, DIM int, row int, PCTF double, PCTP double"


def fill(spark, rows, **options):
    frame = spark.createDataFrame([("b", *r) for r in rows], SCHEMA)
    return {r.row: (r.PCTF, r.PCTP) for r in fill_components(frame, **options).collect()}


def test_leading_and_trailing_gaps(spark):
    rows = [("1", 1, 10, 0, None, 3.0), ("1", 1, 20, 1, 4.0, None), ("1", 1, 30, 2, None, None)]
    assert fill(spark, rows) == {0: (4.0, 3.0), 1: (4.0, 3.0), 2: (4.0, 3.0)}


def test_order_of_the_two_fills(spark):
    rows = [("1", 1, 10, 0, 1.0, 1.0), ("1", 1, 20, 1, None, None), ("1", 1, 30, 2, 3.0, 3.0)]
    assert fill(spark, rows)[1] == (1.0, 1.0)
    assert fill(spark, rows, backward_first=True)[1] == (3.0, 3.0)


def test_no_value_crosses_lactations(spark):
    rows = [("1", 1, 10, 0, 4.0, 3.0), ("1", 2, 10, 1, None, 3.0), ("2", 1, 10, 2, None, None)]
    assert fill(spark, rows) == {0: (4.0, 3.0), 1: (None, 3.0), 2: (None, None)}


def test_missing_keys_are_kept(spark):
    frame = spark.createDataFrame(
        [(None, "1", 1, 10, 0, 4.0, 3.0), (None, "1", 1, 20, 1, None, 3.0), ("b", "1", None, 20, 2, None, 3.0)], SCHEMA
    )
    found = {r.row: r.PCTF for r in fill_components(frame).collect()}
    assert found == {0: 4.0, 1: 4.0, 2: None}


def by_hand(rows, column, backward_first):
    found = {}
    for key in {r[:2] for r in rows}:
        known_last = not backward_first
        group = sorted(
            (r for r in rows if r[:2] == key),
            key=lambda r: (r[2], (r[column] is None) == known_last, r[column] or 0.0),
        )
        values = [r[column] for r in group]
        for direction in ("back", "fore") if backward_first else ("fore", "back"):
            walk = range(len(values)) if direction == "fore" else reversed(range(len(values)))
            last = None
            for i in walk:
                last = values[i] = values[i] if values[i] is not None else last
        found.update({r[3]: v for r, v in zip(group, values)})
    return found


@pytest.mark.parametrize("backward_first", [False, True])
def test_against_walking_the_rows(spark, backward_first):
    rng = random.Random(3)
    rows = [
        (
            str(rng.randrange(6)),
            rng.randrange(1, 3),
            rng.randrange(1, 12),
            i,
            rng.choice([None, None, 3.0, 3.5, 4.0]),
            rng.choice([None, 2.5, 3.0]),
        )
        for i in range(300)
    ]
    found = fill(spark, rows, backward_first=backward_first)
    fat, protein = by_hand(rows, 4, backward_first), by_hand(rows, 5, backward_first)
    assert found == {r[3]: (fat[r[3]], protein[r[3]]) for r in rows}


def test_filling_twice_changes_nothing(spark):
    rng = random.Random(4)
    rows = [("b", "1", 1, rng.randrange(40), i, rng.choice([None, 3.0, 4.0]), rng.choice([None, 3.0])) for i in range(60)]
    once = fill_components(spark.createDataFrame(rows, SCHEMA))
    assert sorted(once.collect()) == sorted(fill_components(once).collect())


def test_complete_records_do_not_move(spark):
    frame = spark.createDataFrame([("b", "1", 1, 10, 0, 4.0, 3.0)], SCHEMA)
    plan = fill_components(frame)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    union = next(i for i, line in enumerate(plan) if "Union" in line)
    complete = plan[union + 1 : next(i for i, line in enumerate(plan) if "Join" in line) - 1]
    assert any("Filter" in line for line in complete)
    assert not any(word in line for line in complete for word in ("Join", "Window", "Aggregate"))


@pytest.mark.parametrize("backward_first", [False, True])
def test_records_filled_beside_each_other_are_filled_alike(spark, backward_first):
    """Days that come again, days and keys that are unknown, values that are no numbers."""
    rows = spark.sql(
        """select id as row, nullif(id % 5, 4) as BDAT, if(id % 11 = 1, null, string(id % 3)) as ID, 1 as LACT, if(id % 23 = 0, null, int(xxhash64(id) % 12)) as DIM,
        if(xxhash64(id, 1) % 3 = 0, null, if(id % 31 = 0, double('nan'), double(id % 17))) as PCTF,
        if(xxhash64(id, 2) % 5 <> 0, null, double(id % 13)) as PCTP from range(600)"""
    )
    apart = fill_components(rows, backward_first=backward_first)
    beside = fill_components(rows, backward_first=backward_first, beside=True)
    assert beside.columns == apart.columns
    assert sorted(map(str, beside.collect())) == sorted(map(str, apart.collect()))


def test_herd_file_is_read_and_moved_once(spark):
    from lactoscope.plans.lactation_model import herd_file_fits

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return float(x)

    counted = counted.asNondeterministic()
    rows = spark.range(0, 120, 1, 4).selectExpr(
        "date '2020-01-01' + cast(id % 5 as int) as BDAT", "string(id % 5) as EarTag", "1 as LACT", "int(id * 3 + 1) as DIM", "id",
        "if(id % 4 = 0, null, 3e0) as PCTF", "if(id % 7 = 0, null, 4e0) as PCTP",
    )
    fits = herd_file_fits(rows.withColumn("MILK", counted(F.col("id") + 30)).drop("id"))
    plan = fits._jdf.queryExecution().executedPlan().toString()
    assert sum(" Exchange " in line for line in plan.splitlines()) == 1
    assert sorted((r.records, r.npoints, r.status) for r in fits.collect()) == [(24, 24, 0)] * 5
    assert made.value == 120

import datetime as dt
import random

import pandas as pd
import pytest

from lactoscope import RunParameters, Settings
from lactoscope.operators import selection
from lactoscope.operators.selection import SLOTS
from lactoscope.sources.tables import HERD_SCHEMA, TEST_DAY_SCHEMA

RUN = RunParameters(dt.date(2022, 1, 1))
LAST = dt.date(2023, 3, 10)


def event(herd=1, animal=1, lact=1, dim=50, milk=30.0, fat=4.0, protein=3.0, when=dt.datetime(2023, 3, 1, 8)):
    return (1, herd, animal, str(animal), lact, dt.date(2019, 1, 1), dt.date(2022, 1, 1), when, dim, milk, fat, protein)


def tables(spark, events, herds=((1, 1, LAST),)):
    return spark.createDataFrame(events, TEST_DAY_SCHEMA), spark.createDataFrame(list(herds), HERD_SCHEMA)


def test_validity_rules(spark):
    kept = [event(animal=1, dim=5), event(animal=2, dim=350), event(animal=3, fat=None), event(animal=4, fat=0.0)]
    dropped = [
        event(animal=11, dim=4),
        event(animal=12, dim=351),
        event(animal=13, dim=None),
        event(animal=14, lact=0),
        event(animal=15, lact=None),
        event(animal=16, milk=None),
        event(animal=17, when=dt.datetime(2020, 3, 9, 23)),
        event(animal=18, herd=2),
        event(animal=19, herd=3),
    ]
    edge = event(animal=5, when=dt.datetime(2020, 3, 10))
    events, herds = tables(spark, [*kept, edge, *dropped], [(1, 1, LAST), (1, 2, dt.date(2022, 1, 1))])
    rows = selection.primary_records(events, herds, RUN).collect()
    assert sorted(r.SourceAnimalID for r in rows) == [1, 2, 3, 4, 5]
    assert {r.SourceAnimalID: r.ECM is None for r in rows} == {1: False, 2: False, 3: True, 4: True, 5: False}


def test_lookback_in_days(spark):
    events, herds = tables(
        spark, [event(animal=1, when=dt.datetime(2020, 3, 10)), event(animal=2, when=dt.datetime(2020, 3, 11))]
    )
    rows = selection.primary_records(events, herds, RUN, Settings(lookback_days=1094)).collect()
    assert [r.SourceAnimalID for r in rows] == [2]


def ntile(place, rows, buckets=100):
    size, extra = divmod(rows, buckets)
    wide = extra * (size + 1)
    return (place - 1) // (size + 1) + 1 if place <= wide else extra + (place - 1 - wide) // size + 1


@pytest.mark.parametrize("rows", [1, 19, 99, 100, 101, 250, 1234])
def test_ntile_of_any_group_size(spark, rows):
    rng = random.Random(rows)
    events = [event(animal=i, dim=rng.choice([5, 60, 61, 200])) for i in range(rows)]
    frame, herds = tables(spark, events)
    ranked = selection.with_percentile(selection.primary_records(frame, herds, RUN)).toPandas()
    ranked["slot"] = ranked.SourceAnimalID % SLOTS
    ranked = ranked.sort_values(["DIM", "slot", "SourceAnimalID"]).reset_index(drop=True)
    assert list(ranked.PercentileDIM) == [ntile(i + 1, rows) for i in range(rows)]


def test_percent_rank_with_ties(spark):
    events = [event(animal=i, dim=d) for i, d in enumerate([10, 10, 20, 30, 30, 30, 40])]
    events.append(event(animal=50, lact=2, dim=99))
    frame, herds = tables(spark, events)
    ranked = selection.with_percentile(selection.primary_records(frame, herds, RUN), method="percent_rank").toPandas()
    for _, group in ranked.groupby("LAGR"):
        expected = (group.DIM.rank(method="min") - 1) / max(len(group) - 1, 1)
        assert list(group.PercentileDIM) == pytest.approx(list(expected))


def test_unknown_method_is_refused(spark):
    frame, herds = tables(spark, [event()])
    with pytest.raises(ValueError):
        selection.with_percentile(selection.primary_records(frame, herds, RUN), method="median")


def test_one_group_with_most_rows(spark):
    """A hot group is ranked in many cells and still gives the plain result."""
    rng = random.Random(7)
    events = [event(animal=rng.randrange(10**9), dim=rng.choice([60, 60, 60, 61, 300])) for _ in range(4000)]
    events += [event(animal=i, herd=2, dim=rng.randrange(5, 350)) for i in range(15)]
    events += [event(animal=i, herd=3, lact=1 + i % 5, dim=rng.randrange(5, 350)) for i in range(25)]
    frame, herds = tables(spark, events, [(1, h, LAST) for h in (1, 2, 3)])
    records = selection.primary_records(frame, herds, RUN)
    kept = selection.qualifying_records(frame, herds, RUN).toPandas()

    rows = records.toPandas()
    rows["slot"] = rows.SourceAnimalID % SLOTS
    rows = rows.sort_values(["SourceHerdID", "LAGR", "DIM", "slot", "SourceAnimalID"])
    group = rows.groupby(["SourceHerdID", "TestDate", "LAGR"])
    rows["bucket"] = [ntile(p, n) for p, n in zip(group.cumcount() + 1, group.DIM.transform("size"))]
    rows = rows[rows.bucket <= 90]
    rows = rows[rows.groupby(["SourceHerdID", "TestDate"]).DIM.transform("size") >= 20]
    columns = ["SourceHerdID", "LAGR", "SourceAnimalID", "DIM"]
    expected = rows[[*columns, "bucket"]].rename(columns={"bucket": "PercentileDIM"})
    order = [*columns, "PercentileDIM"]
    pd.testing.assert_frame_equal(
        kept[order].sort_values(order).reset_index(drop=True),
        expected[order].sort_values(order).reset_index(drop=True),
        check_dtype=False,
    )
    assert sorted(kept.SourceHerdID.unique()) == [1, 3]
    dates = {r.SourceHerdID: r.N for r in selection.selected_test_dates(records).collect()}
    assert dates == kept.groupby("SourceHerdID").size().to_dict()


def test_rank_window_is_split_into_cells(spark):
    frame, herds = tables(spark, [event()])
    plan = selection.qualifying_records(frame, herds, RUN)._jdf.queryExecution().executedPlan().toString()
    ranking = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert ranking and all("slot" in line for line in ranking)

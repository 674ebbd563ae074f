import math

import pytest
from pyspark.sql import functions as F

from lactoscope.functions import expressions as X


def value(spark, column, **row):
    frame = spark.range(1).select(*[F.lit(v).cast(kind).alias(k) for k, (v, kind) in row.items()])
    return frame.select(column.alias("v")).first()["v"]


def test_energy_corrected_forms(spark):
    row = {"MILK": (40.0, "double"), "PCTF": (4.0, "double"), "PCTP": (3.0, "double")}
    exact = 40 * (0.383 * 4 + 0.242 * 3 + 0.7832) / 3.1138
    assert value(spark, X.energy_corrected(), **row) == pytest.approx(exact, rel=1e-14)
    assert value(spark, X.energy_corrected_reported(), **row) == round(exact, 1)
    row["PCTF"] = (0.0, "double")
    assert value(spark, X.energy_corrected_reported(), **row) is None
    assert value(spark, X.energy_corrected(), **row) > 0
    row["PCTF"] = (None, "double")
    assert value(spark, X.energy_corrected(), **row) is None


@pytest.mark.parametrize(
    "dim, limit, strict, sigma",
    [(30, 30, False, 1.5), (31, 30, False, 1.0), (60, 60, True, 1.0), (59, 60, True, 1.5), (None, 30, False, None)],
)
def test_error_sigma(spark, dim, limit, strict, sigma):
    assert value(spark, X.error_sigma("DIM", limit, strict=strict), DIM=(dim, "int")) == sigma


@pytest.mark.parametrize(
    "lactation, code, label", [(1, 1, "1"), (3, 3, "3"), (4, 4, "4+"), (9, 4, "4+"), (None, None, "4+")]
)
def test_group_code_and_label(spark, lactation, code, label):
    assert value(spark, X.group_code(), LACT=(lactation, "int")) == code
    assert value(spark, X.group_label(), LACT=(lactation, "int")) == label


@pytest.mark.parametrize("code, name", [(0, "HERD"), (1, "LAGR_1"), (4, "LAGR_4"), (5, None), (-1, None), (None, None)])
def test_group_name(spark, code, name):
    assert value(spark, X.group_name(), LAGR=(code, "int")) == name


def parameters(a, b, c, d):
    return {k: (v, "double") for k, v in zip("abcd", (a, b, c, d))}


def test_curve(spark):
    expected = 80 * (1 - math.exp((-2 - 50) / 20) / 2) * math.exp(-0.001 * 50)
    assert value(spark, X.curve(), DIM=(50, "int"), **parameters(80, 20, -2, 0.001)) == pytest.approx(expected)
    assert value(spark, X.curve(), DIM=(50, "int"), **parameters(80, 0, -2, 0.001)) is None


@pytest.mark.parametrize(
    "p", [(80, 20, -2, 0.001), (80, 20, -2, 0.0), (50, 12.5, 4, -0.08), (60, -40, 3, 0.002), (70, 30, 5, 0.01)]
)
def test_yield_in_closed_form_is_the_sum(spark, p):
    a, b, c, d = p
    total = sum(a * (1 - math.exp((c - t) / b) / 2) * math.exp(-d * t) for t in range(1, 306))
    assert value(spark, X.yield_to_day(305), **parameters(*p)) == pytest.approx(total, rel=1e-9)


@pytest.mark.parametrize(
    "p", [(80, 20, -2, 0.001), (80, 20, 30, 0.001), (80, 20, 13.8, 0.001), (80, 20, 13.9, 0.001),
          (-5, 20, 300, 0.001), (-5, 20, 900, 0.001), (0, 20, 1, 0.001), (80, -40, 3, 0.0), (80, -400, -10, 0.0)]
)
def test_positive_curve_agrees_with_the_grid(spark, p):
    a, b, c, d = p
    lowest = min(a * (1 - math.exp((c - t) / b) / 2) * math.exp(-d * t) for t in range(400))
    assert value(spark, X.curve_is_positive(), **parameters(*p)) == (lowest > 0)


def test_arrays(spark):
    frame = spark.range(1).select(F.array(*[F.lit(float(v)) for v in (1, 2)]).alias("p"))
    assert tuple(frame.select(*X.unpack("p")).first()) == (1.0, 2.0, None, None)
    row = parameters(2, 3, 4, 5)
    assert value(spark, X.pack(ratio=F.lit(1.5)), **row) == [3.0, 3.0, 4.0, 5.0]


@pytest.mark.parametrize("status, flag", [(0, 0), (1, 1), (2, 0), (3, 1)])
def test_no_convergence(spark, status, flag):
    assert value(spark, X.no_convergence(), status=(status, "int")) == flag

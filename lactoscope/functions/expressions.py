"""Model formulas as Spark column expressions.

Everything here stays inside whole-stage code generation; there is no Python on
the executors. Null input gives null output.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lactoscope.settings import (
    EARLY_DIM,
    EARLY_SIGMA,
    ECM_BASE,
    ECM_DIVISOR,
    ECM_FAT,
    ECM_PROTEIN,
    GROUP_NAMES,
)

PARAMETERS = ("a", "b", "c", "d")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def energy_corrected(
    milk: Column | str = "MILK", fat: Column | str = "PCTF", protein: Column | str = "PCTP"
) -> Column:
    """Energy-corrected milk, not rounded, for any component values."""
    energy = F.lit(ECM_FAT) * _col(fat) + F.lit(ECM_PROTEIN) * _col(protein) + F.lit(ECM_BASE)
    return _col(milk) * energy / F.lit(ECM_DIVISOR)


def energy_corrected_reported(
    milk: Column | str = "MILK", fat: Column | str = "PCTF", protein: Column | str = "PCTP"
) -> Column:
    """Energy-corrected milk to one decimal; null unless both components are positive."""
    positive = (_col(fat) > 0) & (_col(protein) > 0)
    return F.when(positive, F.round(energy_corrected(milk, fat, protein), 1))


def error_sigma(
    dim: Column | str = "DIM",
    limit: int = EARLY_DIM,
    inflation: float = EARLY_SIGMA,
    strict: bool = False,
) -> Column:
    """Relative error of a test day: inflated up to ``limit`` days (below it if strict)."""
    day = _col(dim)
    early = day < limit if strict else day <= limit
    return F.when(early, F.lit(inflation)).when(~early, F.lit(1.0))


def group_code(lactation: Column | str = "LACT") -> Column:
    """Lactation group 1 to 4, where 4 stands for the fourth lactation and later."""
    number = _col(lactation)
    return F.when(number >= 4, F.lit(4)).otherwise(number).cast("int")


def group_label(lactation: Column | str = "LACT") -> Column:
    """Lactation group as text, '4+' from the fourth lactation on and for null."""
    number = _col(lactation)
    return F.when(number < 4, number.cast("string")).otherwise(F.lit("4+"))


def group_name(code: Column | str = "LAGR") -> Column:
    """Name of a group code; null for codes outside the list."""
    return F.get(F.array(*[F.lit(name) for name in GROUP_NAMES]), _col(code))


def curve(
    dim: Column | str = "DIM",
    a: Column | str = "a",
    b: Column | str = "b",
    c: Column | str = "c",
    d: Column | str = "d",
) -> Column:
    """Yield on a day in milk: a * (1 - exp((c - t) / b) / 2) * exp(-d * t)."""
    day = _col(dim).cast("double")
    ramp = F.exp(F.try_divide(_col(c) - day, _col(b)))
    return _col(a) * (F.lit(1.0) - ramp / F.lit(2.0)) * F.exp(-_col(d) * day)


def curve_of(dim: Column | str, parameters: Column | str) -> Column:
    """Yield on a day in milk for parameters held in one array column."""
    return curve(dim, *unpack(parameters))


def pack(a="a", b="b", c="c", d="d", ratio: Column | None = None) -> Column:
    """Parameters as one array column; ``ratio`` scales the level a."""
    level = _col(a) if ratio is None else ratio * _col(a)
    return F.array(level, _col(b), _col(c), _col(d))


def unpack(parameters: Column | str) -> list[Column]:
    """The four parameters of an array column; null where the array is too short."""
    return [F.get(_col(parameters), F.lit(i)) for i in range(4)]


def residual(value: Column | str, dim: Column | str = "DIM", **parameters) -> Column:
    return _col(value) - curve(dim, **parameters)


def no_convergence(status: Column | str = "status") -> Column:
    """1 for a fit that gave no parameters, else 0."""
    return F.when(_col(status).isin(1, 3), F.lit(1)).otherwise(F.lit(0))


def level_too_low(a: Column | str = "a") -> Column:
    """1 for a level below one, the sign of a failed fit where only parameters are kept."""
    return F.when(_col(a) < 1.0, F.lit(1)).otherwise(F.lit(0))


def _decay_sum(rate: Column, days: int) -> Column:
    # Geometric series of exp(-rate * t) over t = 1..days; expm1 keeps it exact near 0.
    return F.when(rate == 0, F.lit(float(days))).otherwise(
        F.try_divide(-F.expm1(-rate * F.lit(float(days))), F.expm1(rate))
    )


def yield_to_day(days: int = 305, a="a", b="b", c="c", d="d") -> Column:
    """Yield summed over days 1..days, in closed form: no row is made per day."""
    inverse = F.try_divide(F.lit(1.0), _col(b))
    ramp = F.exp(_col(c) * inverse) / F.lit(2.0)
    return _col(a) * (_decay_sum(_col(d), days) - ramp * _decay_sum(_col(d) + inverse, days))


def curve_is_positive(first: int = 0, last: int = 399, a="a", b="b", c="c") -> Column:
    """True if the curve stays above zero on every day from first to last.

    The sign depends on (c - t) / b only, which is monotone in t, so the two end
    days decide and no day grid has to be expanded.
    """
    at_first = F.try_divide(_col(c) - F.lit(float(first)), _col(b))
    at_last = F.try_divide(_col(c) - F.lit(float(last)), _col(b))
    limit = F.lit(math.log(2.0))
    upright = (_col(a) > 0) & (F.greatest(at_first, at_last) < limit)
    flipped = (_col(a) < 0) & (F.least(at_first, at_last) > limit)
    return upright | flipped

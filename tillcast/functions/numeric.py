"""Numeric expressions: exact money sums, guarded division, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Money is accounted in 1/10000 of the currency unit, so a sum is a sum of
# integers: the same total whatever order the partitions arrive in. The
# decimal keeps totals exact beyond the 64-bit range.
MONEY_UNIT = 10000.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_units(amount: Column | str) -> Column:
    """Exact sum of a double money column in accounting units."""
    return F.sum(F.rint(_col(amount) * MONEY_UNIT).cast("long").cast("decimal(18,0)"))


def as_money(units: Column) -> Column:
    """Accounting units as a double amount."""
    return units.cast("double") / MONEY_UNIT


def money_sum(amount: Column | str) -> Column:
    """Exact, order-independent sum of a double money column."""
    return as_money(money_units(amount))


def money_avg(amount: Column | str) -> Column:
    """Mean over the non-null rows, from the exact sum in a single division."""
    rows = F.nullif(F.count(_col(amount)), F.lit(0)).cast("double")
    return money_units(amount).cast("double") / (rows * MONEY_UNIT)


def mean_of(value: Column | str) -> Column:
    """Mean of an integer column from its exact integer sum; null if no rows."""
    return (F.sum(_col(value)).cast("double")
            / F.nullif(F.count(_col(value)), F.lit(0)).cast("double"))


def safe_div(num: Column | str, den: Column | str, default: float | None = None) -> Column:
    """``num / den`` as double; ``default`` (null if not given) when ``den`` is 0 or null."""
    n, d = _col(num).cast("double"), _col(den).cast("double")
    return F.when(d != 0, F.try_divide(n, d)).otherwise(F.lit(default).cast("double"))


def percent_change(current: Column | str, previous: Column | str,
                   default: float | None = None) -> Column:
    """Change against ``previous`` in percent; ``default`` when there is no base."""
    c, p = _col(current).cast("double"), _col(previous).cast("double")
    return safe_div(c - p, p, default) * 100


def percent_of(part: Column | str, whole: Column | str,
               default: float | None = None) -> Column:
    """``part`` as a percentage of ``whole``."""
    return safe_div(part, whole, default) * 100


def to_long(value: Column | str) -> Column:
    """Whole part, truncated towards zero."""
    return _col(value).cast("double").cast("long")


def clamp(value: Column, low: float, high: float) -> Column:
    """Keep ``value`` within ``[low, high]``; null stays null."""
    bounded = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return F.when(value.isNotNull(), bounded)


def ladder(value: Column, steps: list[tuple[float, object]], otherwise: object,
           at_least: bool = False) -> Column:
    """First matching step of a score table.

    ``value < bound`` by default; with ``at_least`` the test is ``value >= bound``.
    """
    expr = None
    for bound, result in steps:
        test = (value >= bound) if at_least else (value < bound)
        expr = F.when(test, result) if expr is None else expr.when(test, result)
    return expr.otherwise(otherwise)


def finite(value: Column | str) -> Column:
    """Null for NaN and both infinities, otherwise the value."""
    v = _col(value)
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)

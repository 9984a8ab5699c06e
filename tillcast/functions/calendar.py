"""Calendar expressions on date columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels used in reports.
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
               "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_key(date: Column | str = "Date") -> Column:
    """``yyyy-MM``."""
    return F.date_format(_col(date), "yyyy-MM")


def week_key(date: Column | str = "Date") -> Column:
    """``yyyy-Www`` with weeks that start on Sunday; days before the first Sunday are W00."""
    d = _col(date)
    week = F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / F.lit(7)).cast("string")
    return F.concat(F.year(d).cast("string"), F.lit("-W"), F.lpad(week, 2, "0"))


def day_name(weekday: Column | str) -> Column:
    """English name for a weekday number with Monday = 0."""
    names = F.array(*[F.lit(n) for n in DAY_NAMES])
    return F.element_at(names, _col(weekday).cast("int") + 1)


def month_name(month: Column | str) -> Column:
    """Three-letter name for a month number 1..12."""
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    return F.element_at(names, _col(month).cast("int"))


def month_start(year: Column | str = "Year", month: Column | str = "Month") -> Column:
    return F.make_date(_col(year), _col(month), F.lit(1))


def month_sin(month: Column | str = "Month") -> Column:
    return F.sin(_col(month) * (2 * math.pi / 12))


def month_cos(month: Column | str = "Month") -> Column:
    return F.cos(_col(month) * (2 * math.pi / 12))


# Festival periods as (start month, start day, end month, end day).
FESTIVALS = {
    "diwali": (10, 15, 11, 1),
    "big_billion_days": (10, 15, 10, 25),
    "amazon_prime_day": (7, 10, 7, 20),
}


def in_period(date: Column | str, period: tuple[int, int, int, int]) -> Column:
    """Whether the day of the year lies in the period, both ends included."""
    d = _col(date)
    key = F.month(d) * 100 + F.dayofmonth(d)
    return key.between(period[0] * 100 + period[1], period[2] * 100 + period[3])

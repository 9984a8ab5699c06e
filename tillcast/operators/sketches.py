"""Distinct counts over growing data from stored daily sketches.

A day's sketch of a column stands for the set of its values, in at most 2^``precision`` bytes.
Sketches of any days merge to that of their union, so a month, a quarter or a sliding window is
counted from its days' sketches, without a look at the sales. A load that is added twice, or
days that come in several loads, change nothing but the estimate's last digits: a union with the
same values is the same set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions.calendar import month_key
from tillcast.sources.versions import VersionedTable

PRECISION = 14


def standard_error(precision: int = PRECISION) -> float:
    """Relative standard error of a count."""
    return 1.04 / 2 ** (precision / 2)


def daily_sketches(sales: DataFrame, columns: Sequence[str], precision: int = PRECISION) -> DataFrame:
    """``Date`` and a sketch per column; rows without a date belong to no day."""
    return sales.where(F.col("Date").isNotNull()).groupBy("Date").agg(*[
        F.hll_sketch_agg(F.col(c).cast("string"), F.lit(precision)).alias(c) for c in columns])


def estimates(sketches: DataFrame, period: Column, columns: Sequence[str]) -> DataFrame:
    """``period`` and the estimated distinct values per column of the days in it."""
    return sketches.groupBy(period.alias("period")).agg(*[
        F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])


class DistinctStore:
    """The daily sketches of all loads so far, as a versioned table."""

    def __init__(self, spark: SparkSession, folder: str, columns: Sequence[str],
                 precision: int = PRECISION):
        self.table = VersionedTable(spark, folder)
        self.columns, self.precision = list(columns), precision

    def add(self, sales: DataFrame, load: str) -> int:
        """Adds a load; the number of days in it, 0 if the load is already in."""
        return self.table.append(daily_sketches(sales, self.columns, self.precision), load)

    def monthly(self) -> DataFrame:
        return estimates(self.table.read(), month_key("Date"), self.columns)

    def trailing(self, last_day: str, days: int) -> DataFrame:
        """Distinct values of the ``days`` days up to ``last_day``; only their sketches are read."""
        end = F.lit(last_day).cast("date")
        within = self.table.read().where(F.col("Date").between(F.date_sub(end, days - 1), end))
        return estimates(within, F.lit(last_day), self.columns)

    def compact(self) -> None:
        """One sketch per day and column."""
        stored = self.table.read().groupBy("Date").agg(*[
            F.hll_union_agg(c).alias(c) for c in self.columns])
        self.table.replace(stored)

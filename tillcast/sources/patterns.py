"""Seasonal and yearly patterns from mergeable partial sums.

What the patterns need of the sales is one cell per SKU and month. Sums of cells over any
split of the sales add up to the cells of the whole, so each load is aggregated on its own and
its cells are appended: a new month, a late one or a correction folds in without a look at the
sales history, and the patterns are worked out from the cells alone. Cells that several loads
have added to are merged when the patterns are read, and for good by ``compact``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.operators.forecast import seasonal_patterns, yoy_patterns
from tillcast.sources.versions import VersionedTable

CELL = ["SKU", "Year", "Month"]


def monthly_cells(sales: DataFrame) -> DataFrame:
    """``SKU, Year, Month, q, n``: units and rows per SKU and month; rows without a SKU or a
    date have no cell."""
    dated = sales.where(F.col("SKU").isNotNull() & F.col("Date").isNotNull())
    return dated.groupBy("SKU", F.year("Date").alias("Year"), F.month("Date").alias("Month")).agg(
        F.sum("Quantity").alias("q"), F.count("*").alias("n"))


def merged(cells: DataFrame) -> DataFrame:
    """One row per SKU and month; a cell whose rows were all taken back is gone."""
    return cells.groupBy(*CELL).agg(F.sum("q").alias("q"), F.sum("n").alias("n")).where("n > 0")


class PatternStore:
    """The cells of all loads so far, as a versioned table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.table = VersionedTable(spark, folder)

    def fold(self, sales: DataFrame, load: str | None = None) -> int:
        """Adds a load; the number of cells it touched, 0 if the load is already in."""
        return self.table.append(monthly_cells(sales), load)

    def take_back(self, sales: DataFrame, load: str) -> int:
        """Subtracts rows that were loaded by mistake."""
        cells = monthly_cells(sales)
        return self.table.append(cells.select(*CELL, (-F.col("q")).alias("q"), (-F.col("n")).alias("n")),
                                 load)

    def monthly(self) -> DataFrame:
        return merged(self.table.read()).select(*CELL, F.col("q").alias("Quantity"))

    def patterns(self, min_months: int = 12) -> tuple[DataFrame, DataFrame]:
        """Seasonal factors and yearly growth, as a rebuild over all sales gives them."""
        monthly = self.monthly()
        return seasonal_patterns(monthly, min_months), yoy_patterns(monthly, min_months)

    def compact(self) -> None:
        """Merges the cells of all loads into one segment."""
        now = self.table.version()
        self.table.replace(merged(self.table.read(now.number)))

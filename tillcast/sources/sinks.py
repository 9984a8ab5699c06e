"""Sinks: result tables, catalog tables, CSV exports and report bundles.

Files are written by the tasks that hold the rows. Nothing is gathered into
one task, so an export is a folder of part files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillcast.sources.schemas import REQUIRED_SALES, REQUIRED_SKU_MASTER


def write_results(results: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict:
    """Each result table in its own folder below ``folder``; returns the paths."""
    paths = {}
    for name, frame in results.items():
        path = f"{folder.rstrip('/')}/{name}"
        writer = frame.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(path)
        paths[name] = path
    return paths


def save_tables(tables: dict[str, DataFrame], database: str | None = None,
                folder: str | None = None) -> list[str]:
    """Replace catalog tables with the given frames."""
    saved = []
    for name, frame in tables.items():
        full = f"{database}.{name}" if database else name
        writer = frame.write.mode("overwrite").format("parquet")
        if folder:
            writer = writer.option("path", f"{folder.rstrip('/')}/{name}")
        writer.saveAsTable(full)
        saved.append(full)
    return saved


def write_history(history: DataFrame, path: str) -> None:
    """Pattern-period rows partitioned by year, so later reads prune by year."""
    # Rows of a year meet before the write; adaptive execution splits a large year.
    (history.hint("rebalance", "Year").write.mode("overwrite").partitionBy("Year")
     .parquet(path))


def export_schedule_csv(schedule: DataFrame, path: str) -> None:
    schedule.write.mode("overwrite").option("header", True).csv(path)


def flatten_comprehensive(table: DataFrame) -> DataFrame:
    """Export layout: report column names, godown array as ``G(q); G(q)`` text."""
    parts = F.transform("godown_distribution", lambda g: F.concat(
        g["godown"], F.lit("("), g["quantity"].cast("string"), F.lit(")")))
    return table.select(
        F.col("product_name").alias("Product_Name"), F.col("sku").alias("SKU"),
        F.col("current_monthly_quantity").alias("Current_Monthly_Quantity"),
        F.col("predicted_monthly_quantity").alias("Predicted_Monthly_Quantity"),
        F.col("growth_rate_percent").alias("Growth_Rate_Percent"),
        F.col("lead_time_days").alias("Lead_Time_Days"),
        F.col("recommended_order_quantity").alias("Recommended_Order_Quantity"),
        F.col("current_stock").alias("Current_Stock"),
        F.col("days_remaining").alias("Days_Remaining"), F.col("urgency").alias("Urgency"),
        F.col("estimated_cost_inr").alias("Estimated_Cost_INR"),
        F.col("confidence").alias("Confidence"),
        F.array_join(parts, "; ").alias("Godown_Distribution"),
        F.col("seasonal_multiplier").alias("Seasonal_Multiplier"))


def export_comprehensive_csv(table: DataFrame, path: str) -> None:
    """Flattened table with every field quoted."""
    (flatten_comprehensive(table).write.mode("overwrite")
     .option("header", True).option("quoteAll", True).csv(path))


def title_case_headers(frame: DataFrame) -> DataFrame:
    """``recommended_qty`` becomes ``Recommended Qty``."""
    return frame.toDF(*[name.replace("_", " ").title() for name in frame.columns])


def schedule_bundle(schedule: DataFrame, urgency_summary: DataFrame) -> dict[str, DataFrame]:
    """Sheets of the schedule report."""
    return {
        "Ordering Schedule": title_case_headers(schedule),
        "Summary by Urgency": urgency_summary,
        "Critical Orders Only": schedule.where(F.col("urgency") == "CRITICAL"),
    }


# Fixed value: what the report writes where a SKU without an order has no value.
NO_ORDER = "N/A"


def with_no_order_text(comprehensive: DataFrame) -> DataFrame:
    """The table as it is written: lead time and days remaining are text, ``N/A`` where a SKU has
    no order."""
    return comprehensive.withColumns({
        name: F.coalesce(F.col(name).cast("string"), F.lit(NO_ORDER))
        for name in ("Lead_Time_Days", "Days_Remaining")})


def comprehensive_bundle(comprehensive: DataFrame, godown_summary: DataFrame,
                         sku_godown: DataFrame, growth_over: float = 50) -> dict[str, DataFrame]:
    """Sheets of the comprehensive report."""
    shown = with_no_order_text(comprehensive)
    return {
        "Comprehensive_Analysis": shown,
        "Godown_Summary": godown_summary,
        "SKU_by_Godown": sku_godown,
        "Critical_Orders_Only": shown.where(F.col("Urgency") == "CRITICAL"),
        "High_Growth_SKUs": shown.where(F.col("Growth_Rate_Percent") > growth_over),
    }


def write_bundle(sheets: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """One CSV folder per sheet."""
    named = {name.replace(" ", "_").lower(): frame for name, frame in sheets.items()}
    return write_results(named, folder, "csv")


class RejectedUpload(ValueError):
    """An upload lacks required columns."""


def check_columns(frame: DataFrame, required: list[str]) -> None:
    missing = [name for name in required if name not in frame.columns]
    if missing:
        raise RejectedUpload(f"upload lacks {', '.join(missing)}; it needs {', '.join(required)}")


def ingest_sales(upload: DataFrame, path: str) -> int:
    """Append a sales upload to the stored table; the number of rows stored."""
    return _ingest(upload, REQUIRED_SALES, path, "append")


def ingest_sku_master(upload: DataFrame, path: str) -> int:
    """Replace the stored SKU master with an upload; the number of rows stored."""
    return _ingest(upload, REQUIRED_SKU_MASTER, path, "overwrite")


def _ingest(upload: DataFrame, required: list[str], path: str, mode: str) -> int:
    check_columns(upload, required)
    written = Observation()
    (upload.observe(written, F.count(F.lit(1)).alias("rows"))
     .write.mode(mode).parquet(path))
    return written.get["rows"]


class PatternCache:
    """Seasonal and yearly patterns kept as two tables, rebuilt when either is missing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.paths = {name: f"{folder.rstrip('/')}/{name}" for name in ("seasonal", "yoy")}

    def load(self) -> tuple[DataFrame, DataFrame] | None:
        try:
            return tuple(self.spark.read.parquet(self.paths[n]) for n in ("seasonal", "yoy"))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def is_valid(self) -> bool:
        return self.load() is not None

    def load_or_build(self, build: Callable[[], tuple[DataFrame, DataFrame]]
                      ) -> tuple[DataFrame, DataFrame]:
        found = self.load()
        if found is None:
            for name, frame in zip(("seasonal", "yoy"), build()):
                frame.write.mode("overwrite").parquet(self.paths[name])
            found = self.load()
        return found

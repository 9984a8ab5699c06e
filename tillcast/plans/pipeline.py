"""The chain sales → forecast → stock → orders → reports."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from tillcast.operators import forecast, replenish, sales
from tillcast.sources import sinks
from tillcast.sources.readers import moq_or_estimate
from tillcast.sources.tables import RetailTables

AS_OF = "2001-11-05"


class OrderingChain:
    """Lazy frames of the chain. Nothing runs until a result is read or written.

    ``top_n`` limits the forecast to the best SKUs by revenue, as the report
    for a shop owner does; None plans the whole catalogue.
    """

    # Written name of each stage, in order.
    STAGES = {"predictions": "next_month_predictions", "reorder": "reorder_analysis",
              "schedule": "ordering_schedule"}

    def __init__(self, tables: RetailTables, top_n: int | None = None):
        self.tables = tables
        self.top_n = top_n

    @cached_property
    def sku_master(self) -> DataFrame:
        return self.tables.sku_master()

    @cached_property
    def predictions(self) -> DataFrame:
        recent = self.tables.recent("Date", "SKU", "Quantity", "Amount")
        return forecast.predict_next_month(recent, self.tables.history("SKU"),
                                           self.sku_master, self.top_n)

    @cached_property
    def moq(self) -> DataFrame:
        return moq_or_estimate(self.tables.moq_leadtime(),
                               replenish.estimate_moq(self.predictions))

    @cached_property
    def inventory(self) -> DataFrame:
        return replenish.estimate_inventory(self.predictions)

    @cached_property
    def reorder(self) -> DataFrame:
        return replenish.reorder_points(self.predictions, self.inventory, self.moq)

    @cached_property
    def schedule(self) -> DataFrame:
        return replenish.ordering_schedule(self.reorder)

    @cached_property
    def comprehensive(self) -> DataFrame:
        return replenish.comprehensive_ordering(
            self.predictions, self.tables.recent("SKU", "Godown", "Quantity"), self.schedule,
            self.sku_master)

    @cached_property
    def comprehensive_batch(self) -> DataFrame:
        return replenish.comprehensive_ordering_batch(
            self.predictions, self.tables.recent("Date", "SKU", "Godown", "Quantity", "Amount"),
            self.schedule)


    def staged(self, folder: str) -> "OrderingChain":
        """Writes forecast, reorder analysis and schedule, each computed from the written
        one before it.

        Reports that use several stages then read small tables, whatever the
        optimizer makes of the shared plan, and a lost executor costs at most
        the current stage.
        """
        for stage, name in self.STAGES.items():
            path = sinks.write_results({name: getattr(self, stage)}, folder)[name]
            self.__dict__[stage] = self.tables.spark.read.parquet(path)
        return self


def run_pipeline(tables: RetailTables, folder: str, top_n: int | None = None,
                 as_of: str = AS_OF) -> dict[str, str]:
    """Runs exploration, forecast and ordering and writes every result below ``folder``."""
    spark = tables.spark
    everything = tables.sales("Date", "SKU", "Quantity", "Amount", "Orderid")
    paths = sinks.write_results({
        "complete_sku_analysis": sales.sku_performance(everything),
        "monthly_trends": sales.monthly_trends(everything)}, folder)
    paths |= sinks.write_results({"top_skus_analysis": sales.top_skus(
        spark.read.parquet(paths["complete_sku_analysis"]))}, folder)
    chain = OrderingChain(tables, top_n).staged(folder)
    paths |= {name: f"{folder.rstrip('/')}/{name}" for name in chain.STAGES.values()}
    return paths | sinks.write_results({
        "ordering_summary": replenish.ordering_summary(chain.reorder, chain.schedule, as_of),
        "comprehensive_ordering": chain.comprehensive}, folder)

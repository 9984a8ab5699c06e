"""Logical sales tables over the order-line star schema of the test data.

A deployment that already stores a flat sales table reads it with
``readers.read_sales`` and does not need this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions.numeric import safe_div

RECENT_FROM = "1999-11-01"
RESTART_YEAR = 2000
POST_RESTART_YEAR = 2001
CHANNELS = ["F", "O"]

_FROM_SUPPLIER = {"Godown", "Statefrom"}
_FROM_ORDER = {"Stateto"}
_ALL = ["Date", "SKU", "Quantity", "Amount", "Rate", "Partyname", "Godown", "Statefrom",
        "Stateto", "Orderid"]


class RetailTables:
    """Builds the logical tables, joining only the dimensions a caller asks for.

    ``grain`` chooses the SKU: ``brand_type`` (a product line), ``brand``, or
    ``part`` (one SKU per part key, the high-cardinality case). Dimension
    joins carry no hint: Spark broadcasts a dimension while its size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges it beyond.
    """

    def __init__(self, spark: SparkSession, root: str, grain: str = "brand_type",
                 recent_from: str = RECENT_FROM):
        self.spark = spark
        self.root = root.rstrip("/")
        self.grain = grain
        self.recent_from = recent_from
        self._read: dict[str, DataFrame] = {}

    def at_grain(self, grain: str) -> "RetailTables":
        other = RetailTables(self.spark, self.root, grain, self.recent_from)
        other._read = self._read
        return other

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        """A stored table; its files are listed and its schema read once per instance."""
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(self.path(name))
        return self._read[name]

    # -- dimensions ---------------------------------------------------------

    def _sku_of_part(self) -> Column:
        return {
            "brand_type": F.concat(F.col("p_brand"), F.lit("/"), F.col("p_type")),
            "brand": F.col("p_brand"),
            "part": F.col("p_partkey").cast("string"),
        }[self.grain]

    def _nation(self, key: str, name: str) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").alias(key),
                                           F.col("n_name").alias(name))

    def _suppliers(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"),
                                             F.col("s_name").alias("Godown"), "s_nationkey")

    def _order_states(self) -> DataFrame:
        buyers = (self.table("customer")
                  .join(self._nation("c_nationkey", "Stateto"), "c_nationkey", "left")
                  .select(F.col("c_custkey").alias("o_custkey"), "Stateto"))
        return (self.table("orders").select("o_orderkey", "o_custkey")
                .join(buyers, "o_custkey", "left")
                .select(F.col("o_orderkey").alias("l_orderkey"), "Stateto"))

    # -- facts --------------------------------------------------------------

    def _lines(self, since: str | None, until: str | None) -> DataFrame:
        lines = self.table("lineitem")
        if since:
            lines = lines.where(F.col("l_shipdate") >= F.lit(since).cast("date"))
        if until:
            lines = lines.where(F.col("l_shipdate") < F.lit(until).cast("date"))
        return lines

    def _facts(self, lines: DataFrame, cols: tuple[str, ...], sign: int = 1) -> DataFrame:
        wanted = list(cols) or list(_ALL)
        joined = lines
        if "SKU" in wanted and self.grain != "part":
            skus = self.table("part").select(F.col("p_partkey").alias("l_partkey"),
                                             self._sku_of_part().alias("SKU"))
            joined = joined.join(skus, "l_partkey", "left")
        if _FROM_SUPPLIER & set(wanted):
            joined = joined.join(self._suppliers(), "l_suppkey", "left")
        if "Statefrom" in wanted:
            # After the suppliers: Spark takes a joined dimension for too large to broadcast.
            joined = joined.join(self._nation("s_nationkey", "Statefrom"), "s_nationkey", "left")
        if _FROM_ORDER & set(wanted):
            joined = joined.join(self._order_states(), "l_orderkey", "left")
        exprs = {
            "Date": F.col("l_shipdate").cast("date"),
            "SKU": F.col("l_partkey").cast("string") if self.grain == "part" else F.col("SKU"),
            "Quantity": F.col("l_quantity").cast("long") * sign,
            "Amount": F.col("l_extendedprice") * (1 - F.col("l_discount")) * sign,
            "Rate": safe_div("l_extendedprice", "l_quantity"),
            "Partyname": F.col("l_linestatus"),
            "Godown": F.col("Godown") if "Godown" in wanted else None,
            "Statefrom": F.col("Statefrom") if "Statefrom" in wanted else None,
            "Stateto": F.col("Stateto") if "Stateto" in wanted else None,
            "Orderid": F.col("l_orderkey").cast("string"),
        }
        return joined.select(*[exprs[name].alias(name) for name in wanted])

    def sales(self, *cols: str, since: str | None = None,
              until: str | None = None) -> DataFrame:
        """The whole sales table, or its ``[since, until)`` slice, with the given columns."""
        return self._facts(self._lines(since, until), cols)

    def recent(self, *cols: str) -> DataFrame:
        return self.sales(*cols, since=self.recent_from)

    def history(self, *cols: str) -> DataFrame:
        return self.sales(*cols, until=self.recent_from)

    def returns(self, *cols: str) -> DataFrame:
        """Returned lines, with negative quantity and amount."""
        lines = self._lines(None, None).where(F.col("l_returnflag") == "R")
        return self._facts(lines, cols, sign=-1)

    # -- masters ------------------------------------------------------------

    def sku_entries(self) -> DataFrame:
        """SKU master as it is kept: one entry per part, later entries override earlier ones."""
        return self.table("part").select(self._sku_of_part().alias("sku"),
                                         F.col("p_name").alias("category"),
                                         F.col("p_partkey").alias("entry"))

    def sku_master(self) -> DataFrame:
        return (self.sku_entries().groupBy("sku")
                .agg(F.max_by("category", "entry").alias("category")))

    def moq_leadtime(self) -> DataFrame:
        """Supplier terms per SKU. Promotional lines have no terms on file."""
        size = F.sum("p_size")
        return (self.table("part").where(F.col("p_type") != "PROMO")
                .groupBy(self._sku_of_part().alias("sku"))
                .agg(((size % 50 + 1) * 10).cast("long").alias("moq"),
                     (size % 14 + 3).cast("int").alias("lead_time_days"),
                     F.min("p_name").alias("supplier"),
                     F.lit(100.0).alias("unit_cost")))

    def register_views(self) -> None:
        """The logical tables as temporary views for ``spark.sql``."""
        views = {"sales": self.sales(), "recent_sales": self.recent(),
                 "historical_sales": self.history(), "returns": self.returns(),
                 "sku_master": self.sku_master(), "moq_leadtime": self.moq_leadtime()}
        for name, frame in views.items():
            frame.createOrReplaceTempView(name)

    # -- stand-ins for planning tables ---------------------------------------

    def closing_stock(self) -> DataFrame:
        """Stock snapshots per day, channel, godown and SKU.

        The test data has no stock table; the units handled at a location on
        a day stand in for its closing quantity.
        """
        return (self.stock_lines(self.table("lineitem")).groupBy("Date", "channel", "godown", "sku")
                .agg(F.sum("closing_qty").alias("closing_qty")))

    def location_days(self) -> DataFrame:
        """The snapshots with ``n_rows``, the sales of the day at the location."""
        return (self.stock_lines(self.table("lineitem")).groupBy("Date", "channel", "godown", "sku")
                .agg(F.sum("closing_qty").alias("closing_qty"), F.count("closing_qty").alias("n_rows")))

    def stock_lines(self, lines: DataFrame) -> DataFrame:
        """The units of each line as a part of its day's snapshot."""
        return self._facts(lines, ("Date", "Partyname", "Godown", "SKU", "Quantity")).select(
            "Date", F.col("Partyname").alias("channel"), F.col("Godown").alias("godown"),
            F.col("SKU").alias("sku"), F.col("Quantity").alias("closing_qty"))

    def godown_master(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("ID"), F.col("s_name").alias("GodownName"),
            F.concat(F.lit("WH-"), F.col("s_suppkey").cast("string")).alias("Alias1"),
            F.upper("s_name").alias("Alias2"))

    def raw_godown_lines(self) -> DataFrame:
        """Lines that name their godown by one of its three spellings."""
        names = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
        raw = (F.when(F.col("l_returnflag") == "A",
                      F.concat(F.lit("WH-"), F.col("l_suppkey").cast("string")))
               .when(F.col("l_returnflag") == "N", F.upper("s_name"))
               .otherwise(F.col("s_name")))
        return (self.table("lineitem").join(names, "l_suppkey", "left")
                .select(raw.alias("Godown"), F.col("l_quantity").cast("long").alias("Quantity")))

    def bom(self) -> DataFrame:
        """Bill of materials: a brand is assembled from part types."""
        return (self.table("part").groupBy(F.col("p_brand").alias("ItemIDManu"),
                                           F.col("p_type").alias("ItemID"))
                .agg(F.max("p_size").cast("long").alias("ItemQty"))
                .withColumn("IsActive", F.lit(True)))

    def raw_material(self) -> DataFrame:
        """Units on hand per part type."""
        types = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
        per_part = (self.table("lineitem").groupBy("l_partkey")
                    .agg(F.sum(F.col("l_quantity").cast("long")).alias("q")))
        return (per_part.join(types, "l_partkey")
                .groupBy(F.col("p_type").alias("ItemID")).agg(F.sum("q").alias("on_hand")))

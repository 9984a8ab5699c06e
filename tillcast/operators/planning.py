"""Stock by location, shortfalls, transfers, bills of material and lead times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.frames import running_before
from tillcast.functions.numeric import safe_div, to_long


def safety_stock_z(profile: DataFrame, moq: DataFrame, z: float = 1.65,
                   default_lead: int = 14) -> DataFrame:
    """Safety stock from the spread of daily units over the lead time."""
    lead = F.coalesce("lead_time_days", F.lit(default_lead))
    joined = profile.select("SKU", "daily_std").join(
        moq.select(F.col("sku").alias("SKU"), "lead_time_days"), "SKU", "left")
    return joined.select("SKU", lead.alias("lead_time_days"),
                         F.round(F.sqrt(lead) * z * F.col("daily_std"), 4)
                         .alias("safety_stock"))


def urgency_by_cover(stock: Column, daily: Column) -> Column:
    """Urgency from the days of demand the stock covers."""
    cover = F.when(daily > 0, safe_div(stock, daily)).otherwise(999.0)
    return (F.when(cover <= 3, "CRITICAL").when(cover <= 7, "HIGH").when(cover <= 14, "MEDIUM")
            .otherwise("LOW"))


def moq_round_up(quantity: Column, moq: Column) -> Column:
    """At least one minimum order, then whole multiples of it."""
    packs = F.ceil(safe_div(quantity, moq))
    return F.when(quantity < moq, moq).otherwise(packs * moq).cast("long")


def order_date(as_of: Column, days_left: Column, lead: Column) -> Column:
    """Day to order so that stock arrives before it runs out."""
    wait = F.greatest(F.lit(0), to_long(days_left - lead)).cast("int")
    return F.date_add(as_of, wait)


def order_plan(reorder: DataFrame, as_of: str) -> DataFrame:
    """Urgency by cover, order in whole packs, and order date per SKU."""
    stock, daily = F.col("current_stock"), F.col("predicted_daily_demand")
    return reorder.select(
        "sku", urgency_by_cover(stock, daily).alias("urgency"),
        moq_round_up(F.col("recommended_order_qty"), F.col("moq")).alias("order_quantity"),
        order_date(F.lit(as_of).cast("date"), F.col("days_remaining"), F.col("lead_time_days"))
        .alias("order_date"))


# -- stock by location --------------------------------------------------------


LOCATION = ["channel", "godown", "sku"]


def closing_stock_latest(snapshots: DataFrame) -> DataFrame:
    """Last snapshot per location and SKU."""
    return snapshots.groupBy(*LOCATION).agg(
        F.max("Date").alias("as_of"), F.max_by("closing_qty", "Date").alias("closing_qty"))


def closing_stock_movement(snapshots: DataFrame) -> DataFrame:
    """Change against the previous snapshot of the location and SKU."""
    by_day = Window.partitionBy(*LOCATION).orderBy("Date")
    return snapshots.withColumn(
        "movement", F.col("closing_qty") - F.lag("closing_qty").over(by_day))


def resolve_godown(rows: DataFrame, master: DataFrame, name: str = "Godown") -> DataFrame:
    """Adds ``GodownName`` for a name or either alias; null when nothing matches."""
    spellings = master.select(
        "GodownName", F.explode(F.array("GodownName", "Alias1", "Alias2")).alias("_s")
    ).where(F.col("_s").isNotNull()).groupBy(F.trim("_s").alias("_s")).agg(
        F.min("GodownName").alias("GodownName"))
    return (rows.join(spellings, F.trim(F.col(name)) == F.col("_s"), "left").drop("_s"))


def location_positions(days: DataFrame, last: int = 3, growth: float = 0.1) -> DataFrame:
    """``sku, channel, godown, demand, closing_qty, as_of, total_qty`` per location.

    ``days``: one row per location and day with ``closing_qty``, the units of that day, and
    ``n_rows``, the sales behind it. Expected monthly demand is the mean of the last ``last``
    months plus growth, from the second month on, else the mean sale. Demand and stock come out
    of one pass over the days, so nothing is joined.
    """
    months = days.groupBy(*LOCATION, F.trunc("Date", "month").alias("_month")).agg(
        F.sum("closing_qty").alias("q"), F.sum("n_rows").alias("n"),
        F.max(F.struct("Date", "closing_qty")).alias("last"))
    back = Window.partitionBy(*LOCATION).orderBy(F.col("_month").desc())
    late = F.col("_r") <= last
    known = months.withColumn("_r", F.row_number().over(back)).groupBy(*LOCATION).agg(
        safe_div(F.sum(F.when(late, F.col("q"))), F.count_if(late)).alias("recent_mean"),
        F.sum("q").alias("total_qty"), F.max("last").alias("last"))
    return known.select(
        "sku", "channel", "godown", (F.col("recent_mean") * F.lit(1 + growth)).alias("demand"),
        F.col("last.closing_qty").alias("closing_qty"), F.col("last.Date").alias("as_of"), "total_qty")


def shortfall(demand: DataFrame, stock: DataFrame) -> DataFrame:
    """Demand that stock does not cover, per warehouse, per channel and overall.

    Both inputs are keyed by ``sku, channel, godown``. They are stacked and
    aggregated once; no location-level join is needed.
    """
    keys = ["sku", "channel", "godown"]
    return _levels(demand.select(*keys, F.col("demand").cast("double"),
                                 F.lit(0).cast("double").alias("stock")).unionByName(
        stock.select(*keys, F.lit(0).cast("double").alias("demand"),
                     F.col("closing_qty").cast("double").alias("stock"))))


def shortfall_of(positions: DataFrame) -> DataFrame:
    """The same from ``location_positions``."""
    return _levels(positions.select(
        "sku", "channel", "godown", F.coalesce("demand", F.lit(0.0)).alias("demand"),
        F.coalesce("closing_qty", F.lit(0)).cast("double").alias("stock")))


def _levels(stacked: DataFrame) -> DataFrame:
    keys = ["sku", "channel", "godown"]
    cells = stacked.groupBy(*keys).agg(F.sum("demand").alias("demand"),
                                       F.sum("stock").alias("stock"))
    s, c, g = (F.col(k) for k in keys)
    levels = cells.groupingSets([[s, c, g], [s, c], [s]], s, c, g).agg(
        F.round(F.sum("demand"), 4).alias("demand"), F.sum("stock").alias("stock"),
        F.grouping("channel").alias("_c"), F.grouping("godown").alias("_g"))
    level = (F.when(F.col("_c") == 1, "overall").when(F.col("_g") == 1, "channel")
             .otherwise("godown"))
    return levels.select(
        level.alias("level"), *keys, "demand", "stock",
        F.round(F.greatest(F.col("demand") - F.col("stock"), F.lit(0.0)), 4).alias("shortfall"))


def bom_buildable(bom: DataFrame, raw: DataFrame) -> DataFrame:
    """Units of each manufactured item the raw material allows."""
    needed = bom.where("IsActive").select("ItemIDManu", "ItemID", "ItemQty")
    joined = needed.join(raw, "ItemID", "left")
    possible = F.floor(safe_div(F.coalesce("on_hand", F.lit(0)), "ItemQty"))
    return joined.groupBy("ItemIDManu").agg(F.min(possible).alias("buildable"))


def group_moq(orders: DataFrame, group_minimum: DataFrame) -> DataFrame:
    """Tops an order group up to its joint minimum, best sellers first.

    ``orders``: group, sku, need, sales. Units missing to the group's minimum
    go to the SKUs in order of sales, each taking at most its monthly sales;
    what is still missing then stays in ``unfilled``.
    """
    needs = orders.groupBy("group").agg(F.sum("need").alias("group_need"))
    gaps = needs.join(group_minimum, "group").select(
        "group", F.greatest(F.col("group_moq") - F.col("group_need"), F.lit(0)).alias("gap"))
    ranked = running_before(orders, "group", "sales", "sales", "sku", out="_ahead")
    filled = ranked.join(gaps, "group").withColumn(
        "top_up", F.greatest(F.lit(0), F.least(F.col("sales"), F.col("gap") - F.col("_ahead"))))
    taken = orders.groupBy("group").agg(F.sum("sales").alias("_all"))
    return filled.join(taken, "group").select(
        "group", "sku", "need", "sales", "top_up",
        (F.col("need") + F.col("top_up")).alias("order_qty"),
        F.greatest(F.lit(0), F.col("gap") - F.col("_all")).alias("unfilled"))


def effective_lead_time(parts: DataFrame) -> DataFrame:
    """Whole lead time and the forecast horizon in months it calls for."""
    steps = ["procurement_days", "manufacturing_days", "transfer_days", "intake_days"]
    whole = sum((F.coalesce(c, F.lit(0)) for c in steps[1:]),
                F.coalesce(steps[0], F.lit(0)))
    timed = parts.withColumn("lead_time_days", whole)
    horizon = (F.when(F.col("lead_time_days") <= 30, 1).when(F.col("lead_time_days") <= 60, 2)
               .otherwise(3))
    return timed.withColumn("horizon_months", horizon)


def stockout_outlook(demand: DataFrame, stock: DataFrame, horizon: int = 30,
                     days_in_month: int = 30) -> DataFrame:
    """Per SKU the days until stock runs out and how many locations run out in time."""
    keys = ["sku", "channel", "godown"]
    return stockout_outlook_of(demand.join(stock.select(*keys, "closing_qty"), keys, "left"),
                               horizon, days_in_month)


def stockout_outlook_of(positions: DataFrame, horizon: int = 30, days_in_month: int = 30) -> DataFrame:
    """The same from rows with demand and stock of a location side by side."""
    joined = positions.withColumns({
        "_daily": F.col("demand") / days_in_month,
        "_stock": F.coalesce("closing_qty", F.lit(0))})
    days = F.when(F.col("_daily") > 0, safe_div("_stock", "_daily")).otherwise(999.0)
    per_location = joined.withColumn("_days", days)
    return per_location.groupBy("sku").agg(
        F.round(F.coalesce(safe_div(F.sum("_stock"), F.sum("_daily")), F.lit(999.0)), 1)
        .alias("days_to_stockout"),
        F.round(F.min("_days"), 1).alias("first_stockout_days"),
        F.count_if(F.col("_days") <= horizon).alias("locations_affected"))


def stock_transfer(shortfalls: DataFrame, own_stock: DataFrame) -> DataFrame:
    """Own stock handed to channel warehouses, the largest shortfall first.

    ``shortfalls``: sku, location, shortfall; ``own_stock``: sku, own_qty.
    """
    short = shortfalls.where(F.col("shortfall") > 0)
    ranked = running_before(short, "sku", "shortfall", "shortfall", "location", out="_ahead")
    given = F.greatest(F.lit(0), F.least(F.col("shortfall"), F.col("own_qty") - F.col("_ahead")))
    return ranked.join(own_stock, "sku").select(
        "sku", "location", "shortfall", given.alias("transfer_qty"),
        (F.col("shortfall") - given).alias("still_short"))


def stock_transfer_shared(shortfalls: DataFrame, own_stock: DataFrame) -> DataFrame:
    """Own stock handed out in proportion to the shortfalls, in whole units.

    ``shortfalls``: sku, location, shortfall in whole units; ``own_stock``: sku, own_qty. Where
    stock covers everything, everyone gets the shortfall. Where it is scarce, a location gets the
    whole part of its share, and the units left over go one each to the largest remainders, equal
    ones in the order of the location's md5. Transfers of a SKU add up to its stock, and none is
    above its shortfall. A SKU's locations are ranked in bounded parts, however many there are.
    """
    short = shortfalls.where(F.col("shortfall") > 0)
    wanted = short.groupBy("sku").agg(F.sum("shortfall").alias("_all"))
    supply = wanted.join(own_stock, "sku").select(
        F.col("sku").alias("_sku"), "_all", F.greatest(F.lit(0), F.least("own_qty", "_all"))
        .cast("long").alias("_own"))
    exact = F.col("_own").cast("decimal(19,0)") * F.col("shortfall").cast("decimal(19,0)")
    shared = short.join(supply, F.col("sku") == F.col("_sku")).withColumns({
        "_share": F.floor(exact / F.col("_all")).cast("long"),
        "_rest": (exact % F.col("_all")).cast("long")})
    left = shared.groupBy(F.col("sku").alias("_s")).agg(
        (F.min("_own") - F.sum("_share")).alias("_left"))
    ranked = running_before(shared.withColumn("_one", F.lit(1)), "sku", "_one", "_rest", "location",
                            out="_ahead")
    extra = ((F.col("_rest") > 0) & (F.col("_ahead") < F.col("_left"))).cast("long")
    given = F.col("_share") + extra
    return ranked.join(left, F.col("sku") == F.col("_s")).select(
        "sku", "location", "shortfall", given.alias("transfer_qty"),
        (F.col("shortfall") - given).alias("still_short"))

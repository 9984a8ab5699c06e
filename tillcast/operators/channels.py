"""Channel, state and business-intelligence reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.calendar import DAY_NAMES, MONTH_NAMES, month_key
from tillcast.functions.frames import bundle, drop_null_keys, top_by
from tillcast.functions.numeric import (as_money, mean_of, money_avg, money_sum, money_units,
                                        percent_of, safe_div)
from tillcast.operators.sales import with_product_name

# The two sales channels and their report labels.
CHANNELS = ("Amazon Stores", "Flipkart Store")
CHANNEL_LABELS = ("Amazon", "Flipkart")


def channel_summary(sales: DataFrame) -> DataFrame:
    """Revenue, orders, averages and shares per channel."""
    per_channel = drop_null_keys(sales, "Partyname").groupBy("Partyname").agg(
        F.round(money_sum("Amount"), 2).alias("Total_Revenue"),
        F.count("Amount").alias("Total_Orders"),
        F.round(money_avg("Amount"), 2).alias("Avg_Order_Value"),
        F.sum("Quantity").alias("Total_Quantity"),
        F.round(mean_of("Quantity"), 2).alias("Avg_Quantity_Per_Order"))
    # One row per channel is left, so the totals are a window over a handful of rows.
    whole = Window.partitionBy()
    return per_channel.withColumns({
        f"{name}_Percentage": F.round(
            percent_of(f"Total_{name}", F.sum(f"Total_{name}").over(whole)), 2)
        for name in ("Revenue", "Orders")})


def _pivot_channels(frame: DataFrame, keys: Sequence[Column], channels: Sequence[str],
                    revenue: bool = True, quantity: bool = True) -> DataFrame:
    # One conditional sum per channel: a single aggregation with map-side
    # combine, where a generic pivot would aggregate twice.
    sums = []
    for channel in channels:
        mine = F.col("Partyname") == channel
        if revenue:
            sums.append(F.coalesce(money_sum(F.when(mine, F.col("Amount"))), F.lit(0.0))
                        .alias(f"{channel}_revenue"))
        if quantity:
            sums.append(F.coalesce(F.sum(F.when(mine, F.col("Quantity"))), F.lit(0))
                        .alias(f"{channel}_quantity"))
    return drop_null_keys(frame, "Partyname").groupBy(*keys).agg(*sums)


def channel_yearly_pivot(sales: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Revenue and units per year, one column per channel; missing is 0."""
    return _pivot_channels(sales, [F.year("Date").alias("Year")], channels)


def channel_monthly_pivot(sales: DataFrame, years: Sequence[int] = (2024, 2025),
                          channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Revenue per month of the given years, one column per channel."""
    picked = sales.where(F.year("Date").isin(list(years)))
    return _pivot_channels(picked, [month_key("Date").alias("Period")], channels,
                           quantity=False)


def channel_yearly_share(sales: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Each channel's percentage of the year's revenue over all channels."""
    per_year = drop_null_keys(sales, "Partyname").groupBy(F.year("Date").alias("Year")).agg(
        money_sum("Amount").alias("all_revenue"),
        *[F.coalesce(money_sum(F.when(F.col("Partyname") == c, F.col("Amount"))), F.lit(0.0))
          .alias(f"{c}_revenue") for c in channels])
    return per_year.select("Year", *[
        percent_of(f"{c}_revenue", "all_revenue").alias(f"{c}_percentage") for c in channels])


def analysis_overview(sales: DataFrame) -> DataFrame:
    """Rows, date range, SKUs, revenue and units of the whole table."""
    return sales.agg(
        F.count("*").alias("total_records"),
        F.date_format(F.min("Date"), "yyyy-MM-dd").alias("start"),
        F.date_format(F.max("Date"), "yyyy-MM-dd").alias("end"),
        F.count_distinct("SKU").alias("total_skus"),
        money_sum("Amount").alias("total_revenue"),
        F.sum("Quantity").alias("total_quantity"))


def _daily_units(sales: DataFrame) -> DataFrame:
    return drop_null_keys(sales, "Date").groupBy("Date").agg(
        F.sum("Quantity").alias("Quantity"))


def daily_volatility(sales: DataFrame) -> DataFrame:
    """Mean and peak daily units, and their coefficient of variation in percent."""
    stats = _daily_units(sales).agg(
        mean_of("Quantity").alias("daily_average"), F.max("Quantity").alias("peak_daily"),
        F.stddev_samp("Quantity").alias("deviation"))
    return stats.select("daily_average", "peak_daily",
                        F.round(percent_of("deviation", "daily_average"), 6)
                        .alias("volatility"))


def top_skus_by_quantity(sales: DataFrame, sku_master: DataFrame, n: int = 10) -> DataFrame:
    """Best SKUs by units with their display names."""
    per_sku = drop_null_keys(sales, "SKU").groupBy("SKU").agg(
        F.sum("Quantity").alias("quantity"))
    named = with_product_name(top_by(per_sku, n, "quantity", "SKU"), sku_master, default=None)
    return named.select(F.col("SKU").alias("sku"), "quantity",
                        F.col("product_name").alias("name"),
                        F.concat_ws(" - ", "SKU", "product_name").alias("display"))


def top_states_by_revenue(sales: DataFrame, n: int = 10) -> DataFrame:
    """Best destination states by revenue."""
    per_state = drop_null_keys(sales, "Stateto").groupBy(F.col("Stateto").alias("state")).agg(
        money_sum("Amount").alias("revenue"))
    return top_by(per_state, n, "revenue", "state")


def temporal_extremes(sales: DataFrame) -> DataFrame:
    """Weekday (Monday = 0) and month with the highest and lowest mean daily units."""
    daily = _daily_units(sales)

    def extremes(part: Column, best: str, worst: str) -> DataFrame:
        # The negated key makes the earlier day or month win among equals.
        means = daily.groupBy(part.cast("int").alias("k")).agg(mean_of("Quantity").alias("q"))
        return means.agg(F.max_by("k", F.struct("q", -F.col("k"))).alias(best),
                         F.min_by("k", F.struct("q", "k")).alias(worst))

    return bundle(sales.sparkSession,
                  extremes(F.weekday("Date"), "best_day", "worst_day"),
                  extremes(F.month("Date"), "best_month", "worst_month"))


def sales_trend_monthly(sales: DataFrame) -> DataFrame:
    """Units per month."""
    return sales.groupBy(month_key("Date").alias("month")).agg(
        F.sum("Quantity").alias("quantity"))


def sales_trend_daily(sales: DataFrame, days: int = 30) -> DataFrame:
    """Units per day over the last sale days."""
    return (_daily_units(sales).orderBy(F.col("Date").desc()).limit(days)
            .select(F.date_format("Date", "yyyy-MM-dd").alias("date"),
                    F.col("Quantity").alias("quantity")))


def state_channel_distribution(sales: DataFrame, channels: Sequence[str] = CHANNELS,
                               labels: Sequence[str] = CHANNEL_LABELS,
                               n: int | None = 15) -> DataFrame:
    """Units of the two channels in the largest destination states (None: in all), and the
    leading channel."""
    first, second = (F.col("Partyname") == c for c in channels)
    per_state = drop_null_keys(sales, "Stateto").groupBy(F.col("Stateto").alias("state")).agg(
        F.sum("Quantity").alias("all_quantity"),
        F.coalesce(F.sum(F.when(first, F.col("Quantity"))), F.lit(0)).alias("first_quantity"),
        F.coalesce(F.sum(F.when(second, F.col("Quantity"))), F.lit(0)).alias("second_quantity"))
    top = per_state if n is None else top_by(per_state, n, "all_quantity", "state")
    both = F.col("first_quantity") + F.col("second_quantity")
    share = [F.round(F.when(both > 0, percent_of(c, both)).otherwise(0.0), 1)
             for c in ("first_quantity", "second_quantity")]
    return top.select(
        "state", both.alias("total_quantity"), "first_quantity", "second_quantity",
        share[0].alias("first_percentage"), share[1].alias("second_percentage"),
        F.when(F.col("first_quantity") > F.col("second_quantity"), labels[0])
        .when(F.col("second_quantity") > F.col("first_quantity"), labels[1])
        .otherwise("Equal").alias("primary_channel"))


def state_channel_summary(distribution: DataFrame,
                          labels: Sequence[str] = CHANNEL_LABELS) -> DataFrame:
    """How many states each channel leads."""
    lead = F.col("primary_channel")
    return distribution.agg(
        F.count("*").alias("total_states"),
        F.count_if(lead == labels[0]).alias("first_dominant_states"),
        F.count_if(lead == labels[1]).alias("second_dominant_states"),
        F.count_if(lead == "Equal").alias("equal_states"))


def bi_month_extremes(sales: DataFrame) -> DataFrame:
    """Best and worst month by units."""
    monthly = sales_trend_monthly(sales)
    # Months compare as text; the complement makes the earlier one win among equals.
    month_no = F.regexp_replace("month", "-", "").cast("int")
    best = F.max_by(F.struct("month", "quantity"), F.struct(F.col("quantity"), -month_no))
    worst = F.min_by(F.struct("month", "quantity"), F.struct(F.col("quantity"), month_no))
    return monthly.agg(best.alias("b"), worst.alias("w")).select(
        F.col("b.month").alias("best_month"), F.col("b.quantity").alias("best_quantity"),
        F.col("w.month").alias("worst_month"), F.col("w.quantity").alias("worst_quantity"))


def bi_sku_performance(sales: DataFrame) -> DataFrame:
    """Units, mean row units, rows and revenue per SKU."""
    return drop_null_keys(sales, "SKU").groupBy("SKU").agg(
        F.sum("Quantity").alias("Total_Quantity"),
        F.round(mean_of("Quantity"), 2).alias("Avg_Daily"),
        F.count("Quantity").alias("Records"),
        F.round(money_sum("Amount"), 2).alias("Total_Revenue"))


def bi_state_performance(sales: DataFrame) -> DataFrame:
    """Units and revenue per destination state."""
    return drop_null_keys(sales, "Stateto").groupBy("Stateto").agg(
        F.sum("Quantity").alias("Quantity"), money_sum("Amount").alias("Amount"))


def top_share(frame: DataFrame, value: str, key: str, out: str, n: int = 5) -> DataFrame:
    """One row: percentage of the column's total held by its ``n`` largest rows."""
    best = top_by(frame, n, value, key).agg(F.sum(value).alias("best"))
    whole = frame.agg(F.sum(value).alias("whole"))
    return bundle(frame.sparkSession, best, whole).select(
        F.round(percent_of("best", "whole"), 6).alias(out))


def kpi_cells(sales: DataFrame) -> DataFrame:
    """``kind, key, q, n, money``: units, rows and revenue per day, SKU and destination
    state, from one read of the sales: each row counts once per kind, summed before it moves."""
    day, sku, state = (F.col(c) for c in ("Date", "SKU", "Stateto"))
    sets = sales.groupingSets([[day], [sku], [state]], day, sku, state).agg(
        F.sum("Quantity").alias("q"), F.count("*").alias("n"), money_units("Amount").alias("money"), F.grouping("Date").alias("_d"),
        F.grouping("SKU").alias("_s"))
    kind = F.when(F.col("_d") == 0, "day").when(F.col("_s") == 0, "sku").otherwise("state")
    key = F.when(F.col("_d") == 0, day.cast("string")).when(F.col("_s") == 0, sku).otherwise(state)
    return sets.select(kind.alias("kind"), key.alias("key"), "q", "n", "money")


def bi_concentration(cells: DataFrame) -> DataFrame:
    """Share of units of the five best SKUs and of revenue of the five best states, from
    ``kpi_cells``."""
    known = drop_null_keys(cells, "key")
    skus = known.where(F.col("kind") == "sku").select("key", F.col("q").alias("Total_Quantity"))
    states = known.where(F.col("kind") == "state").select("key", as_money(F.col("money")).alias("Amount"))
    return bundle(cells.sparkSession, top_share(skus, "Total_Quantity", "key", "top_5_sku_share"),
                  top_share(states, "Amount", "key", "top_5_state_share"))


def bi_row_means(sales: DataFrame) -> DataFrame:
    """Mean row units per weekday and per month, with the best and worst of each marked."""
    # Both groupings start from the same daily sums, so sales are read once.
    daily = drop_null_keys(sales, "Date").groupBy("Date").agg(
        F.sum("Quantity").alias("q"), F.count("Quantity").alias("n"))

    def means(kind: str, key: Column, names: list[str], base: int) -> DataFrame:
        m = daily.groupBy(key.cast("int").alias("k")).agg(
            safe_div(F.sum("q"), F.sum("n")).alias("avg_quantity"))
        label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k") + (1 - base))
        whole = Window.partitionBy()
        return m.select(
            F.lit(kind).alias("kind"), "k", label.alias("label"), "avg_quantity",
            (F.col("k") == F.max_by("k", F.struct("avg_quantity", -F.col("k"))).over(whole))
            .alias("is_best"),
            (F.col("k") == F.min_by("k", F.struct("avg_quantity", "k")).over(whole))
            .alias("is_worst"))

    return means("weekday", F.weekday("Date"), DAY_NAMES, 0).unionByName(
        means("month", F.month("Date"), MONTH_NAMES, 1))


def price_stats(sales: DataFrame) -> DataFrame:
    """Mean, range and variation of the unit price and its correlation with units."""
    stats = sales.agg(
        money_avg("Rate").alias("mean"), F.stddev_samp("Rate").alias("std"),
        F.min("Rate").alias("low"), F.max("Rate").alias("high"),
        F.corr(F.col("Rate"), F.col("Quantity").cast("double")).alias("r"))
    r = F.col("r")
    effect = (F.when(r < -0.1, "reduces demand").when(r > 0.1, "increases demand")
              .otherwise("minimal impact"))
    return stats.select(
        F.round("mean", 4).alias("avg_price"), F.round("std", 4).alias("price_std"),
        F.round("low", 4).alias("min_price"), F.round("high", 4).alias("max_price"),
        F.round(percent_of("std", "mean"), 4).alias("price_volatility"),
        F.round(r, 6).alias("price_quantity_corr"), effect.alias("price_effect"))


def kpi_report(cells: DataFrame) -> DataFrame:
    """Headline figures: revenue, units, SKUs, daily units, order value, concentration.

    ``cells``: ``kpi_cells``, written first where sales are large, as several figures start there.
    """
    skus = cells.where(F.col("kind") == "sku")
    totals = skus.agg(
        as_money(F.sum("money")).alias("total_revenue"), F.sum("q").alias("total_units"),
        F.sum("n").alias("total_orders"), F.count("key").alias("total_skus"))
    days = drop_null_keys(cells.where(F.col("kind") == "day"), "key")
    daily = days.agg(mean_of("q").alias("daily_avg"))
    joined = bundle(cells.sparkSession, totals, daily, bi_concentration(cells))
    return joined.withColumns({
        "avg_order_value": safe_div("total_revenue", "total_orders"),
        "revenue_per_sku": safe_div("total_revenue", "total_skus")})

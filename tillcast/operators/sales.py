"""Sales reports: products, months, weeks, warehouses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.calendar import DAY_NAMES, month_key, month_name, week_key
from tillcast.functions.frames import bundle, drop_null_keys, top_by, total
from tillcast.functions.numeric import (as_money, mean_of, money_avg, money_sum, money_units,
                                        percent_change, percent_of, safe_div)


def sku_performance(sales: DataFrame) -> DataFrame:
    """Totals, averages, first and last sale, and daily rate per SKU."""
    per_sku = drop_null_keys(sales, "SKU").groupBy("SKU").agg(
        F.sum("Quantity").alias("Total_Quantity"),
        F.count("Quantity").alias("Total_Orders"),
        F.round(mean_of("Quantity"), 2).alias("Avg_Quantity_Per_Order"),
        F.round(money_sum("Amount"), 2).alias("Total_Revenue"),
        F.round(money_avg("Amount"), 2).alias("Avg_Order_Value"),
        F.min("Date").alias("First_Sale"),
        F.max("Date").alias("Last_Sale"))
    days = F.date_diff("Last_Sale", "First_Sale") + 1
    return per_sku.withColumns({
        "Revenue_Per_Unit": safe_div("Total_Revenue", "Total_Quantity"),
        "Days_Active": days,
        "Daily_Avg_Quantity": safe_div("Total_Quantity", days)})


def top_skus(performance: DataFrame, n: int = 20) -> DataFrame:
    """Best SKUs by revenue."""
    return top_by(performance, n, "Total_Revenue", "SKU")


def identify_top_skus(sales: DataFrame, n: int | None = 15) -> DataFrame:
    """Best SKUs by revenue with the measures the forecast uses; all SKUs when ``n`` is None."""
    per_sku = drop_null_keys(sales, "SKU").groupBy("SKU").agg(
        money_sum("Amount").alias("Total_Revenue"),
        F.sum("Quantity").alias("Total_Quantity"),
        F.min("Date").alias("First_Sale"),
        F.max("Date").alias("Last_Sale"),
        F.count("Date").alias("Total_Orders"))
    days = F.date_diff("Last_Sale", "First_Sale") + 1
    measured = per_sku.withColumns({
        "Days_Active": days,
        "Daily_Avg_Quantity": safe_div("Total_Quantity", days),
        "Revenue_Per_Unit": safe_div("Total_Revenue", "Total_Quantity")})
    return measured if n is None else top_by(measured, n, "Total_Revenue", "SKU")


def monthly_trends(sales: DataFrame) -> DataFrame:
    """Units, revenue, distinct SKUs and orders per month, with month-on-month change."""
    # Two plain aggregations instead of one with two distinct counts, which would
    # multiply every sales row before the shuffle.
    month = month_key("Date").alias("Month")
    per_sku = sales.groupBy(month, "SKU").agg(
        F.sum("Quantity").alias("q"), money_units("Amount").alias("m"))
    orders = (sales.where(F.col("Orderid").isNotNull()).select(month.alias("_month"), "Orderid")
              .distinct().groupBy("_month").agg(F.count("*").alias("n")))
    monthly = (per_sku.groupBy("Month").agg(
        F.sum("q").alias("Total_Quantity"),
        F.round(as_money(F.sum("m")), 2).alias("Total_Revenue"),
        F.count("SKU").alias("Unique_SKUs"))
        .join(orders, F.col("Month").eqNullSafe(F.col("_month")), "left")
        .select("Month", "Total_Quantity", "Total_Revenue", "Unique_SKUs",
                F.coalesce("n", F.lit(0)).alias("Unique_Orders")))
    by_month = Window.orderBy("Month")
    return monthly.withColumns({
        "Revenue_Growth": percent_change("Total_Revenue",
                                         F.lag("Total_Revenue").over(by_month)),
        "Quantity_Growth": percent_change("Total_Quantity",
                                          F.lag("Total_Quantity").over(by_month))})


def dow_revenue(sales: DataFrame) -> DataFrame:
    """Revenue per weekday, Monday first; a day without sales is null."""
    days = (sales.sparkSession.range(len(DAY_NAMES))
            .select(F.col("id").cast("int").alias("weekday"),
                    F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]),
                                 F.col("id").cast("int") + 1).alias("DayOfWeek")))
    revenue = (sales.groupBy(F.weekday("Date").alias("weekday"))
               .agg(money_sum("Amount").alias("Amount")))
    return (days.join(revenue, "weekday", "left").orderBy("weekday")
            .select("weekday", "DayOfWeek", "Amount"))


def weekly_patterns(sales: DataFrame) -> DataFrame:
    """Revenue and units per week label."""
    return sales.groupBy(week_key("Date").alias("Week")).agg(
        money_sum("Amount").alias("Amount"), F.sum("Quantity").alias("Quantity"))


def weekly_revenue_stats(sales: DataFrame) -> DataFrame:
    """Summary statistics of weekly revenue (one row per week goes into them)."""
    weekly = weekly_patterns(sales)
    a = F.col("Amount")
    return weekly.agg(
        F.count(a).alias("count"), F.round(F.avg(a), 2).alias("mean"),
        F.round(F.stddev_samp(a), 2).alias("std"), F.round(F.min(a), 2).alias("min"),
        F.round(F.percentile(a, 0.25), 2).alias("q25"),
        F.round(F.percentile(a, 0.5), 2).alias("q50"),
        F.round(F.percentile(a, 0.75), 2).alias("q75"),
        F.round(F.max(a), 2).alias("max"))


def category_counts(sku_master: DataFrame) -> DataFrame:
    """SKUs per category."""
    return (drop_null_keys(sku_master, "category").groupBy("category")
            .agg(F.count("*").alias("skus")))


def exploration_insights(sales: DataFrame, sku_master: DataFrame) -> DataFrame:
    """SKU count, revenue of the ten best, mean daily revenue, most common category."""
    spark = sales.sparkSession
    performance = sku_performance(sales)
    skus = performance.agg(F.count("*").alias("total_skus"))
    best = top_skus(performance, 10).agg(F.round(F.sum("Total_Revenue"), 2)
                                         .alias("top10_revenue"))
    daily = (drop_null_keys(sales, "Date").groupBy("Date")
             .agg(money_sum("Amount").alias("Amount"))
             .agg(F.round(money_avg("Amount"), 2).alias("avg_daily_revenue")))
    common = top_by(category_counts(sku_master), 1, "skus", "category").select(
        F.col("category").alias("most_active_category"), F.col("skus").alias("category_skus"))
    return bundle(spark, skus, best, daily, common)


def _monthly_revenue(sales: DataFrame) -> DataFrame:
    by_month = Window.orderBy("month")
    monthly = sales.groupBy(month_key("Date").alias("month")).agg(
        money_sum("Amount").alias("revenue"), F.sum("Quantity").alias("quantity"))
    return monthly.withColumn("previous", F.lag("revenue").over(by_month))


def latest_month_growth(sales: DataFrame) -> DataFrame:
    """One row: revenue change of the last month; 0 with one month only or a base of 0 or less."""
    last = _monthly_revenue(sales).agg(
        F.max_by(F.struct("revenue", "previous"), "month").alias("m"),
        F.count("*").alias("months"))
    growth = F.when(F.col("m.previous") > 0, percent_change("m.revenue", "m.previous"))
    return last.select(F.coalesce(growth, F.lit(0.0)).alias("growth_rate"), "months")


def business_overview(sales: DataFrame) -> DataFrame:
    """Total revenue, orders, SKUs, average order value, growth and date range."""
    # One pass over the sales: (month, SKU) cells, then both groupings of the cells at once.
    cells = sales.groupBy(month_key("Date").alias("month"), "SKU").agg(
        money_units("Amount").alias("m"), F.count("*").alias("n"),
        F.min("Date").alias("first"), F.max("Date").alias("last"))
    month, sku = F.col("month"), F.col("SKU")
    sides = cells.groupingSets([[month], [sku]], "month", "SKU").agg(
        F.sum("m").alias("m"), F.sum("n").alias("n"), F.min("first").alias("first"),
        F.max("last").alias("last"), (F.grouping("SKU") == 1).alias("is_month"))
    is_month = F.col("is_month")
    revenue = as_money(F.col("m"))
    whole = sides.withColumn("before", F.when(is_month, F.lag(revenue).over(
        Window.partitionBy("is_month", F.when(~is_month, sku)).orderBy("month")))).agg(
        as_money(F.sum(F.when(is_month, F.col("m")))).alias("total_revenue"),
        F.coalesce(F.sum(F.when(is_month, F.col("n"))), F.lit(0)).alias("total_orders"),
        F.count_if(~is_month & sku.isNotNull()).alias("unique_skus"),
        F.date_format(F.min("first"), "yyyy-MM-dd").alias("start"),
        F.date_format(F.max("last"), "yyyy-MM-dd").alias("end"),
        F.max_by(F.when(is_month, F.struct(revenue.alias("revenue"), "before")),
                 F.when(is_month, month)).alias("_l"))
    growth = F.when(F.col("_l.before") > 0, percent_change("_l.revenue", "_l.before"))
    both = whole.withColumn("growth_rate", F.coalesce(growth, F.lit(0.0))).drop("_l")
    return both.withColumn("avg_order_value", safe_div("total_revenue", "total_orders"))


def overview_top5(sales: DataFrame, sku_master: DataFrame, n: int = 5) -> DataFrame:
    """Best SKUs with name, share within the group and a rank label."""
    per_sku = drop_null_keys(sales, "SKU").groupBy("SKU").agg(
        money_sum("Amount").alias("revenue"))
    best = top_by(per_sku, n, "revenue", "SKU")
    ranked = best.withColumn("position", F.row_number().over(
        Window.orderBy(F.col("revenue").desc(), "SKU")))
    whole = F.sum("revenue").over(Window.partitionBy())
    return with_product_name(ranked, sku_master).select(
        F.col("SKU").alias("sku"), "product_name", "revenue", "position",
        F.round(percent_of("revenue", whole), 1).alias("share_percent"),
        F.when(F.col("position") <= 2, "Excellent").when(F.col("position") <= 4, "Good")
        .otherwise("Average").alias("performance"))


def overview_monthly_trend(sales: DataFrame) -> DataFrame:
    """Revenue and units per month with growth; the first month counts as 0."""
    monthly = _monthly_revenue(sales)
    base = F.coalesce("previous", "revenue")
    return monthly.select("month", "revenue", "quantity",
                          F.round(percent_change("revenue", base), 1).alias("growth_percent"))


def with_product_name(frame: DataFrame, sku_master: DataFrame, key: str = "SKU",
                      default: str | None = "Unknown Product") -> DataFrame:
    """Adds ``product_name``; SKUs not in the master get ``default``, or the SKU itself."""
    names = sku_master.select(F.col("sku").alias("_sku"), F.col("category").alias("_name"))
    fallback = F.col(key) if default is None else F.lit(default)
    return (frame.join(names, F.col(key) == F.col("_sku"), "left")
            .withColumn("product_name", F.coalesce("_name", fallback))
            .drop("_sku", "_name"))


def sku_list(sku_master: DataFrame) -> DataFrame:
    """SKUs with name and display text, in SKU order."""
    return sku_master.select(
        "sku", F.col("category").alias("name"),
        F.concat_ws(" - ", "sku", "category").alias("display")).orderBy("sku")


def godown_summary(sales: DataFrame) -> DataFrame:
    """Rows, units and revenue per warehouse and state of dispatch."""
    return (drop_null_keys(sales, "Godown", "Statefrom").groupBy("Godown", "Statefrom")
            .agg(F.count("SKU").alias("Orders"), F.sum("Quantity").alias("Total_Quantity"),
                 money_sum("Amount").alias("Total_Revenue"))
            .withColumnRenamed("Statefrom", "State_From"))


def sku_godown(sales: DataFrame) -> DataFrame:
    """Units and revenue per SKU and warehouse."""
    return (drop_null_keys(sales, "SKU", "Godown").groupBy("SKU", "Godown")
            .agg(F.sum("Quantity").alias("Quantity"), money_sum("Amount").alias("Amount")))


def godown_top(sales: DataFrame, n: int = 5) -> DataFrame:
    """Largest warehouses by units."""
    per_godown = drop_null_keys(sales, "Godown").groupBy("Godown").agg(
        F.sum("Quantity").alias("Quantity"), money_sum("Amount").alias("Amount"))
    return top_by(per_godown, n, "Quantity", "Godown")


def sku_top_godowns(sales: DataFrame, n: int = 3) -> DataFrame:
    """Per SKU the array of its ``n`` largest warehouses, largest first, and its units.

    Sales are read once: units per SKU and warehouse give both the ranking
    and, summed, the SKU's total. Units without a warehouse count in the total
    only.
    """
    per_pair = drop_null_keys(sales, "SKU").groupBy("SKU", "Godown").agg(
        F.sum("Quantity").alias("quantity"))
    # Rows without a warehouse rank last and are taken out of the finished list.
    rank = Window.partitionBy("SKU").orderBy(F.col("Godown").isNull(), F.col("quantity").desc(),
                                             "Godown")
    kept = per_pair.withColumns({
        "total_quantity": F.sum("quantity").over(Window.partitionBy("SKU")),
        "position": F.row_number().over(rank)}).where(F.col("position") <= n)
    listed = F.filter(F.sort_array(F.collect_list(F.struct(
        "position", F.col("Godown").alias("godown"), "quantity"))),
        lambda g: g["godown"].isNotNull())
    return kept.groupBy("SKU").agg(
        F.transform(listed, lambda g: F.struct(g["godown"].alias("godown"),
                                               g["quantity"].alias("quantity")))
        .alias("godown_distribution"), F.max("total_quantity").alias("total_quantity"))


def network_counts(sales: DataFrame) -> DataFrame:
    """Distinct warehouses, states of dispatch and destination states."""
    routes = sales.select("Godown", "Statefrom", "Stateto").distinct()
    return routes.agg(F.count_distinct("Godown").alias("unique_godowns"),
                      F.count_distinct("Statefrom").alias("states_served_from"),
                      F.count_distinct("Stateto").alias("destination_states"))


def historical_monthly(history: DataFrame | None, sales: DataFrame, last: int = 24) -> DataFrame:
    """Revenue and units of the last months, from the history when there is one."""
    source = sales if history is None else history
    monthly = source.groupBy(month_key("Date").alias("period")).agg(
        money_sum("Amount").alias("revenue"), F.sum("Quantity").alias("quantity"))
    return monthly.orderBy(F.col("period").desc()).limit(last)


def historical_span(history: DataFrame | None, sales: DataFrame) -> DataFrame:
    """Number of months and date range of the table ``historical_monthly`` reads."""
    source = sales if history is None else history
    monthly = source.groupBy(month_key("Date").alias("period")).agg(
        F.min("Date").alias("first"), F.max("Date").alias("last"))
    return monthly.agg(F.count("*").alias("total_periods"),
                       F.date_format(F.min("first"), "yyyy-MM-dd").alias("start"),
                       F.date_format(F.max("last"), "yyyy-MM-dd").alias("end"))


def seasonal_month_means(sales: DataFrame) -> DataFrame:
    """Mean row amount and quantity per calendar month."""
    per_month = sales.groupBy(F.month("Date").alias("m")).agg(
        money_avg("Amount").alias("avg_revenue"), mean_of("Quantity").alias("avg_quantity"))
    return per_month.select(month_name("m").alias("month"), "avg_revenue", "avg_quantity")


def yoy_growth(sales: DataFrame) -> DataFrame:
    """Revenue per year with growth over the previous year present; the first year is left out."""
    yearly = sales.groupBy(F.year("Date").alias("year")).agg(money_sum("Amount").alias("revenue"))
    by_year = Window.orderBy("year")
    compared = yearly.withColumns({"previous": F.lag("revenue").over(by_year),
                                   "position": F.row_number().over(by_year)})
    growth = F.when(F.col("previous") > 0, percent_change("revenue", "previous")).otherwise(0.0)
    return compared.where(F.col("position") > 1).select(
        "year", "revenue", growth.alias("growth_rate"))


def share_of_total(frame: DataFrame, value: str, out: str = "share_percent") -> DataFrame:
    """Each row's percentage of the column's grand total."""
    return frame.withColumn(out, percent_of(F.col(value), total(frame, F.sum(value))))

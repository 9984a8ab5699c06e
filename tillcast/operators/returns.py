"""Returns reports and return rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions.calendar import day_name, month_key
from tillcast.functions.frames import bundle, drop_null_keys, exact_quantile, top_by
from tillcast.functions.numeric import (MONEY_UNIT, as_money, money_sum, money_units, percent_of,
                                        safe_div)


def returns_overview(returns: DataFrame) -> DataFrame:
    """Rows, amount and units returned, with means (0 if there are none)."""
    sums = returns.agg(
        F.count("*").alias("total_returns"),
        F.coalesce(money_sum("Amount"), F.lit(0.0)).alias("total_return_amount"),
        F.coalesce(F.sum("Quantity"), F.lit(0)).alias("total_return_quantity"))
    return sums.withColumns({
        "avg_return_amount": safe_div("total_return_amount", "total_returns", 0.0),
        "avg_return_quantity": safe_div("total_return_quantity", "total_returns", 0.0)})


def _returns_by(returns: DataFrame, key: str) -> DataFrame:
    return drop_null_keys(returns, key).groupBy(key).agg(
        F.sum("Quantity").alias("return_quantity"), money_sum("Amount").alias("return_amount"))


def returns_by(returns: DataFrame, key: str, n: int = 10) -> DataFrame:
    """First keys by signed return quantity; empty if the column is absent."""
    if key not in returns.columns:
        empty = returns.withColumn(key, F.lit(None).cast("string")).limit(0)
        return _returns_by(empty, key)
    return top_by(_returns_by(returns, key), n, "return_quantity", key)


def returns_chart(returns: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Keys with most returned units: most negative first, shown as positive."""
    ranked = top_by(_returns_by(returns, key), n, "return_quantity", key, ascending=True)
    return ranked.select(key, F.abs("return_quantity").alias("quantity"))


def returns_monthly(returns: DataFrame) -> DataFrame:
    """Signed units per year and month."""
    return returns.groupBy(F.year("Date").alias("year"), F.month("Date").alias("month")).agg(
        F.sum("Quantity").alias("returns"))


def returns_trend_monthly(returns: DataFrame) -> DataFrame:
    """Units returned per month."""
    return returns.groupBy(month_key("Date").alias("month")).agg(
        F.abs(F.sum("Quantity")).alias("quantity"))


def returns_trend_daily(returns: DataFrame, days: int = 30) -> DataFrame:
    """Units returned per day over the last return days."""
    daily = returns.groupBy("Date").agg(F.abs(F.sum("Quantity")).alias("quantity"))
    return daily.orderBy(F.col("Date").desc()).limit(days).select(
        F.date_format("Date", "yyyy-MM-dd").alias("date"), "quantity")


def high_return_skus(returns: DataFrame, q: float = 0.8) -> DataFrame:
    """SKUs whose summed return quantity lies above the given quantile of all SKUs."""
    per_sku = drop_null_keys(returns, "SKU").groupBy("SKU").agg(
        F.sum("Quantity").alias("return_quantity"))
    limit = exact_quantile(per_sku, "return_quantity", q)
    return per_sku.where(F.col("return_quantity") > limit.scalar()).select(
        F.col("SKU").alias("sku"), "return_quantity", F.lit("high").alias("risk_level"))


def return_rate_by(sales: DataFrame, returns: DataFrame, keys: dict[str, Column | str],
                   **measures: Column) -> DataFrame:
    """Units returned as a percentage of units sold per key.

    Keys found on one side only are kept with a rate of 0. Both sides are
    summed before they meet, so the join is between key totals. ``measures``
    are further aggregates of the returned rows.
    """
    names = list(keys)

    def keyed(frame: DataFrame) -> DataFrame:
        named = frame.withColumns({
            n: F.col(c) if isinstance(c, str) else c for n, c in keys.items()})
        return drop_null_keys(named, *names).groupBy(*names)

    sold = keyed(sales).agg(F.sum("Quantity").alias("sales_quantity"))
    back = keyed(returns).agg(F.abs(F.sum("Quantity")).alias("returns_quantity"),
                              *[m.alias(n) for n, m in measures.items()])
    joined = sold.join(back, names, "full_outer")
    return joined.select(
        *names, F.coalesce(percent_of("returns_quantity", "sales_quantity"), F.lit(0.0))
        .alias("return_rate"),
        F.coalesce("sales_quantity", F.lit(0)).alias("sales_quantity"),
        F.coalesce("returns_quantity", F.lit(0)).alias("returns_quantity"), *measures)


def return_rate_by_sku(sales: DataFrame, returns: DataFrame) -> DataFrame:
    return return_rate_by(sales, returns, {"sku": "SKU"})


def return_rate_by_state(sales: DataFrame, returns: DataFrame) -> DataFrame:
    return return_rate_by(sales, returns, {"state": "Stateto"})


def return_rate_monthly(sales: DataFrame, returns: DataFrame) -> DataFrame:
    return return_rate_by(sales, returns,
                          {"year": F.year("Date"), "month": F.month("Date")})


def return_rate_dow(sales: DataFrame, returns: DataFrame) -> DataFrame:
    """Return rate per weekday (Monday = 0) with its name."""
    rates = return_rate_by(sales, returns, {"weekday": F.weekday("Date")})
    return rates.withColumn("day", day_name("weekday"))


def top_return_rates(rates: DataFrame, key: str, n: int = 20) -> DataFrame:
    """Highest rates first."""
    return top_by(rates, n, "return_rate", key)


def return_cells(sales: DataFrame, returns: DataFrame, *keys: str) -> DataFrame:
    """``keys, sold, back, returned, lost``: units sold and returned, returned rows and money per
    cell. Both tables are stacked and summed once; reports of any of the keys start from here."""
    none = F.lit(0).cast("long")
    money = F.rint(F.col("Amount") * MONEY_UNIT).cast("long").cast("decimal(18,0)")
    stacked = sales.select(*keys, F.col("Quantity").alias("sold"), F.lit(None).cast("long").alias("back"),
                           none.alias("row"), F.lit(None).cast("decimal(18,0)").alias("lost")).unionByName(
        returns.select(*keys, F.lit(None).cast("long").alias("sold"), F.col("Quantity").alias("back"),
                       (none + 1).alias("row"), money.alias("lost")))
    return stacked.groupBy(*keys).agg(F.sum("sold").alias("sold"), F.sum("back").alias("back"),
                                      F.sum("row").alias("returned"), F.sum("lost").alias("lost"))


def rate_of_cells(cells: DataFrame, key: str, name: str) -> DataFrame:
    """The columns of ``return_rate_by`` and ``lost`` for one of the cells' keys."""
    summed = drop_null_keys(cells, key).groupBy(F.col(key).alias(name)).agg(
        F.sum("sold").alias("sold"), F.abs(F.sum("back")).alias("back"), F.abs(F.sum("lost")).alias("lost"))
    return summed.select(
        name, F.coalesce(percent_of("back", "sold"), F.lit(0.0)).alias("return_rate"),
        F.coalesce("sold", F.lit(0)).alias("sales_quantity"),
        F.coalesce("back", F.lit(0)).alias("returns_quantity"), "lost")


def return_rate_totals(sales: DataFrame, returns: DataFrame) -> DataFrame:
    """Overall rate, returned revenue and units, and SKUs with returns, from one sum per SKU."""
    cells = return_cells(sales, returns, "SKU")
    known = F.col("SKU").isNotNull()
    sums = cells.agg(
        F.coalesce(F.sum(F.when(known, F.col("sold"))), F.lit(0)).alias("total_sales"),
        F.coalesce(F.sum(F.when(known, F.abs("back"))), F.lit(0)).alias("total_returns"),
        F.count_if(known & (F.col("returned") > 0)).alias("unique_skus_returned"),
        F.abs(as_money(F.sum("lost"))).alias("returns_revenue"))
    return sums.withColumn(
        "overall_return_rate",
        F.when(F.col("total_sales") > 0, percent_of("total_returns", "total_sales"))
        .otherwise(0.0))


def return_rate_range(monthly_rates: DataFrame) -> DataFrame:
    """Mean, highest and lowest monthly rate."""
    r = F.col("return_rate")
    return monthly_rates.agg(
        F.round(F.avg(r), 6).alias("avg_monthly_return_rate"),
        F.round(F.max(r), 6).alias("max_monthly_return_rate"),
        F.round(F.min(r), 6).alias("min_monthly_return_rate"))


def high_risk_skus(sales: DataFrame, returns: DataFrame, over: float = 50) -> DataFrame:
    """SKUs above the rate."""
    return return_rate_by_sku(sales, returns).where(F.col("return_rate") > over).select(
        "sku", "return_rate", F.col("returns_quantity").alias("returns"))


def high_risk_states(sales: DataFrame, returns: DataFrame, over: float = 40) -> DataFrame:
    """Destination states above the rate."""
    return return_rate_by_state(sales, returns).where(F.col("return_rate") > over).select(
        "state", "return_rate", F.col("returns_quantity").alias("returns"))


def high_risk_impact(sku_rates: DataFrame, state_rates: DataFrame, sku_over: float = 50,
                     state_over: float = 40) -> DataFrame:
    """Number of risky SKUs and states and the amount returned on those SKUs.

    ``sku_rates`` carries the returned money of each SKU, from
    ``return_rate_by(..., lost=returned_money())``.
    """
    risky = F.col("return_rate") > sku_over
    skus = sku_rates.agg(
        F.count_if(risky).alias("affected_skus"),
        F.coalesce(as_money(F.sum(F.when(risky, F.col("lost")))), F.lit(0.0))
        .alias("high_risk_revenue_loss"))
    states = state_rates.agg(
        F.count_if(F.col("return_rate") > state_over).alias("affected_states"))
    return bundle(sku_rates.sparkSession, skus, states)


def returned_money() -> Column:
    """Amount returned, in accounting units."""
    return F.abs(money_units("Amount"))


def risk_tier(rate: Column) -> Column:
    """``critical`` above 100 %, ``high`` above 50, ``medium`` above 20, else ``low``."""
    return (F.when(rate > 100, "critical").when(rate > 50, "high").when(rate > 20, "medium")
            .otherwise("low"))


def return_risk_tiers(risky: DataFrame) -> DataFrame:
    """SKUs per risk tier, every tier listed."""
    tier = risk_tier(F.col("return_rate"))
    counts = risky.agg(*[F.count_if(tier == t).alias(t)
                         for t in ("critical", "high", "medium", "low")])
    return counts.select(F.expr(
        "stack(4, 'critical', critical, 'high', high, 'medium', medium, 'low', low) "
        "AS (tier, skus)"))



"""Daily and monthly demand features.

Every window runs on rows already aggregated to (SKU, day) or (SKU, month),
so the longest partition is the length of the calendar, however many sales a
SKU has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.calendar import month_cos, month_sin, month_start
from tillcast.functions.frames import drop_null_keys
from tillcast.functions.numeric import finite, money_avg, money_sum, safe_div

LAGS = (1, 3, 7, 14, 30)
WINDOWS = (7, 14, 30)
MIN_ROWS = 30


def calendar_features(frame: DataFrame, date: str = "Date") -> DataFrame:
    """Year, month, quarter, weekday (Monday = 0), day of month and ISO week."""
    return frame.withColumns({
        "Year": F.year(date), "Month": F.month(date), "Quarter": F.quarter(date),
        "DayOfWeek": F.weekday(date), "DayOfMonth": F.dayofmonth(date),
        "WeekOfYear": F.weekofyear(date)})


def daily_sku_sales(sales: DataFrame) -> DataFrame:
    """Units, revenue, rows and counted rows per SKU and day."""
    return drop_null_keys(sales, "SKU", "Date").groupBy("SKU", "Date").agg(
        F.sum("Quantity").alias("Quantity"), money_sum("Amount").alias("Amount"),
        F.count("*").alias("Rows"), F.count("Quantity").alias("Counted"))


def min_rows_guard(daily: DataFrame, min_rows: int = MIN_ROWS,
                   min_days: int = MIN_ROWS) -> DataFrame:
    """Days of SKUs with enough sales rows and enough sale days."""
    per_sku = Window.partitionBy("SKU")
    return (daily.withColumns({"_rows": F.sum("Rows").over(per_sku),
                               "_days": F.count("*").over(per_sku)})
            .where((F.col("_rows") >= min_rows) & (F.col("_days") >= min_days))
            .drop("_rows", "_days"))


def _by_day() -> Window:
    return Window.partitionBy("SKU").orderBy("Date")


def full_mean(value: str, n: int, order: Window) -> Column:
    """Mean of the last ``n`` rows; null until there are ``n``."""
    frame = order.rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))


def daily_lags(daily: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    """Units and revenue of earlier sale days."""
    return daily.withColumns({
        f"{c}_lag_{k}": F.lag(c, k).over(_by_day()) for k in lags
        for c in ("Quantity", "Amount")})


def daily_rolling_means(daily: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Trailing means over sale days."""
    return daily.withColumns({
        f"{c}_rolling_{n}": full_mean(c, n, _by_day()) for n in windows
        for c in ("Quantity", "Amount")})


def daily_trend_slope(daily: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Least-squares slope of the units of the last sale days; null until there are as many, and
    where units are missing.

    Slopes come from running sums of the units and of units times position: a window's sums
    are the differences of two rows, so the cost does not grow with the window's width. Units are
    whole numbers, so the sums are exact.
    """
    order = _by_day()
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    units = F.coalesce("Quantity", F.lit(0)).cast("decimal(19,0)")
    summed = daily.withColumn("_row", F.row_number().over(order)).withColumns({
        "_units": F.sum(units).over(so_far), "_moment": F.sum(units * F.col("_row")).over(so_far),
        "_known": F.count("Quantity").over(so_far)})

    def within(name: str, n: int) -> Column:
        return F.col(name) - F.coalesce(F.lag(name, n).over(order), F.lit(0))

    def slope(n: int) -> Column:
        # Positions 0 to n - 1 inside the window.
        y = within("_units", n)
        xy = within("_moment", n) - (F.col("_row") - (n - 1)) * y
        spread = n * n * (n * n - 1) / 12
        whole = (F.col("_row") >= n) & (within("_known", n) == n)
        return F.when(whole, (xy * n - y * (n * (n - 1) // 2)).cast("double") / spread)

    return summed.withColumns({f"Quantity_trend_{n}d": slope(n) for n in windows}).drop(
        "_row", "_units", "_moment", "_known")


def daily_features(daily: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Calendar, lag, mean and trend features of the days that have all of them."""
    kept = min_rows_guard(daily, min_rows, 1)
    built = daily_trend_slope(daily_rolling_means(daily_lags(
        kept.withColumns({
            "Year": F.year("Date"), "Month": F.month("Date"),
            "DayOfWeek": F.weekday("Date"), "DayOfMonth": F.dayofmonth("Date"),
            "WeekOfYear": F.weekofyear("Date")}))))
    return built.drop("Rows", "Counted").dropna()


def rolling_stats(daily: DataFrame, windows: Sequence[int] = (7, 14, 30, 90)) -> DataFrame:
    """Trailing mean, deviation, minimum and maximum of daily units."""
    out = {}
    for n in windows:
        frame = _by_day().rowsBetween(1 - n, 0)
        full = F.count("Quantity").over(frame) == n
        for name, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min),
                         ("max", F.max)):
            out[f"Quantity_{name}_{n}"] = F.when(full, fn("Quantity").over(frame))
    return daily.withColumns(out)


def last_n_rows(daily: DataFrame, n: int = 30) -> DataFrame:
    """Per SKU the mean units of its last ``n`` sale days and of the ``n`` before them."""
    back = Window.partitionBy("SKU").orderBy(F.col("Date").desc())
    ranked = daily.withColumn("_r", F.row_number().over(back))
    recent, previous = F.col("_r") <= n, F.col("_r").between(n + 1, 2 * n)

    def mean_if(test: Column) -> Column:
        return safe_div(F.sum(F.when(test, F.col("Quantity"))),
                        F.count(F.when(test, F.col("Quantity"))))

    return ranked.groupBy("SKU").agg(
        F.count("*").alias("sale_days"), mean_if(recent).alias("recent_mean"),
        mean_if(previous).alias("previous_mean"), F.max("Date").alias("last_date"),
        F.max_by("Quantity", "Date").alias("last_quantity"))


def pct_change(monthly: DataFrame, value: str = "Quantity", periods: int = 1,
               key: str = "SKU", order: str = "Date") -> DataFrame:
    """Relative change over ``periods`` rows."""
    before = F.lag(value, periods).over(Window.partitionBy(key).orderBy(order))
    return monthly.withColumn(f"{value}_change_{periods}",
                              safe_div(F.col(value) - before, before))


# -- monthly ------------------------------------------------------------------


def monthly_sku_sales(sales: DataFrame) -> DataFrame:
    """Units, revenue and mean unit price per SKU and month."""
    return (drop_null_keys(sales, "SKU", "Date")
            .groupBy("SKU", F.year("Date").alias("Year"), F.month("Date").alias("Month"))
            .agg(F.sum("Quantity").alias("Quantity"), money_sum("Amount").alias("Amount"),
                 money_avg("Rate").alias("Rate"))
            .withColumn("Date", month_start()))


def cyclic_month(frame: DataFrame) -> DataFrame:
    """Sine and cosine of the month."""
    return frame.withColumns({"Month_Sin": month_sin(), "Month_Cos": month_cos()})


def clean_non_finite(frame: DataFrame, zero: Sequence[str],
                     essential: Sequence[str]) -> DataFrame:
    """Infinite values become null, then 0 in the ``zero`` columns; rows that lack an
    essential value are dropped."""
    return (frame.withColumns({c: finite(c) for c in zero})
            .fillna(0.0, subset=list(zero)).dropna(subset=list(essential)))


def monthly_features(monthly: DataFrame, min_months: int = 3,
                     post_restart_year: int = 2025) -> DataFrame:
    """Lags, means, growth and trend per SKU and month.

    A SKU with a short history uses the longest lag or mean it can fill; the
    choice is made per SKU from its number of months.
    """
    by_month = Window.partitionBy("SKU").orderBy("Date")
    n = F.col("_n")

    def lagged(k: int) -> Column:
        return F.lag("Quantity", k).over(by_month)

    def mean(k: int) -> Column:
        return full_mean("Quantity", k, by_month)

    def change(k: int) -> Column:
        return safe_div(F.col("Quantity") - lagged(k), lagged(k))

    counted = (monthly.withColumn("_n", F.count("*").over(Window.partitionBy("SKU")))
               .where(n >= min_months))
    zero = ["Quantity_Lag1", "Quantity_Lag3", "Quantity_Lag6", "Quantity_Lag12",
            "MA_3", "MA_6", "MA_12", "YoY_Growth"]
    built = counted.withColumns({
        "Quantity_Lag1": lagged(1).cast("double"),
        "Quantity_Lag3": F.when(n >= 4, lagged(3)).otherwise(lagged(1)).cast("double"),
        "Quantity_Lag6": F.when(n >= 7, lagged(6)).otherwise(lagged(3)).cast("double"),
        "Quantity_Lag12": F.when(n >= 13, lagged(12)).otherwise(lagged(6)).cast("double"),
        "MA_3": mean(3),
        "MA_6": F.when(n >= 6, mean(6)).otherwise(mean(3)),
        "MA_12": F.when(n >= 12, mean(12)).otherwise(mean(6)),
        "YoY_Growth": F.when(n >= 13, change(12)).when(n >= 7, change(6)).otherwise(change(3)),
        "Trend": F.row_number().over(by_month) - 1,
        "is_post_restart": (F.col("Year") >= post_restart_year).cast("int")})
    return clean_non_finite(cyclic_month(built), zero,
                            ["Quantity", "Year", "Month"]).drop("_n")


def restart_features(monthly: DataFrame, seasonal: DataFrame, yoy: DataFrame,
                     restart_year: int = 2024, min_months: int = 3) -> DataFrame:
    """Features from the months since the restart, with factors learnt from before it."""
    by_month = Window.partitionBy("SKU").orderBy("Date")
    since = monthly.where(F.col("Year") >= restart_year)
    counted = (since.withColumn("_n", F.count("*").over(Window.partitionBy("SKU")))
               .where(F.col("_n") >= min_months))
    zero = ["Quantity_Lag1", "Quantity_Lag2", "Quantity_Lag3", "MA_2", "MA_3", "MA_6"]
    built = counted.withColumns({
        **{f"Quantity_Lag{k}": F.lag("Quantity", k).over(by_month).cast("double")
           for k in (1, 2, 3)},
        "MA_2": full_mean("Quantity", 2, by_month),
        "MA_3": full_mean("Quantity", 3, by_month),
        "MA_6": F.when(F.col("_n") >= 6, full_mean("Quantity", 6, by_month))
                 .otherwise(full_mean("Quantity", 3, by_month)),
        "Trend": F.row_number().over(by_month) - 1})
    built = cyclic_month(built.drop("_n"))
    return clean_non_finite(with_patterns(built, seasonal, yoy), zero,
                            ["Quantity", "Year", "Month"])


def with_patterns(frame: DataFrame, seasonal: DataFrame, yoy: DataFrame) -> DataFrame:
    """Joins the SKU's factor for the month (1 if unknown) and its yearly growth (0 if unknown)."""
    s = seasonal.select("SKU", F.col("month").alias("Month"), "factor")
    return (frame.join(s, ["SKU", "Month"], "left").join(yoy.select("SKU", "yoy"), "SKU", "left")
            .withColumns({
                "Historical_Seasonal_Factor": F.coalesce("factor", F.lit(1.0)),
                "Historical_YoY_Growth": F.coalesce("yoy", F.lit(0.0)),
                "is_post_restart": F.lit(1)})
            .drop("factor", "yoy"))

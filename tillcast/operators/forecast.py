"""Rule-based forecasts, confidence levels, seasonal patterns and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.frames import drop_null_keys, top_by
from tillcast.functions.numeric import (clamp, ladder, mean_of, percent_of,
                                        safe_div, to_long)
from tillcast.operators.channels import CHANNELS
from tillcast.operators.features import daily_sku_sales
from tillcast.operators.sales import identify_top_skus, with_product_name

# SKU fragments of established product lines.
ESTABLISHED = ("LRM", "CMSM")


def demand_profile(daily: DataFrame, days: int = 30) -> DataFrame:
    """Per SKU everything the forecast needs, from one pass over its sale days.

    The month that lies ``days`` after the last sale gives the seasonal
    multiplier: mean row units of that month over mean row units overall.
    """
    per_sku = Window.partitionBy("SKU")
    back = per_sku.orderBy(F.col("Date").desc())
    ranked = daily.withColumns({"_r": F.row_number().over(back),
                                "_last": F.max("Date").over(per_sku)})
    recent, previous = F.col("_r") <= days, F.col("_r").between(days + 1, 2 * days)
    in_season = F.month("Date") == F.month(F.date_add("_last", days))

    def total(test: Column, value: str = "Quantity") -> Column:
        return F.sum(F.when(test, F.col(value)))

    sums = ranked.groupBy("SKU").agg(
        F.sum("Rows").alias("rows"), F.count("*").alias("sale_days"),
        F.max("_last").alias("last_date"),
        safe_div(total(recent), F.count_if(recent)).alias("recent_mean"),
        safe_div(total(previous), F.count_if(previous)).alias("previous_mean"),
        mean_of("Quantity").alias("daily_mean"),
        F.stddev_samp("Quantity").alias("daily_std"),
        safe_div(total(in_season), total(in_season, "Counted")).alias("season_mean"),
        safe_div(F.sum("Quantity"), F.sum("Counted")).alias("row_mean"))
    multiplier = F.when(F.col("row_mean") > 0,
                        safe_div("season_mean", "row_mean"))
    growth = F.when((F.col("sale_days") >= 2 * days) & (F.col("previous_mean") > 0),
                    safe_div(F.col("recent_mean") - F.col("previous_mean"), "previous_mean"))
    return sums.withColumns({
        "seasonal_multiplier": F.coalesce(multiplier, F.lit(1.0)),
        "growth_rate": F.coalesce(growth, F.lit(0.0))})


def seasonal_multiplier(daily: DataFrame, days: int = 30) -> DataFrame:
    """Multiplier for the month ``days`` after each SKU's last sale."""
    return demand_profile(daily, days).select(
        "SKU", F.month(F.date_add("last_date", days)).alias("month"), "seasonal_multiplier")


def history_counts(history: DataFrame | None) -> DataFrame | None:
    """Rows per SKU before the recent period."""
    if history is None:
        return None
    return drop_null_keys(history, "SKU").groupBy("SKU").agg(F.count("*").alias("history_rows"))


def confidence_score(profile: DataFrame, counts: DataFrame | None) -> DataFrame:
    """Adds ``confidence_score`` and ``confidence`` to a demand profile."""
    variation = F.when(F.col("daily_mean") > 0, safe_div("daily_std", "daily_mean")).otherwise(2.0)
    volume = ladder(F.col("sale_days"), [(120, 30), (60, 20)], 10, at_least=True)
    steady = F.when(F.col("sale_days") > 1, ladder(variation, [(0.5, 25), (1.0, 15)], 5)
                    ).otherwise(0)
    growth = ladder(F.abs("growth_rate"), [(0.1, 20), (0.3, 15), (0.5, 10)], 5)
    activity = ladder(F.col("recent_mean"), [(10, 15), (3, 10)], 5, at_least=True)
    if counts is None:
        joined, context = profile, F.lit(5)
    else:
        joined = profile.join(counts, "SKU", "left")
        known = F.coalesce("history_rows", F.lit(0))
        context = F.when(known > 100, 10).when(known > 50, 7).otherwise(3)
    scored = joined.withColumn("confidence_score", volume + steady + growth + activity + context)
    return scored.withColumn("confidence", _level("confidence_score", 80, 60))


def _level(score: str, high: int, medium: int) -> Column:
    return (F.when(F.col(score) >= high, "High").when(F.col(score) >= medium, "Medium")
            .otherwise("Low"))


def predict_next_month(sales: DataFrame, history: DataFrame | None, sku_master: DataFrame,
                       top_n: int | None = 15, days: int = 30,
                       min_rows: int = 30) -> DataFrame:
    """Next-month units per SKU from recent level, growth and season.

    Only the ``top_n`` SKUs by revenue are forecast; all of them when None. The best SKUs come
    from the same daily sums as the forecast, so sales are read once.
    """
    daily = daily_sku_sales(sales)
    if top_n is not None:
        best = identify_top_skus(daily, top_n).select("SKU")
        daily = daily.join(best, "SKU", "left_semi")
    profile = demand_profile(daily, days).where(
        (F.col("rows") >= min_rows) & (F.col("sale_days") >= min_rows))
    scored = confidence_score(profile, history_counts(history))
    monthly = (F.col("recent_mean") * (1 + F.col("growth_rate")) * days
               * F.col("seasonal_multiplier"))
    forecast = scored.withColumn("_m", monthly)
    return with_product_name(forecast, sku_master).select(
        "SKU", F.greatest(F.lit(0), to_long("_m")).alias("predicted_monthly_quantity"),
        F.greatest(F.lit(0.0), F.col("_m") / days).alias("predicted_daily_average"),
        "growth_rate", "seasonal_multiplier", "confidence", "product_name")


def sku_maturity(sku: Column | str = "SKU", established: Sequence[str] = ESTABLISHED) -> Column:
    """20 for established lines, 15 for long SKUs, else 10."""
    s = F.col(sku) if isinstance(sku, str) else sku
    return (F.when(s.rlike("|".join(established)), 20).when(F.length(s) > 5, 15).otherwise(10))


def enhanced_confidence(predictions: DataFrame,
                        established: Sequence[str] = ESTABLISHED) -> DataFrame:
    """Confidence from growth, volume and maturity instead of the sales pattern."""
    growth = ladder(F.abs("growth_rate"), [(0.1, 40), (0.3, 25), (0.5, 15)], 5)
    volume = ladder(F.col("predicted_monthly_quantity"), [(1000, 30), (300, 20), (100, 15)], 5,
                    at_least=True)
    scored = predictions.withColumn(
        "confidence_score", F.lit(50) + growth + volume + sku_maturity("SKU", established))
    return scored.withColumn("confidence", _level("confidence_score", 85, 65))


def confidence_distribution(predictions: DataFrame) -> DataFrame:
    """SKUs and predicted units per confidence level."""
    return predictions.groupBy("confidence").agg(
        F.count("*").alias("skus"),
        F.sum("predicted_monthly_quantity").alias("total_predicted"))


def prediction_report(predictions: DataFrame) -> DataFrame:
    """Predictions with the daily rate and growth filled in where they are missing."""
    def column(name: str, default: Column) -> Column:
        if name not in predictions.columns:
            return default
        return F.coalesce(name, default)

    quantity = F.col("predicted_monthly_quantity").cast("double")
    return predictions.select(
        F.col("SKU").alias("sku"), column("product_name", F.lit("Unknown Product"))
        .alias("product_name"), quantity.alias("monthly_quantity"),
        column("predicted_daily_average", quantity / 30).alias("daily_average"),
        column("growth_rate", F.lit(0.0)).alias("growth_rate"), "confidence")


def prediction_top10(predictions: DataFrame, n: int = 10) -> DataFrame:
    """Largest predictions and their sum."""
    best = top_by(predictions, n, "predicted_monthly_quantity", "SKU")
    return best.select(
        "SKU", "predicted_monthly_quantity", "predicted_daily_average", "confidence",
        F.sum("predicted_monthly_quantity").over(Window.partitionBy()).alias("total_predicted"))


def prediction_comparison(predictions: DataFrame, sales: DataFrame,
                          sku_master: DataFrame) -> DataFrame:
    """Predicted against actual units per SKU, with accuracy and direction of the error."""
    actual = drop_null_keys(sales, "SKU").groupBy("SKU").agg(F.sum("Quantity").alias("_a"))
    joined = predictions.select("SKU", "predicted_monthly_quantity", "confidence").join(
        actual, "SKU", "left")
    p = F.col("predicted_monthly_quantity").cast("double")
    a = F.coalesce("_a", F.lit(0))
    hit = clamp((1 - safe_div(F.abs(p - a), a)) * 100, 0.0, 100.0)
    accuracy = F.when(a > 0, hit).when(p > 0, 0.0).otherwise(100.0)
    compared = joined.withColumns({
        "predicted_quantity": p, "actual_quantity": a,
        "accuracy_percent": F.round(accuracy, 1), "variance": F.round(p - a, 1),
        "variance_percent": F.round(F.when(a > 0, percent_of(p - a, a)).otherwise(0.0), 1),
        "status": F.when(p > a, "over_predicted").when(p < a, "under_predicted")
                   .otherwise("accurate")})
    return with_product_name(compared, sku_master).select(
        F.col("SKU").alias("sku"), "product_name", "predicted_quantity", "actual_quantity",
        "accuracy_percent", "variance", "variance_percent", "confidence", "status")


def comparison_top(comparison: DataFrame, n: int = 20) -> DataFrame:
    """Most accurate predictions first."""
    return top_by(comparison, n, "accuracy_percent", "sku")


def comparison_summary(comparison: DataFrame) -> DataFrame:
    """Mean accuracy and counts per direction."""
    status = F.col("status")
    return comparison.agg(
        F.round(F.avg("accuracy_percent"), 1).alias("average_accuracy"),
        F.count("*").alias("total_items"),
        F.count_if(status == "over_predicted").alias("over_predicted"),
        F.count_if(status == "under_predicted").alias("under_predicted"),
        F.count_if(status == "accurate").alias("accurate"),
        F.count_if(F.col("accuracy_percent") >= 80).alias("high_accuracy_items"))


# -- patterns -----------------------------------------------------------------


def seasonal_patterns(monthly: DataFrame, min_months: int = 12) -> DataFrame:
    """Per SKU and calendar month: mean monthly units over the SKU's overall mean."""
    per_month = monthly.groupBy("SKU", F.col("Month").alias("month")).agg(
        F.sum("Quantity").alias("q"), F.count("*").alias("n"))
    whole = Window.partitionBy("SKU")
    overall = per_month.withColumns({"sku_q": F.sum("q").over(whole),
                                     "sku_n": F.sum("n").over(whole)})
    return (overall.where((F.col("sku_n") >= min_months) & (F.col("sku_q") > 0))
            .select("SKU", "month",
                    safe_div(safe_div("q", "n"), safe_div("sku_q", "sku_n")).alias("factor")))


def yoy_patterns(monthly: DataFrame, min_months: int = 12) -> DataFrame:
    """Per SKU the mean growth between consecutive years present, over positive bases."""
    yearly = monthly.groupBy("SKU", "Year").agg(F.sum("Quantity").alias("q"),
                                                F.count("*").alias("n"))
    by_year = Window.partitionBy("SKU").orderBy("Year")
    compared = yearly.withColumns({"previous": F.lag("q").over(by_year),
                                   "sku_n": F.sum("n").over(Window.partitionBy("SKU"))})
    growth = F.when(F.col("previous") > 0, safe_div(F.col("q") - F.col("previous"), "previous"))
    return (compared.where(F.col("sku_n") >= min_months).groupBy("SKU")
            .agg(F.avg(growth).alias("yoy")).where(F.col("yoy").isNotNull()))


def pattern_lookup(requests: DataFrame, seasonal: DataFrame, yoy: DataFrame) -> DataFrame:
    """Factor (1 if unknown) and yearly growth (0 if unknown) for (SKU, month) requests."""
    return (requests.join(seasonal, ["SKU", "month"], "left").join(yoy, "SKU", "left")
            .select("SKU", "month", F.coalesce("factor", F.lit(1.0)).alias("seasonal_factor"),
                    F.coalesce("yoy", F.lit(0.0)).alias("yoy_growth"),
                    F.col("factor").isNotNull().alias("has_pattern")))


# -- simple monthly forecasts ---------------------------------------------------


def recent_months(sales: DataFrame, keys: Sequence[str], last: int = 3) -> DataFrame:
    """Per key: number of months, mean of the last monthly sums, mean row units, total."""
    per_month = (drop_null_keys(sales, *keys)
                 .groupBy(*keys, F.trunc("Date", "month").alias("_month"))
                 .agg(F.sum("Quantity").alias("q"), F.count("Quantity").alias("n")))
    return _recent(per_month, keys, last)


def _recent(per_month: DataFrame, keys: Sequence[str], last: int) -> DataFrame:
    back = Window.partitionBy(*keys).orderBy(F.col("_month").desc())
    ranked = per_month.withColumn("_r", F.row_number().over(back))
    late = F.col("_r") <= last
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("months"),
        safe_div(F.sum(F.when(late, F.col("q"))), F.count_if(late)).alias("recent_mean"),
        safe_div(F.sum("q"), F.sum("n")).alias("row_mean"),
        F.sum("q").alias("total_quantity"))


def _simple_forecast(growth: float) -> Column:
    trend = F.greatest(F.lit(0.0), F.col("recent_mean") * (1 + growth))
    return F.when(F.col("months") >= 2, trend).otherwise(F.col("row_mean"))


def simple_monthly_predict(requests: DataFrame, sales: DataFrame,
                           growth: float = 0.1) -> DataFrame:
    """Forecast for each requested SKU; one without sales is reported as discontinued."""
    months = F.col("months")
    confidence = (F.when(months.isNull(), "discontinued").when(months >= 6, "high")
                  .when(months >= 3, "medium").otherwise("low"))
    asked = requests.select(F.col("sku").alias("SKU")).distinct()
    return asked.join(recent_months(sales, ["SKU"]), "SKU", "left").select(
        "SKU", F.coalesce(_simple_forecast(growth), F.lit(0.0)).alias("predicted_quantity"),
        confidence.alias("confidence"),
        F.when(months.isNull(), "discontinued").otherwise("active").alias("status"))


def _two_level_confidence() -> Column:
    return (F.when(F.col("months") >= 6, "high").when(F.col("months") >= 2, "medium")
            .otherwise("low"))


def top5_monthly_predict(sales: DataFrame, n: int = 5, growth: float = 0.1) -> DataFrame:
    """Simple forecast for the SKUs with most units."""
    best = top_by(recent_months(sales, ["SKU"]), n, "total_quantity", "SKU")
    return best.select(
        F.col("SKU").alias("sku"), "total_quantity",
        F.round(_simple_forecast(growth), 1).alias("predicted_quantity"),
        _two_level_confidence().alias("confidence"), F.lit("active").alias("status"))


def channel_predict(sales: DataFrame, channels: Sequence[str] = CHANNELS, n: int | None = 20,
                    states: int = 5, growth: float = 0.1) -> DataFrame:
    """Simple forecast per channel for the SKUs with most units (None: for all), with their
    main states.

    Each SKU has a row for every channel; a channel without sales gets zeros.
    """
    per_sku = drop_null_keys(sales, "SKU").groupBy("SKU").agg(
        F.sum("Quantity").alias("sku_quantity"))
    best = per_sku if n is None else top_by(per_sku, n, "sku_quantity", "SKU")
    wanted = best.withColumn("Partyname", F.explode(F.array(*[F.lit(c) for c in channels])))

    # Monthly sums and state sums come out of one aggregation of the same cells.
    cells = (sales.where(F.col("Partyname").isin(list(channels)))
             .groupBy("SKU", "Partyname", "Stateto", F.trunc("Date", "month").alias("_month"))
             .agg(F.sum("Quantity").alias("q"), F.count("Quantity").alias("n")))
    if n is not None:
        cells = cells.join(best.select("SKU"), "SKU", "left_semi")
    sku, channel, state, month = (F.col(c) for c in ("SKU", "Partyname", "Stateto", "_month"))
    sums = cells.groupingSets(
        [[sku, channel, month], [sku, channel, state]], "SKU", "Partyname", "_month", "Stateto"
    ).agg(F.sum("q").alias("q"), F.sum("n").alias("n"),
          (F.grouping("_month") == 1).alias("_by_state"))
    rank = Window.partitionBy("SKU", "Partyname", "_by_state").orderBy(
        month.desc(), state.isNull(), F.col("q").desc(), state)
    ranked = sums.withColumn("position", F.row_number().over(rank))
    by_state, q = F.col("_by_state"), F.col("q")
    late = ~by_state & (F.col("position") <= 3)
    leading = by_state & (F.col("position") <= states) & state.isNotNull()
    per_channel = ranked.groupBy("SKU", "Partyname").agg(
        F.count_if(~by_state).alias("months"),
        safe_div(F.sum(F.when(late, q)), F.count_if(late)).alias("recent_mean"),
        safe_div(F.sum(F.when(~by_state, q)), F.sum(F.when(~by_state, F.col("n"))))
        .alias("row_mean"),
        F.sum(F.when(~by_state, q)).alias("total_quantity"),
        F.sort_array(F.collect_list(F.when(leading, F.struct(
            "position", state.alias("state"), q.alias("quantity"))))).alias("_states"))
    joined = wanted.join(per_channel, ["SKU", "Partyname"], "left")
    top_states = F.transform("_states", lambda s: F.struct(
        s["position"].alias("position"), s["state"].alias("state"),
        s["quantity"].alias("quantity"),
        F.round(percent_of(s["quantity"], F.col("total_quantity")), 1).alias("percentage")))
    zero = F.lit(0.0)
    forecast = joined.withColumns({
        "predicted_quantity": F.coalesce(F.round(_simple_forecast(growth), 1), zero),
        "top_states": top_states})
    both = F.round(F.sum("predicted_quantity").over(Window.partitionBy("SKU")), 1)
    return forecast.select(
        F.col("SKU").alias("sku"), F.col("Partyname").alias("channel"), "predicted_quantity",
        F.when(F.col("months").isNull(), "low").otherwise(_two_level_confidence())
        .alias("confidence"),
        F.coalesce("total_quantity", F.lit(0)).alias("channel_quantity"),
        F.coalesce(F.round("row_mean", 1), zero).alias("avg_monthly_quantity"),
        F.col("sku_quantity").alias("total_historical_quantity"),
        both.alias("total_predicted_quantity"),
        F.when(both > 0, "active").otherwise("inactive").alias("status"), "top_states")


def channel_predict_summary(forecast: DataFrame) -> DataFrame:
    """SKUs forecast, active ones, and their predicted units."""
    per_sku = forecast.groupBy("sku").agg(
        F.first("status").alias("status"),
        F.first("total_predicted_quantity").alias("q"))
    return per_sku.agg(
        F.count("*").alias("total_skus"),
        F.count_if(F.col("status") == "active").alias("active_skus"),
        F.round(F.sum("q"), 1).alias("total_predicted_quantity"))


# -- accuracy -------------------------------------------------------------------


def accuracy_metrics(tested: DataFrame, cap: float | None = 200.0) -> DataFrame:
    """Per SKU mean absolute error and percentage error, capped, of ``actual``/``predicted`` rows.

    A zero actual has no percentage error and is left out of that mean.
    """
    error = F.abs(F.col("predicted") - F.col("actual"))
    mape = F.avg(safe_div(error, F.abs("actual"))) * 100
    capped = mape if cap is None else F.least(mape, F.lit(cap))
    ordered = F.sort_array(F.collect_list(F.struct("Date", "actual", "predicted")))
    return tested.groupBy("SKU").agg(
        F.count("*").alias("test_months"), F.avg(error).alias("mae"), capped.alias("mape"),
        F.avg("actual").alias("avg_monthly_demand"), ordered.alias("predictions"))


def accuracy_report(metrics: DataFrame) -> DataFrame:
    """Mean errors over SKUs, the planning band they fall in, and stock buffers."""
    means = metrics.agg(F.avg("mae").alias("overall_mae"), F.avg("mape").alias("overall_mape"),
                        F.sum("test_months").alias("total_test_months"))
    band = ladder(F.col("overall_mape"), [(20, "excellent"), (40, "good")], "poor")
    return means.withColumns({"band": band, "safety_buffer": F.col("overall_mae"),
                              "variation_buffer": F.col("overall_mae") * 1.5})


def holdout_tail(monthly: DataFrame, share: float = 0.8, min_train: int = 3,
                 min_months: int = 0) -> DataFrame:
    """Marks each SKU's last months as test rows.

    The first ``share`` of the months (at least one) train. Where fewer than
    ``min_train`` would train, or the SKU has fewer than ``min_months``, all
    months train and the last one tests.
    """
    by_month = Window.partitionBy("SKU").orderBy("Date")
    n = F.count("*").over(Window.partitionBy("SKU"))
    cut = F.greatest(F.lit(1), (n * F.lit(share)).cast("int"))
    numbered = monthly.withColumns({"_i": F.row_number().over(by_month), "_n": n, "_cut": cut})
    few = (F.col("_cut") < min_train) | (F.col("_n") < min_months)
    return numbered.withColumns({
        "is_train": F.when(few, True).otherwise(F.col("_i") <= F.col("_cut")),
        "is_test": F.when(few, F.col("_i") == F.col("_n")).otherwise(F.col("_i") > F.col("_cut"))
    }).drop("_i", "_n", "_cut")


def backtest(monthly: DataFrame, folds: int | None = 6, window: int = 3,
             growth: float = 0.1, keep: Sequence[str] = ()) -> DataFrame:
    """Walk-forward test of the simple forecast over each SKU's last months.

    Month ``t`` is forecast from the months before it only; all folds come
    from one window pass, without a copy of the data per cutoff. All months
    are tested when ``folds`` is None; ``keep`` names columns to pass through.
    """
    by_month = Window.partitionBy("SKU").orderBy("Date")
    earlier = by_month.rowsBetween(-window, -1)
    back = Window.partitionBy("SKU").orderBy(F.col("Date").desc())
    predicted = safe_div(F.sum("Quantity").over(earlier),
                         F.count("Quantity").over(earlier)) * (1 + growth)
    rows = monthly.select(
        "SKU", "Date", F.col("Quantity").cast("double").alias("actual"),
        predicted.alias("predicted"),
        F.lag("Quantity").over(by_month).cast("double").alias("previous"),
        F.row_number().over(back).alias("fold"), *keep)
    tested = rows.where(F.col("predicted").isNotNull())
    return tested if folds is None else tested.where(F.col("fold") <= folds)


def backtest_metrics(tested: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MAPE, R² and direction accuracy over all tested rows, or per value of ``by``."""
    a, p, prev = F.col("actual"), F.col("predicted"), F.col("previous")
    error = p - a
    same_way = F.signum(a - prev) == F.signum(p - prev)
    sums = tested.groupBy(*by).agg(
        F.count("*").alias("tests"), F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(safe_div(F.abs(error), F.abs(a))) * 100).alias("mape"),
        F.sum(error * error).alias("sse"), F.var_pop(a).alias("spread"),
        (F.avg(F.when(prev.isNotNull(), same_way.cast("double"))) * 100)
        .alias("direction_accuracy"))
    fit = 1 - safe_div("sse", F.col("spread") * F.col("tests"))
    return sums.select(*by, "tests", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"),
                       F.round("mape", 4).alias("mape"), F.round(fit, 6).alias("r2"),
                       F.round("direction_accuracy", 4).alias("direction_accuracy"))


def forecast_levels(sales: DataFrame, last: int = 3, growth: float = 0.1) -> DataFrame:
    """Simple forecast at SKU, channel, state and warehouse level, from one read.

    Sales are first summed to the finest cell, so the grouping sets multiply
    the summed cells and not the sales rows.
    """
    levels = ["SKU", "Partyname", "Stateto", "Godown"]
    cells = (sales.groupBy(*levels, F.trunc("Date", "month").alias("_month"))
             .agg(F.sum("Quantity").alias("q"), F.count("Quantity").alias("n")))
    grouped = cells.groupingSets(
        [[F.col(c), F.col("_month")] for c in levels], *levels, "_month"
    ).agg(F.sum("q").alias("q"), F.sum("n").alias("n"),
          *[F.grouping(c).alias(f"_g_{c}") for c in levels])
    name, key = F.lit(None), F.lit(None)
    for c in levels:
        name = F.when(F.col(f"_g_{c}") == 0, F.lit(c)).otherwise(name)
        key = F.when(F.col(f"_g_{c}") == 0, F.col(c)).otherwise(key)
    monthly = grouped.select(name.alias("level"), key.alias("key"), "_month", "q", "n").where(
        F.col("key").isNotNull())
    return _recent(monthly, ["level", "key"], last).select(
        "level", "key", "months", F.col("total_quantity"),
        F.round(_simple_forecast(growth), 1).alias("predicted_quantity"))

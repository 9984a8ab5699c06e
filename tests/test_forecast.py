"""Forecast thresholds, seasonality, confidence and the adaptive monthly features."""

import datetime as dt
import random

import pytest
from retail_help import rows

from tillcast.operators import features, forecast

DAY0 = dt.date(2025, 1, 1)
SALES = "Date date, SKU string, Quantity long, Amount double"


def _days(sku, quantities, gap=1):
    return [(DAY0 + dt.timedelta(days=i * gap), sku, q, 100.0 * q)
            for i, q in enumerate(quantities)]


def _master(spark):
    return spark.createDataFrame([("A", "Heater")], "sku string, category string")


@pytest.mark.parametrize("n, growth", [(29, None), (30, 0.0), (59, 0.0), (60, 1.0)])
def test_sale_day_thresholds(spark, n, growth):
    half = max(n - 30, 0)
    sales = spark.createDataFrame(_days("A", [5] * half + [10] * (n - half)), SALES)
    got = rows(forecast.predict_next_month(sales, None, _master(spark)))
    if growth is None:
        assert got == []
        return
    assert got[0]["growth_rate"] == growth
    assert got[0]["product_name"] == "Heater"


def test_level_growth_and_unseen_season(spark):
    sales = spark.createDataFrame(_days("B", [5] * 30 + [10] * 30), SALES)
    got = rows(forecast.predict_next_month(sales, None, _master(spark)))[0]
    # Last day 1 March; the month 30 days later is March, seen once with quantity 10.
    assert got["seasonal_multiplier"] == pytest.approx(10 / 7.5)
    assert got["predicted_monthly_quantity"] == int(10 * 2 * 30 * 10 / 7.5)
    assert got["product_name"] == "Unknown Product"


def test_month_without_sales_has_no_season(spark):
    sales = spark.createDataFrame(_days("B", [4] * 31), SALES)
    got = rows(forecast.seasonal_multiplier(features.daily_sku_sales(sales)))[0]
    assert (got["month"], got["seasonal_multiplier"]) == (3, 1.0)


def test_confidence_branches(spark):
    schema = ("SKU string, sale_days long, daily_mean double, daily_std double, "
              "growth_rate double, recent_mean double")
    profile = spark.createDataFrame([
        ("steady", 150, 20.0, 1.0, 0.0, 20.0), ("wild", 45, 2.0, 4.0, -0.9, 2.0),
        ("negative", 70, -1.0, 1.0, 0.2, -1.0), ("single", 1, 5.0, None, 0.0, 5.0)], schema)
    counts = spark.createDataFrame([("steady", 101), ("wild", 51)],
                                   "SKU string, history_rows long")
    got = {r["SKU"]: (r["confidence_score"], r["confidence"])
           for r in rows(forecast.confidence_score(profile, counts))}
    assert got["steady"] == (30 + 25 + 20 + 15 + 10, "High")
    assert got["wild"] == (10 + 5 + 5 + 5 + 7, "Low")
    assert got["negative"] == (20 + 5 + 15 + 5 + 3, "Low")
    assert got["single"] == (10 + 0 + 20 + 10 + 3, "Low")
    alone = {r["SKU"]: r["confidence_score"]
             for r in rows(forecast.confidence_score(profile, None))}
    assert alone["steady"] == 95


def test_windows_follow_rows_not_the_calendar(spark):
    daily = features.daily_sku_sales(spark.createDataFrame(
        _days("A", range(1, 9), gap=5), SALES))
    got = rows(features.daily_trend_slope(features.daily_rolling_means(
        features.daily_lags(daily, (1,)), (7,)), (7,)), "Date")
    assert [r["Quantity_lag_1"] for r in got] == [None, 1, 2, 3, 4, 5, 6, 7]
    assert [r["Quantity_rolling_7"] for r in got] == [None] * 6 + [4.0, 5.0]
    assert got[5]["Quantity_trend_7d"] is None
    assert got[7]["Quantity_trend_7d"] == pytest.approx(1.0)


@pytest.mark.parametrize("n, lag3, lag12, ma6", [
    (3, 20.0, 0.0, 20.0), (4, 10.0, 0.0, 30.0), (7, 40.0, 10.0, 45.0), (13, 100.0, 10.0, 105.0)])
def test_adaptive_lags(spark, n, lag3, lag12, ma6):
    monthly = spark.createDataFrame(
        [("A", 2023 + i // 12, i % 12 + 1, 10 * (i + 1), 1.0, 1.0,
          dt.date(2023 + i // 12, i % 12 + 1, 1)) for i in range(n)],
        "SKU string, Year int, Month int, Quantity long, Amount double, Rate double, Date date")
    last = rows(features.monthly_features(monthly), "Date")[-1]
    assert (last["Quantity_Lag3"], last["Quantity_Lag12"], last["MA_6"]) == (lag3, lag12, ma6)
    assert last["Trend"] == n - 1


def test_two_months_are_not_enough(spark):
    monthly = spark.createDataFrame(
        [("A", 2024, m, 5, 1.0, 1.0, dt.date(2024, m, 1)) for m in (1, 2)],
        "SKU string, Year int, Month int, Quantity long, Amount double, Rate double, Date date")
    assert features.monthly_features(monthly).count() == 0


def test_patterns_need_a_year_and_a_base(spark):
    schema = "SKU string, Year int, Month int, Quantity long"
    full = [("A", y, m, 10 * (y - 2020)) for y in (2021, 2022) for m in range(1, 7)]
    monthly = spark.createDataFrame(
        full + [("B", 2021, m, 5) for m in range(1, 12)]
        + [("Z", 2020 + m // 7, m % 12 + 1, 0) for m in range(12)], schema)
    assert {r["SKU"] for r in rows(forecast.seasonal_patterns(monthly))} == {"A"}
    assert rows(forecast.yoy_patterns(monthly)) == [{"SKU": "A", "yoy": 1.0}]


def test_simple_forecast_states(spark):
    data = [(dt.date(2025, m, 3), "many", 10 * m, 1.0) for m in range(1, 7)]
    data += [(dt.date(2025, 1, d), "one", d, 1.0) for d in (1, 2, 3)]
    requests = spark.createDataFrame([("many",), ("one",), ("gone",)], "sku string")
    got = {r["SKU"]: r for r in rows(forecast.simple_monthly_predict(
        requests, spark.createDataFrame(data, SALES)))}
    assert got["many"]["predicted_quantity"] == pytest.approx(55.0)
    assert got["many"]["confidence"] == "high"
    assert (got["one"]["predicted_quantity"], got["one"]["confidence"]) == (2.0, "low")
    assert (got["gone"]["predicted_quantity"], got["gone"]["status"]) == (0.0, "discontinued")


def test_comparison_without_sales(spark):
    predictions = spark.createDataFrame(
        [("A", 10, "High"), ("B", 10, "Low"), ("C", 0, "Low"), ("D", 300, "Low")],
        "SKU string, predicted_monthly_quantity long, confidence string")
    sales = spark.createDataFrame([("A", 8), ("D", 100)], "SKU string, Quantity long")
    got = {r["sku"]: r for r in rows(forecast.prediction_comparison(
        predictions, sales, _master(spark)))}
    assert (got["A"]["accuracy_percent"], got["A"]["status"]) == (75.0, "over_predicted")
    assert (got["B"]["accuracy_percent"], got["B"]["variance_percent"]) == (0.0, 0.0)
    assert (got["C"]["accuracy_percent"], got["C"]["status"]) == (100.0, "accurate")
    assert got["D"]["accuracy_percent"] == 0.0


def test_holdout_marks(spark):
    def marks(n, **how):
        frame = spark.createDataFrame(
            [("A", dt.date(2024, m, 1)) for m in range(1, n + 1)], "SKU string, Date date")
        got = rows(forecast.holdout_tail(frame, **how), "Date")
        return sum(r["is_train"] for r in got), sum(r["is_test"] for r in got)

    assert marks(10) == (8, 2)
    assert marks(3) == (3, 1)
    assert marks(5, min_months=6) == (5, 1)


def test_accuracy_is_capped(spark):
    tested = spark.createDataFrame(
        [("A", dt.date(2024, 1, 1), 1.0, 100.0), ("B", dt.date(2024, 1, 1), 10.0, 9.0)],
        "SKU string, Date date, actual double, predicted double")
    got = {r["SKU"]: r for r in rows(forecast.accuracy_metrics(tested))}
    assert got["A"]["mape"] == 200.0
    assert got["B"]["mape"] == pytest.approx(10.0)
    assert rows(forecast.accuracy_report(forecast.accuracy_metrics(tested)))[0]["band"] == "poor"


def test_slopes_from_running_sums_equal_regressions(spark):
    """Within 1e-9 of a regression per frame, over long and short histories, gaps included."""
    pick = random.Random(4)
    made = [(sku, dt.date(2020, 1, 1) + dt.timedelta(days=d), None if pick.random() < gap else pick.randint(0, top))
            for sku, n, top, gap in (("long", 900, 50, 0), ("huge", 60, 10 ** 12, 0), ("gaps", 80, 9, 0.1),
                                     ("short", 6, 9, 0)) for d in range(n)]
    daily = spark.createDataFrame(made, "SKU string, Date date, Quantity long")
    got = rows(features.daily_trend_slope(daily, [7, 30]), "SKU", "Date")
    by_sku = {}
    for r in got:
        by_sku.setdefault(r["SKU"], []).append(r)
    for mine in by_sku.values():
        for n in (7, 30):
            for i, r in enumerate(mine):
                window = [x["Quantity"] for x in mine[max(0, i + 1 - n):i + 1]]
                slope = r[f"Quantity_trend_{n}d"]
                if len(window) < n or None in window:
                    assert slope is None
                    continue
                middle = (n - 1) / 2
                want = sum((k - middle) * y for k, y in enumerate(window)) / sum(
                    (k - middle) ** 2 for k in range(n))
                assert slope == pytest.approx(want, rel=1e-9, abs=1e-9)
    plan = features.daily_trend_slope(daily)._jdf.queryExecution().executedPlan().toString()
    assert "regr_slope" not in plan

"""Models: shape, non-negative and repeatable results, registry states."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from retail_help import rows

from tillcast.operators import features, forecast, ml
from tillcast.plans import queries


@pytest.fixture(scope="module")
def monthly(tables):
    return features.monthly_sku_sales(tables.sales("Date", "SKU", "Quantity", "Amount", "Rate"))


@pytest.fixture(scope="module")
def patterns(tables):
    old = features.monthly_sku_sales(tables.history("Date", "SKU", "Quantity", "Amount", "Rate"))
    return forecast.seasonal_patterns(old), forecast.yoy_patterns(old)


def test_monthly_model(monthly):
    table = ml.monthly_training_table(monthly, 2001)
    model = ml.train_monthly_model(table, trees=10)
    tested = ml.model_test_rows(model, table)
    first = rows(tested, "SKU", "Date")
    assert len(first) == table.where("is_test").count()
    assert all(r["predicted"] >= 0 for r in first)
    again = rows(ml.model_test_rows(ml.train_monthly_model(table, trees=10), table),
                 "SKU", "Date")
    assert [r["predicted"] for r in again] == pytest.approx([r["predicted"] for r in first])
    quality = ml.regression_quality(tested)
    assert quality["mae"] > 0 and quality["rmse"] >= quality["mae"]
    following = rows(ml.score_next_month(model, table, 2001), "sku")
    assert len(following) == 25
    assert all(r["next_month"] >= "2001-09" for r in following)


def test_label_is_capped(monthly):
    table = ml.monthly_training_table(monthly, 2001)
    assert table.where("label > Quantity OR label < 0").count() == 0
    assert table.where("label < Quantity").count() > 0


def test_restart_model_and_seasonal_score(monthly, patterns):
    seasonal, yoy = patterns
    table = ml.restart_training_table(monthly, seasonal, yoy, 2000)
    model = ml.train_restart_model(table, trees=10)
    scored = rows(ml.score_next_month_seasonal(model, table, seasonal, yoy), "sku")
    assert len(scored) == 25
    assert all(r["has_historical_patterns"] for r in scored)
    assert any(r["seasonal_adjustment"] != 1.0 for r in scored)


def test_daily_model_gate(tables):
    daily = features.daily_sku_sales(tables.recent("Date", "SKU", "Quantity", "Amount"))
    built = features.daily_features(daily)
    metrics = ml.daily_model_metrics(ml.train_daily_model(built, trees=10, depth=4), built).first()
    assert metrics.validation_rows > 0 and metrics.rmse > 0
    assert metrics.passes == (metrics.mape <= 12)


def test_ensemble_is_the_weighted_mean(monthly):
    table = ml.monthly_training_table(monthly, 2001)
    for r in rows(ml.ensemble_forecast(table, trees=5, rounds=3))[:50]:
        blend = 0.3 * r["linear"] + 0.4 * r["forest"] + 0.3 * r["boosting"]
        assert r["predicted"] == pytest.approx(max(blend, 0.0))


def test_registry(spark, monthly, tmp_path):
    table = ml.monthly_training_table(monthly, 2001)
    model = ml.train_monthly_model(table, trees=3)
    path = ml.save_model(spark, model, table.select("SKU").distinct(), str(tmp_path), "monthly",
                         "2001-11-01")
    known = ml.load_registry(spark, str(tmp_path))
    assert known.count() == 25 and known.first().model_type == "monthly"
    assert ml.load_model(path).stages[-1].getNumTrees == 3


def test_retraining_rules(spark):
    def day(text):
        return dt.datetime.fromisoformat(text)

    registry = spark.createDataFrame(
        [("old", day("2025-05-01")), ("fresh", day("2025-06-28")), ("idle", day("2025-06-15")),
         ("new_data", day("2025-06-15"))], "sku string, training_date timestamp")
    skus = spark.createDataFrame([(s,) for s in ("old", "fresh", "idle", "new_data", "none")],
                                 "SKU string")
    last = spark.createDataFrame(
        [("fresh", dt.date(2025, 6, 30)), ("idle", dt.date(2025, 6, 1)),
         ("new_data", dt.date(2025, 6, 20))], "SKU string, last_sale date")
    got = {r["sku"]: r["status"] for r in rows(
        ml.needs_retraining(skus, registry, last, "2025-06-30"))}
    assert got == {"old": "Needs retraining", "fresh": "Up to date", "idle": "Up to date",
                   "new_data": "Needs retraining", "none": "No model found"}


def test_origin_inputs_know_the_past_only(spark, monthly):
    """Changing a SKU's last month changes no input, and only the label of that month."""
    table = rows(ml.origin_table(monthly), "SKU", "Date")
    last = max(r["Date"] for r in table)
    other = monthly.withColumn("Quantity", F.when(F.col("Date") == F.lit(last), F.col("Quantity") * 100)
                               .otherwise(F.col("Quantity")))
    for a, b in zip(table, rows(ml.origin_table(other), "SKU", "Date"), strict=True):
        assert all(a[c] == b[c] for c in ml.ORIGIN_INPUTS)
        assert (a["label"] == b["label"]) == (a["Date"] != last or a["label"] == 0)


def test_rolling_origin_trains_before_each_cutoff(spark, monthly, tmp_path):
    ml.origin_table(monthly).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    cutoffs, seen = ml.origins(table, 3), []

    def fit(train):
        seen.append(train.agg(F.max("Date")).first()[0])
        return ml._fit(ml._pipeline(ml.ORIGIN_INPUTS, ml.forest(10, 5, 5)), train, ml.ORIGIN_INPUTS)

    tested = ml.rolling_origin(table, cutoffs, fit=fit)
    assert len(cutoffs) == 3 and all(s < c for s, c in zip(seen, cutoffs, strict=True))
    found = {r["cutoff"]: r for r in rows(ml.origin_metrics(tested))}
    assert set(found) == {*cutoffs, None} and found[None]["tests"] == sum(found[c]["tests"] for c in cutoffs)
    kept = rows(tested)
    for c in cutoffs:
        mine = [r for r in kept if r["cutoff"] == c]
        assert found[c]["mae"] == pytest.approx(sum(abs(r["predicted"] - r["actual"]) for r in mine) / len(mine), abs=1e-4)
        assert found[c]["average_mae"] == pytest.approx(sum(abs(r["average"] - r["actual"]) for r in mine) / len(mine), abs=1e-4)


def test_a_constant_forecast_is_found_out(spark, monthly):
    """The flags of the model queries fail where nothing was learnt."""
    tested = monthly.select("SKU", "Date", F.col("Quantity").cast("double").alias("actual"))
    mean = tested.agg(F.avg("actual")).first()[0]
    for predicted in (F.lit(0.0), F.lit(mean), F.lit(mean * 2)):
        flat = tested.withColumn("predicted", predicted)
        assert not flat.limit(1).select(queries._beats_constant(flat, "predicted").alias("b")).first().b
    good = tested.withColumn("predicted", F.col("actual") * 0.9)
    assert good.limit(1).select(queries._beats_constant(good, "predicted").alias("b")).first().b


def test_small_training_tables_have_few_parts(spark):
    """Parts follow from the rows, not from the number of shuffle partitions."""
    made = spark.range(500).selectExpr("concat('S', id % 7) AS SKU", "date_add(DATE'2024-01-01', int(id)) AS Date",
                                       "double(id) AS label", "double(id) AS x")
    with ml._spread(made, ["x"]) as kept:
        assert kept.rdd.getNumPartitions() == 1 and kept.count() == 500
    assert [ml._parts(n, 8) for n in (0, 4_000, 4_001, 10**9)] == [1, 1, 2, 8]

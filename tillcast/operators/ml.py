"""Spark ML demand models.

One model is trained over all SKUs at once, with the SKU's own level as a
feature, instead of one small model per SKU. Training is distributed tree
building; no SKU's data is gathered.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import date, timedelta

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tillcast.functions.calendar import month_cos, month_sin
from tillcast.functions.frames import top_by
from tillcast.functions.numeric import safe_div
from tillcast.operators.features import (LAGS, WINDOWS, monthly_features, restart_features,
                                         with_patterns)
from tillcast.operators.forecast import accuracy_metrics, backtest_metrics, holdout_tail

DAILY_COLUMNS = (
    ["Year", "Month", "DayOfWeek", "DayOfMonth", "WeekOfYear"]
    + [f"{c}_lag_{k}" for k in LAGS for c in ("Quantity", "Amount")]
    + [f"{c}_rolling_{n}" for n in WINDOWS for c in ("Quantity", "Amount")]
    + ["Quantity_trend_7d", "Quantity_trend_30d"])
# What a training table holds besides the inputs of a model.
NOT_INPUTS = {"SKU", "Date", "Quantity", "Amount", "Rate", "label", "is_train", "is_test"}
# The SKU as a model input: its mean units over the training months.
LEVEL = "sku_level"
SEED = 42


def model_inputs(table: DataFrame) -> list[str]:
    """The columns that the feature steps and the SKU's level have added."""
    return [c for c in table.columns if c not in NOT_INPUTS]


def forest(trees: int, depth: int, min_leaf: int, subset: str = "auto") -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features", labelCol="label", predictionCol="raw_prediction",
        numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf,
        featureSubsetStrategy=subset, cacheNodeIds=True, seed=SEED)


def _pipeline(columns: Sequence[str], model, scale: bool = False) -> Pipeline:
    assembled = "assembled" if scale else "features"
    stages = [VectorAssembler(inputCols=list(columns), outputCol=assembled)]
    if scale:
        stages.append(StandardScaler(inputCol=assembled, outputCol="features", withMean=True))
    return Pipeline(stages=stages + [model])


# Rows for one part of a training table: every part sends statistics for every tree node.
ROWS_A_PART = 4_000


def _parts(rows: int, most: int) -> int:
    """Parts for so many training rows: few for small data, at most ``most``."""
    return min(most, max(1, -(-rows // ROWS_A_PART)))


@contextmanager
def _spread(train: DataFrame, columns: Sequence[str]) -> Iterator[DataFrame]:
    """Training rows split by SKU and date, in a fixed order, while the block lasts.

    The split also divides a SKU with very many rows. Its parts follow from the number of
    rows: adaptive execution does not merge those of a kept table, so a few thousand rows
    would send statistics from every shuffle partition. The order makes the drawn samples
    repeatable. Tree training reads its input many times, so the rows are kept on executors
    and spilled to their disks; a lost block is rebuilt from the features' lineage.
    """
    most = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = train.select("SKU", "Date", "label", *columns).persist(StorageLevel.MEMORY_AND_DISK)
    spread = None
    try:
        spread = (rows.repartition(_parts(rows.count(), most), "SKU", "Date")
                  .sortWithinPartitions("SKU", "Date").persist(StorageLevel.MEMORY_AND_DISK))
        yield spread
    finally:
        if spread is not None:
            spread.unpersist()
        rows.unpersist()


def _fit(pipeline: Pipeline, train: DataFrame, columns: Sequence[str]) -> PipelineModel:
    with _spread(train, columns) as kept:
        return pipeline.fit(kept)


def _score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn(
        "predicted", F.greatest(F.col("raw_prediction"), F.lit(0.0))).drop(
        "assembled", "features", "raw_prediction")


# -- daily ------------------------------------------------------------------------


def split_last_days(features: DataFrame, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Training rows up to ``days`` before the last date, and the rows after."""
    cut = features.agg(F.date_sub(F.max("Date"), days).alias("c")).scalar()
    labelled = features.withColumn("label", F.col("Quantity").cast("double"))
    return labelled.where(F.col("Date") <= cut), labelled.where(F.col("Date") > cut)


def train_daily_model(features: DataFrame, trees: int = 100, depth: int = 10) -> PipelineModel:
    """Forest on scaled daily features of all but the last 30 days."""
    train, _ = split_last_days(features)
    return _fit(_pipeline(DAILY_COLUMNS, forest(trees, depth, 2, "all"), scale=True), train,
                DAILY_COLUMNS)


def daily_model_metrics(model: PipelineModel, features: DataFrame,
                        target_mape: float = 12.0) -> DataFrame:
    """MAPE, RMSE, the spread of the actual units (which is the RMSE of the best constant) and
    whether the model passes, on the last 30 days."""
    _, held = split_last_days(features)
    error = F.col("raw_prediction") - F.col("label")
    sums = model.transform(held).agg(
        F.count("*").alias("validation_rows"),
        (F.avg(safe_div(F.abs(error), F.abs("label"))) * 100).alias("mape"),
        F.sqrt(F.avg(error * error)).alias("rmse"), F.stddev_pop("label").alias("spread"))
    return sums.withColumn("passes", F.col("mape") <= target_mape)


# -- monthly ----------------------------------------------------------------------


def _levelled(split: DataFrame) -> DataFrame:
    """Adds the SKU's mean training units; all its rows carry the same value."""
    whole = Window.partitionBy("SKU")
    return split.withColumn(LEVEL, F.avg(
        F.when(F.col("is_train"), F.col("Quantity"))).over(whole))


def _capped_label(split: DataFrame, q: float = 0.95) -> DataFrame:
    """Label clipped to [0, the SKU's 95th percentile of training units]."""
    whole = Window.partitionBy("SKU")
    limit = F.percentile(F.when(F.col("is_train"), F.col("Quantity")), F.lit(q)).over(whole)
    return split.withColumn("label", F.greatest(
        F.lit(0.0), F.least(F.col("Quantity").cast("double"), limit)))


def monthly_training_table(monthly: DataFrame, post_restart_year: int = 2025) -> DataFrame:
    """Monthly features with train and test marks and the capped label."""
    features = monthly_features(monthly, post_restart_year=post_restart_year)
    return _levelled(_capped_label(holdout_tail(features)))


def restart_training_table(monthly: DataFrame, seasonal: DataFrame, yoy: DataFrame,
                           restart_year: int = 2024) -> DataFrame:
    """Post-restart features; SKUs with under six months train on all of them."""
    features = restart_features(monthly, seasonal, yoy, restart_year)
    split = holdout_tail(features, min_months=6)
    return _levelled(split).withColumn("label", F.col("Quantity").cast("double"))


def train_monthly_model(table: DataFrame, trees: int = 150, depth: int = 10) -> PipelineModel:
    columns = model_inputs(table)
    return _fit(_pipeline(columns, forest(trees, depth, 1, "sqrt")), table.where("is_train"),
                columns)


def train_restart_model(table: DataFrame, trees: int = 100, depth: int = 8) -> PipelineModel:
    columns = model_inputs(table)
    return _fit(_pipeline(columns, forest(trees, depth, 1, "sqrt")), table.where("is_train"),
                columns)


def model_test_rows(model: PipelineModel, table: DataFrame) -> DataFrame:
    """Actual and predicted units of the test months."""
    return _score(model, table.where("is_test")).select(
        "SKU", "Date", F.col("Quantity").cast("double").alias("actual"), "predicted")


def _last_rows_rolled(table: DataFrame) -> DataFrame:
    """Each SKU's last month moved on by one; its lags and means are kept."""
    back = Window.partitionBy("SKU").orderBy(F.col("Date").desc())
    last = table.withColumn("_r", F.row_number().over(back)).where(F.col("_r") == 1).drop("_r")
    after = F.add_months("Date", 1)
    return last.withColumn("Date", after).withColumns({
        "Year": F.year("Date"), "Month": F.month("Date"), "Trend": F.col("Trend") + 1
    }).withColumns({"Month_Sin": month_sin(), "Month_Cos": month_cos()})


def score_next_month(model: PipelineModel, table: DataFrame,
                     post_restart_year: int = 2025) -> DataFrame:
    """Next-month units per SKU from the monthly model."""
    rolled = _last_rows_rolled(table).withColumn(
        "is_post_restart", (F.col("Year") >= post_restart_year).cast("int"))
    return _score(model, rolled).select(
        F.col("SKU").alias("sku"), F.date_format("Date", "yyyy-MM").alias("next_month"),
        F.col("predicted").alias("predicted_quantity"), F.lit("medium").alias("confidence"))


def score_next_month_seasonal(model: PipelineModel, table: DataFrame, seasonal: DataFrame,
                              yoy: DataFrame) -> DataFrame:
    """Next-month units from the restart model, times the SKU's seasonal factor."""
    rolled = _last_rows_rolled(table).drop(
        "Historical_Seasonal_Factor", "Historical_YoY_Growth", "is_post_restart")
    ready = with_patterns(rolled, seasonal, yoy)
    known = seasonal.select("SKU").distinct().withColumn("_known", F.lit(True))
    factor = F.col("Historical_Seasonal_Factor")
    return _score(model, ready).join(known, "SKU", "left").select(
        F.col("SKU").alias("sku"), F.date_format("Date", "yyyy-MM").alias("next_month"),
        (F.col("predicted") * factor).alias("predicted_quantity"),
        F.lit("medium").alias("confidence"), factor.alias("seasonal_adjustment"),
        F.coalesce("_known", F.lit(False)).alias("has_historical_patterns"))


def analyze_top_skus_monthly(monthly: DataFrame, top_n: int = 5, trees: int = 150,
                             post_restart_year: int = 2025) -> DataFrame:
    """Accuracy and next-month forecast of the SKUs with most units."""
    volumes = monthly.groupBy("SKU").agg(F.sum("Quantity").alias("q"))
    best = top_by(volumes, top_n, "q", "SKU").select("SKU")
    table = monthly_training_table(monthly.join(best, "SKU", "left_semi"), post_restart_year)
    model = train_monthly_model(table, trees)
    metrics = accuracy_metrics(model_test_rows(model, table)).drop("predictions")
    following = score_next_month(model, table, post_restart_year).withColumnRenamed("sku", "SKU")
    return metrics.join(following.drop("confidence"), "SKU", "left")


def regression_quality(tested: DataFrame) -> dict[str, float]:
    """MAE, RMSE and R² of tested rows."""
    scored = tested.select(F.col("actual").alias("label"), F.col("predicted").alias("prediction"))
    return {m: RegressionEvaluator(metricName=m).evaluate(scored) for m in ("mae", "rmse", "r2")}


# -- rolling origin -----------------------------------------------------------------

ORIGIN_INPUTS = ["lag_1", "lag_2", "lag_3", "lag_12", "mean_3", "mean_6", "level", "season",
                 "Month_Sin", "Month_Cos", "months_before"]


def origin_table(monthly: DataFrame) -> DataFrame:
    """Per SKU and month what was known before the month began, and the month's units.

    Every input looks at earlier rows of the SKU only, so one table serves all origins: a model
    for a cutoff trains on the rows before it, and no row knows more than its own past."""
    by_month = Window.partitionBy("SKU").orderBy("Date")
    past = by_month.rowsBetween(Window.unboundedPreceding, -1)
    same_month = Window.partitionBy("SKU", "Month").orderBy("Date").rowsBetween(
        Window.unboundedPreceding, -1)

    def mean_of_last(n: int) -> Column:
        return F.avg("Quantity").over(by_month.rowsBetween(-n, -1))

    level = F.avg("Quantity").over(past)
    known = monthly.select("SKU", "Date", "Month", F.col("Quantity").cast("double").alias("actual"),
                           F.col("Quantity").cast("double").alias("Quantity")).withColumns({
        **{f"lag_{k}": F.lag("Quantity", k).over(by_month) for k in (1, 2, 3, 12)},
        "mean_3": mean_of_last(3), "mean_6": mean_of_last(6), "level": level,
        "season": F.avg("Quantity").over(same_month),
        "months_before": F.count("*").over(past).cast("double"),
        "Month_Sin": month_sin(), "Month_Cos": month_cos()})
    filled = {c: F.coalesce(F.col(c), F.col("level")) for c in ORIGIN_INPUTS if c.startswith("lag")}
    return (known.where("months_before > 0").withColumns(filled)
            .withColumn("season", F.coalesce("season", "level"))
            .withColumn("label", F.col("actual")).drop("Quantity"))


def origins(table: DataFrame, last: int = 6, last_sale: date | None = None) -> list[date]:
    """The last months of the table, each of which becomes a cutoff; with ``last_sale`` only
    months that were over by that day, as a month's first days say little about its units."""
    months = table.select("Date").distinct()
    if last_sale:
        months = months.where(F.add_months("Date", 1) <= F.lit(last_sale + timedelta(days=1)))
    return sorted(r["Date"] for r in months.orderBy(F.desc("Date")).limit(last).collect())


def rolling_origin(table: DataFrame, cutoffs: Sequence, trees: int = 40, depth: int = 8,
                   min_leaf: int = 5, fit: Callable | None = None) -> DataFrame:
    """``cutoff, SKU, actual, predicted, average, previous``: each cutoff's month as forecast by a
    model that was fitted to the months before it, next to the mean of the three months before.

    ``table`` is read once for each cutoff; write it first. ``fit`` takes the training rows and
    gives a model with ``raw_prediction``; a forest by default."""
    def fitted(train: DataFrame) -> PipelineModel:
        return _fit(_pipeline(ORIGIN_INPUTS, forest(trees, depth, min_leaf, "onethird")), train,
                    ORIGIN_INPUTS)

    found = None
    for cutoff in cutoffs:
        before = F.col("Date") < F.lit(cutoff)
        model = (fit or fitted)(table.where(before))
        month = _score(model, table.where(F.col("Date") == F.lit(cutoff))).select(
            F.lit(cutoff).alias("cutoff"), "SKU", "actual", "predicted",
            F.col("mean_3").alias("average"), F.col("lag_1").alias("previous"))
        found = month if found is None else found.unionByName(month)
    return found


def origin_metrics(tested: DataFrame) -> DataFrame:
    """Errors of model and moving average per cutoff and over all (``cutoff`` null)."""
    whole = tested.withColumn("cutoff", F.lit(None).cast("date"))
    rows = tested.unionByName(whole)
    model = backtest_metrics(rows, ["cutoff"])
    plain = backtest_metrics(rows.withColumn("predicted", F.col("average")), ["cutoff"])
    plain = plain.select(*[F.col(c).alias(f"average_{c}") for c in plain.columns])
    same = model["cutoff"].eqNullSafe(plain["average_cutoff"])
    return model.join(plain, same).drop("average_cutoff", "average_tests")


# -- ensemble ---------------------------------------------------------------------

# Weights of the three models.
ENSEMBLE = {"linear": 0.3, "forest": 0.4, "boosting": 0.3}


def ensemble_forecast(table: DataFrame, columns: Sequence[str] | None = None,
                      trees: int = 100, rounds: int = 20) -> DataFrame:
    """Weighted mean of a linear model, a forest and boosted trees on the test months."""
    used = [*columns, LEVEL] if columns else model_inputs(table)
    inputs = VectorAssembler(inputCols=used, outputCol="features")
    models = {
        "linear": LinearRegression(featuresCol="features", labelCol="label", regParam=0.1),
        "forest": forest(trees, 10, 2, "sqrt"),
        "boosting": GBTRegressor(featuresCol="features", labelCol="label", maxIter=rounds,
                                 maxDepth=4, seed=SEED)}
    scored = inputs.transform(table.where("is_test"))
    with _spread(table.where("is_train"), used) as kept:
        train = inputs.transform(kept).select("features", "label")
        for name, model in models.items():
            fitted = model.setPredictionCol(name).fit(train)
            scored = fitted.transform(scored)
    blend = sum((F.col(name) * weight for name, weight in list(ENSEMBLE.items())[1:]),
                F.col("linear") * ENSEMBLE["linear"])
    return scored.select(
        "SKU", "Date", F.col("Quantity").cast("double").alias("actual"),
        F.greatest(blend, F.lit(0.0)).alias("predicted"), "linear", "forest", "boosting")


# -- registry ---------------------------------------------------------------------

REGISTRY = ("sku STRING, model_type STRING, training_date TIMESTAMP, model_path STRING, "
            "version STRING")


def save_model(spark: SparkSession, model: PipelineModel, skus: DataFrame, root: str,
               model_type: str, trained_at: str) -> str:
    """Writes a model and a registry entry for every SKU it serves; returns the model's path.

    Every model has a folder of its own, and its entries are appended last: after a
    failure in between the registry still names whole models only.
    """
    version = uuid.uuid4().hex
    path = f"{root.rstrip('/')}/{model_type}_model/{version}"
    model.write().save(path)
    entries = skus.select(
        F.col("SKU").alias("sku"), F.lit(trained_at).cast("timestamp").alias("training_date"),
        F.lit(path).alias("model_path"), F.lit(version).alias("version"))
    entries.write.mode("append").parquet(
        f"{root.rstrip('/')}/registry/model_type={model_type}")
    return path


def load_registry(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/registry")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# The states that callers compare.
STATUS = {"none": "No model found", "stale": "Needs retraining", "fresh": "Up to date"}


def needs_retraining(skus: DataFrame, registry: DataFrame, last_sales: DataFrame, as_of: str,
                     max_age: int = 30, refresh_age: int = 7) -> DataFrame:
    """Whether each SKU's model is missing, too old, or older than new data allows."""
    trained = registry.groupBy("sku").agg(F.max("training_date").alias("last_trained"))
    joined = (skus.select(F.col("SKU").alias("sku")).join(trained, "sku", "left")
              .join(last_sales.select(F.col("SKU").alias("sku"), "last_sale"), "sku", "left"))
    age = F.date_diff(F.lit(as_of).cast("date"), F.to_date("last_trained"))
    fresh = F.coalesce(F.col("last_sale") > F.to_date("last_trained"), F.lit(False))
    stale = (age > max_age) | ((age > refresh_age) & fresh)
    exists = F.col("last_trained").isNotNull()
    needs = F.when(exists, stale).otherwise(True)
    return joined.select(
        "sku", exists.alias("exists"), needs.alias("needs_training"), "last_trained",
        F.when(~exists, STATUS["none"]).when(needs, STATUS["stale"])
        .otherwise(STATUS["fresh"]).alias("status"))


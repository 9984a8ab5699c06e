"""Registered queries: each runs one operator over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions.calendar import month_key
from tillcast.functions.frames import bundle
from tillcast.operators import (channels, features, forecast, ml, planning, quality, replenish,
                                returns, sales, sketches)
from tillcast.plans.pipeline import AS_OF, OrderingChain, run_pipeline
from tillcast.session import scratch_path, state_on_disk
from tillcast.sources import loads, patterns, readers, sinks, versions
from tillcast.sources.tables import CHANNELS, POST_RESTART_YEAR, RESTART_YEAR, RetailTables
from tillcast.streaming import ingest, jobs, stock

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[RetailTables], DataFrame]) -> Callable[[RetailTables], DataFrame]:
    """Registers a query under the function's name."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(RetailTables(spark, folder))

    QUERIES[build.__name__] = run
    return build


def _staged(t: RetailTables) -> OrderingChain:
    """The chain with its stages written, for reports that use several of them."""
    return OrderingChain(t).staged(scratch_path(t.spark, "stages"))


def _stored(t: RetailTables, frame: DataFrame, label: str) -> DataFrame:
    """The frame written once, for models that read it for training, test and forecast."""
    path = scratch_path(t.spark, label)
    frame.write.parquet(path)
    return t.spark.read.parquet(path)


def _text_godowns(frame: DataFrame) -> DataFrame:
    """Godown arrays as text, so that results compare as plain values."""
    return frame.withColumn("godown_distribution", F.array_join(F.transform(
        "godown_distribution", lambda g: F.concat(
            g["godown"], F.lit("("), g["quantity"].cast("string"), F.lit(")"))), "; "))


# -- sources, sinks, ingest ---------------------------------------------------------


@query
def sales_scan(t: RetailTables) -> DataFrame:
    return readers.with_period_labels(t.sales("Date", "SKU", "Quantity", "Amount"))


@query
def sales_csv_scan(t: RetailTables) -> DataFrame:
    """Sales written as CSV with other columns and another order, read back by header name."""
    path = scratch_path(t.spark, "sales-csv") + "/sales.csv"
    sold = t.sales("Date", "SKU", "Quantity", "Amount", "Godown", "Orderid")
    sold.select("Orderid", "Quantity", F.lit("x").alias("Note"), F.col("Date").alias(" Date"), "Godown",
                "SKU", "Amount").write.option("header", True).csv(path)
    return readers.read_sales(t.spark, path).groupBy(month_key("Date").alias("month")).agg(
        F.count("*").alias("rows"), F.sum("Quantity").alias("quantity"),
        F.count_distinct("SKU").alias("skus"), F.count("Orderid").alias("with_order"),
        F.count("Rate").alias("with_rate"))


@query
def sales_mixed_headers(t: RetailTables) -> DataFrame:
    """One folder of CSV files in three layouts: other orders, spellings and extra columns."""
    folder = scratch_path(t.spark, "mixed-csv")
    sold = t.sales("Date", "SKU", "Quantity", "Amount", "Godown", "Orderid")
    layouts = [
        sold.where(F.year("Date") <= 1996).select("Date", "SKU", "Quantity", "Amount", "Godown", "Orderid"),
        sold.where(F.year("Date").between(1997, 1999)).select(
            F.lit("x").alias("Note"), F.col("Amount").alias("amount"), F.col("SKU").alias("sku "),
            F.col("Quantity").alias("Qty"), F.col("Date").alias(" Date"), F.col("Orderid").alias("OrderID")),
        sold.where(F.year("Date") > 1999).select(
            F.col("Orderid").alias("order id"), "Date", F.col("Amount").alias("Amount"), "SKU",
            F.col("Godown").alias("FulfillmentCenterID"), F.col("Quantity").alias("QUANTITY"))]
    for layout in layouts:
        layout.write.mode("append").option("header", True).csv(folder)
    read = readers.read_mixed(t.spark, folder, readers.schemas.SALES, readers.schemas.REQUIRED_SALES, {
        "qty": "Quantity", "order id": "Orderid", "FulfillmentCenterID": "Godown"})
    return read.groupBy(month_key("Date").alias("month")).agg(
        F.count("*").alias("rows"), F.sum("Quantity").alias("quantity"),
        F.count_distinct("SKU").alias("skus"), F.count("Orderid").alias("with_order"),
        F.count("Godown").alias("with_godown"))


def _raw_sales(t: RetailTables) -> DataFrame:
    """Lines as a raw file holds them: padded names, text dates, some unreadable."""
    line = t.table("lineitem")
    day = F.when(F.col("l_tax") == 0, F.lit("n/a")).otherwise(
        F.date_format("l_shipdate", "yyyy-MM-dd"))
    return line.select(day.alias(" Date "), F.col("l_partkey").cast("string").alias("sku"),
                       F.col("l_quantity").cast("long").alias("Quantity "))


@query
def clean_sales(t: RetailTables) -> DataFrame:
    cleaned = readers.clean_sales(_raw_sales(t))
    return cleaned.groupBy(F.year("Date").alias("Year")).agg(
        F.count("*").alias("rows"), F.count_distinct("SKU").alias("skus"),
        F.sum("Quantity").alias("quantity"))


@query
def moq_scan(t: RetailTables) -> DataFrame:
    return OrderingChain(t).moq


@query
def sku_master_scan(t: RetailTables) -> DataFrame:
    return readers.sku_master(t.sku_entries(), "entry")


@query
def first_available(t: RetailTables) -> DataFrame:
    names = ["uploaded_sales", "lineitem", "orders"]
    path, frame = readers.first_available(t.spark, [t.path(n) for n in names])
    source = path.rsplit("/", 1)[1].removesuffix(".parquet")
    return frame.agg(F.lit(source).alias("source"), F.count("*").alias("rows"))


@query
def sales_returns_union(t: RetailTables) -> DataFrame:
    sold = t.sales("Date", "SKU", "Quantity", "Amount", "Rate")
    back = t.returns("Date", "SKU", "Quantity", "Amount").withColumnRenamed("SKU", "sku")
    both = readers.tag_and_union(sold, back)
    return both.groupBy("Type", F.year("Date").alias("Year")).agg(
        F.count("*").alias("rows"), F.count("Rate").alias("priced_rows"),
        F.sum("Quantity").alias("quantity"))


@query
def history_split(t: RetailTables) -> DataFrame:
    kept = readers.history_split(t.sales("Date", "SKU", "Quantity", "Amount"),
                                 "1996-01-01", "1999-10-31")
    path = scratch_path(t.spark, "history")
    sinks.write_history(kept, path)
    return t.spark.read.parquet(path).groupBy("Year", "Quarter", "Month").agg(
        F.count("*").alias("rows"), F.sum("Quantity").alias("quantity"))


@query
def write_results(t: RetailTables) -> DataFrame:
    folder = scratch_path(t.spark, "results")
    paths = sinks.write_results({"complete_sku_analysis": sku_performance(t)}, folder)
    return t.spark.read.parquet(paths["complete_sku_analysis"])


@query
def save_tables(t: RetailTables) -> DataFrame:
    """Three tables replaced below one folder; the catalog stays as it is."""
    saved = versions.save_versions(t.spark, {
        "sales_data": t.sales("Date", "SKU", "Quantity", "Amount"),
        "sku_master": t.sku_master(), "moq_leadtime": t.moq_leadtime()},
        scratch_path(t.spark, "tables"))
    out = None
    for name, table in saved.items():
        one = table.read().agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def versioned_uploads(t: RetailTables) -> DataFrame:
    """Three uploads, one of them sent twice, then a merge of the segments: what each version holds."""
    table = versions.VersionedTable(t.spark, scratch_path(t.spark, "versions"))
    cols = ("Date", "SKU", "Quantity")
    first, second = t.sales(*cols, until="1997-01-01"), t.sales(*cols, since="1997-01-01", until=t.recent_from)
    for upload in (first, second, first, t.recent(*cols)):
        table.append(upload)
    table.compact()
    out = None
    for found in table.history():
        one = table.read(found.number).agg(
            F.lit(found.number).alias("version"), F.lit(len(found.uploads)).alias("uploads"),
            F.count("*").alias("rows"), F.sum("Quantity").alias("quantity"),
            F.count_distinct("SKU").alias("skus"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def dedupe_loads(t: RetailTables) -> DataFrame:
    """Loads that overlap by years, and one that comes twice: every sale is stored once."""
    store = loads.SalesStore(t.spark, scratch_path(t.spark, "loads"))
    parts = t.at_grain("part")

    def raw(since: str | None, until: str | None) -> DataFrame:
        sold = parts.sales("Orderid", "SKU", "Statefrom", "Date", "Quantity", "Amount", since=since,
                           until=until)
        return sold.select(*[F.col(c).cast("string").alias(c) for c in sold.columns])

    for since, until in ((None, "1997-01-01"), ("1996-01-01", "1999-01-01"), (None, "1997-01-01"),
                         ("1998-06-01", None)):
        store.load(raw(since, until))
    return store.sales.read().groupBy(F.year("Date").alias("Year")).agg(
        F.count("*").alias("rows"), F.count_distinct("Orderid").alias("orders"),
        F.count_distinct("SKU").alias("skus"))


@query
def export_schedule_csv(t: RetailTables) -> DataFrame:
    path = scratch_path(t.spark, "schedule-csv")
    schedule = OrderingChain(t).schedule
    sinks.export_schedule_csv(schedule, path)
    return t.spark.read.schema(schedule.schema).option("header", True).csv(path)


@query
def export_comprehensive_csv(t: RetailTables) -> DataFrame:
    path = scratch_path(t.spark, "comprehensive-csv")
    table = OrderingChain(t).comprehensive
    sinks.export_comprehensive_csv(table, path)
    schema = sinks.flatten_comprehensive(table).schema
    return t.spark.read.schema(schema).option("header", True).csv(path)


@query
def report_bundle(t: RetailTables) -> DataFrame:
    """Rows per sheet of both report bundles, read back from the written sheets."""
    chain = _staged(t)
    summary = replenish.urgency_summary(chain.schedule)
    lines = t.recent("SKU", "Godown", "Statefrom", "Quantity", "Amount")
    folder = scratch_path(t.spark, "bundle")
    # The comprehensive table feeds three sheets, so it is computed once and written.
    table = t.spark.read.parquet(sinks.write_results(
        {"comprehensive_table": chain.comprehensive_batch}, folder)["comprehensive_table"])
    sheets = sinks.schedule_bundle(chain.schedule, summary) | sinks.comprehensive_bundle(
        table, sales.godown_summary(lines), sales.sku_godown(lines))
    paths = sinks.write_bundle(sheets, folder)
    out = None
    for name, path in paths.items():
        one = t.spark.read.option("header", True).csv(path).agg(
            F.lit(name).alias("sheet"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def title_case_headers(t: RetailTables) -> DataFrame:
    return sinks.title_case_headers(replenish.urgency_summary(OrderingChain(t).schedule))


@query
def ingest_sales(t: RetailTables) -> DataFrame:
    """Two uploads appended to one table."""
    path = scratch_path(t.spark, "ingest")
    cols = ("Date", "SKU", "Quantity", "Amount")
    counted = (sinks.ingest_sales(t.history(*cols), path)
               + sinks.ingest_sales(t.recent(*cols), path))
    return t.spark.read.parquet(path).agg(
        F.lit(counted).cast("long").alias("records_processed"), F.count("*").alias("stored_rows"),
        F.sum("Quantity").alias("quantity"))


@query
def ingest_sku_master(t: RetailTables) -> DataFrame:
    path = scratch_path(t.spark, "ingest-sku")
    counted = sinks.ingest_sku_master(t.sku_master(), path)
    return t.spark.read.parquet(path).agg(
        F.lit(counted).cast("long").alias("skus_processed"), F.count("*").alias("stored_rows"))


def _patterns(t: RetailTables) -> tuple[DataFrame, DataFrame]:
    monthly = features.monthly_sku_sales(t.history("Date", "SKU", "Quantity", "Amount", "Rate"))
    return forecast.seasonal_patterns(monthly), forecast.yoy_patterns(monthly)


@query
def pattern_cache(t: RetailTables) -> DataFrame:
    cache = sinks.PatternCache(t.spark, scratch_path(t.spark, "patterns"))
    assert not cache.is_valid()
    seasonal, yoy = cache.load_or_build(lambda: _patterns(t))
    assert cache.is_valid()
    return bundle(
        t.spark,
        seasonal.agg(F.count("*").alias("factors"), F.count_distinct("SKU").alias("total_skus")),
        yoy.agg(F.count("*").alias("yoy_skus")))


@query
def pattern_fold(t: RetailTables) -> DataFrame:
    """Patterns from loads that come out of order, one of them twice and one taken back."""
    store = patterns.PatternStore(t.spark, scratch_path(t.spark, "pattern-store"))
    cols = ("Date", "SKU", "Quantity")
    early, late = t.sales(*cols, until="1997-06-15"), t.sales(*cols, since="1997-06-15", until=t.recent_from)
    store.fold(late, "late")
    store.fold(early, "early")
    store.fold(late, "late")
    store.fold(t.recent(*cols), "too new")
    store.compact()
    store.take_back(t.recent(*cols), "too new, back")
    seasonal, yoy = store.patterns()
    return seasonal.join(yoy, "SKU", "left").withColumn("yoy", F.round("yoy", 8))


@query
def data_freshness(t: RetailTables) -> DataFrame:
    found = readers.data_freshness(t.spark, {
        "sales_data": t.path("lineitem"), "orders": t.path("orders"),
        "predictions": t.path("next_month_predictions")})
    return found.select("source", "file_exists", F.col("last_modified").isNotNull().alias("dated"),
                        F.coalesce(F.col("last_updated") >= F.col("last_modified"),
                                   F.col("last_updated").isNotNull()).alias("within_latest"))


# -- projections, filters, scalar functions -------------------------------------------


@query
def calendar_features(t: RetailTables) -> DataFrame:
    days = t.sales("Date", "Quantity").groupBy("Date").agg(F.sum("Quantity").alias("Quantity"))
    labelled = readers.with_period_labels(days).withColumnRenamed("Month", "Period")
    return features.calendar_features(labelled).withColumn(
        "DayName", F.date_format("Date", "EEEE"))


@query
def rename_columns(t: RetailTables) -> DataFrame:
    raw = t.sales("SKU", "Quantity", "Orderid", "Godown").withColumnsRenamed(
        {"SKU": "sku", "Orderid": "orderid", "Godown": "godown"})
    named = readers.rename_columns(raw)
    return named.groupBy("FulfillmentCenterID").agg(
        F.count_distinct("SKU").alias("skus"), F.count_distinct("OrderID").alias("orders"),
        F.sum("Quantity").alias("quantity"))


@query
def with_product_name(t: RetailTables) -> DataFrame:
    # The master lists the SKUs with supplier terms, so both branches occur.
    listed = t.sku_master().join(t.moq_leadtime().select("sku"), "sku", "left_semi")
    sold = t.sales("SKU", "Quantity").groupBy("SKU").agg(F.sum("Quantity").alias("quantity"))
    unknown = sales.with_product_name(sold, listed)
    itself = listed.select(F.col("sku"), F.col("category"))
    named = sales.with_product_name(unknown.withColumnRenamed("product_name", "name"), itself,
                                    default=None)
    return named.withColumn("display", F.concat_ws(" - ", "SKU", "product_name"))


@query
def sku_list(t: RetailTables) -> DataFrame:
    return sales.sku_list(t.sku_master())


@query
def period_filter(t: RetailTables) -> DataFrame:
    def part(label: str, frame: DataFrame) -> DataFrame:
        return frame.agg(F.lit(label).alias("period"), F.count("*").alias("rows"),
                         F.sum("Quantity").alias("quantity"))

    return (part("since", t.sales("Quantity", since=f"{RESTART_YEAR}-01-01"))
            .unionByName(part("before", t.sales("Quantity", until=f"{RESTART_YEAR}-01-01")))
            .unionByName(part("between", t.sales("Quantity", since="1996-01-01",
                                                 until="1998-01-01"))))


@query
def min_rows_guard(t: RetailTables) -> DataFrame:
    daily = features.daily_sku_sales(t.at_grain("part").sales("Date", "SKU", "Quantity",
                                                              "Amount"))
    return features.min_rows_guard(daily, 30, 30).groupBy("SKU").agg(
        F.count("*").alias("days"), F.sum("Rows").alias("rows"))


@query
def cyclic_month(t: RetailTables) -> DataFrame:
    months = t.sales("Date").groupBy(F.month("Date").alias("Month")).agg(
        F.count("*").alias("rows"))
    return features.cyclic_month(months).select(
        "Month", "rows", F.round("Month_Sin", 6).alias("Month_Sin"),
        F.round("Month_Cos", 6).alias("Month_Cos"))


@query
def clean_non_finite(t: RetailTables) -> DataFrame:
    """Growth against a month that may have sold nothing, cleaned of infinities."""
    monthly = features.monthly_sku_sales(t.sales("Date", "SKU", "Quantity", "Amount", "Rate"))
    before = F.coalesce(F.lag("Quantity").over(features._by_day()), F.lit(0)).cast("double")
    raw = monthly.select("SKU", "Date", "Quantity", F.when(
        before == 0, F.lit(float("inf"))).otherwise(
        F.try_divide(F.col("Quantity") - before, before)).alias("growth"))
    return features.clean_non_finite(raw, ["growth"], ["Quantity"])


@query
def clamp(t: RetailTables) -> DataFrame:
    from tillcast.functions.numeric import clamp as bounded
    per_sku = t.sales("SKU", "Quantity", "Amount").groupBy("SKU").agg(
        F.sum("Quantity").alias("q"))
    return per_sku.select("SKU", bounded(F.col("q") / F.lit(100.0), 20.0, 100.0).alias("clamped"))


@query
def data_completeness(t: RetailTables) -> DataFrame:
    # Lines without tax are read as having no date, so that values are missing.
    line = t.table("lineitem")
    seen = line.select(
        F.when(F.col("l_tax") > 0, F.col("l_shipdate").cast("date")).alias("Date"),
        F.col("l_quantity").alias("Quantity"),
        F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("Amount"))
    return quality.data_completeness(seen)


@query
def validate_prediction_input(t: RetailTables) -> DataFrame:
    """One request per SKU and sale day; early days lack their lags, and holidays their date."""
    daily = features.daily_sku_sales(t.sales("Date", "SKU", "Quantity", "Amount"))
    lagged = features.daily_lags(daily, (1, 7, 30))
    requests = lagged.select(
        F.col("SKU").alias("sku"), "Date",
        F.when(F.month("Date") == 12, F.concat(F.lit("Day "), F.dayofmonth("Date")))
        .otherwise(F.date_format("Date", "yyyy-MM-dd")).alias("date_text"),
        *[F.col(f"Quantity_lag_{k}").alias(f"quantity_lag{k}") for k in (1, 7, 30)],
        (F.month("Date") + 1).alias("month"), F.weekday("Date").alias("day_of_week"))
    checked = quality.validate_prediction_input(
        requests.select("sku", F.col("date_text").alias("date"), "quantity_lag1",
                        "quantity_lag7", "quantity_lag30", "month", "day_of_week"))
    return checked.select("sku", F.concat_ws("; ", "errors").alias("errors"), "is_valid") \
        .groupBy("sku", "errors", "is_valid").agg(F.count("*").alias("requests"))


@query
def sku_maturity(t: RetailTables) -> DataFrame:
    # Brands ending in 1 or 2 play the established lines.
    return t.sku_master().select("sku", forecast.sku_maturity(
        "sku", ("#1/", "#2/")).alias("maturity_score"))


# -- sales reports ------------------------------------------------------------------------


@query
def sku_performance(t: RetailTables) -> DataFrame:
    return sales.sku_performance(t.sales("Date", "SKU", "Quantity", "Amount"))


@query
def sku_performance_by_part(t: RetailTables) -> DataFrame:
    return sku_performance(t.at_grain("part"))


@query
def top_skus(t: RetailTables) -> DataFrame:
    return sales.top_skus(sku_performance(t))


@query
def identify_top_skus(t: RetailTables) -> DataFrame:
    return sales.identify_top_skus(t.recent("Date", "SKU", "Quantity", "Amount"))


@query
def monthly_trends(t: RetailTables) -> DataFrame:
    return sales.monthly_trends(t.sales("Date", "SKU", "Quantity", "Amount", "Orderid"))


@query
def dow_revenue(t: RetailTables) -> DataFrame:
    return sales.dow_revenue(t.sales("Date", "Amount"))


@query
def weekly_patterns(t: RetailTables) -> DataFrame:
    return sales.weekly_patterns(t.sales("Date", "Quantity", "Amount"))


@query
def weekly_revenue_stats(t: RetailTables) -> DataFrame:
    return sales.weekly_revenue_stats(t.sales("Date", "Quantity", "Amount"))


@query
def category_counts(t: RetailTables) -> DataFrame:
    return sales.category_counts(t.sku_master())


@query
def exploration_insights(t: RetailTables) -> DataFrame:
    return sales.exploration_insights(t.sales("Date", "SKU", "Quantity", "Amount"),
                                      t.sku_master())


@query
def business_overview(t: RetailTables) -> DataFrame:
    return sales.business_overview(t.sales("Date", "SKU", "Quantity", "Amount"))


@query
def overview_top5(t: RetailTables) -> DataFrame:
    return sales.overview_top5(t.sales("SKU", "Amount"), t.sku_master())


@query
def overview_monthly_trend(t: RetailTables) -> DataFrame:
    return sales.overview_monthly_trend(t.sales("Date", "Quantity", "Amount"))


@query
def godown_summary(t: RetailTables) -> DataFrame:
    return sales.godown_summary(t.sales("SKU", "Godown", "Statefrom", "Quantity", "Amount"))


@query
def sku_godown(t: RetailTables) -> DataFrame:
    return sales.sku_godown(t.sales("SKU", "Godown", "Quantity", "Amount"))


@query
def godown_top5(t: RetailTables) -> DataFrame:
    return sales.godown_top(t.sales("Godown", "Quantity", "Amount"))


@query
def sku_top3_godowns(t: RetailTables) -> DataFrame:
    top = sales.sku_top_godowns(t.sales("SKU", "Godown", "Quantity"))
    return _text_godowns(top.drop("total_quantity"))


@query
def network_counts(t: RetailTables) -> DataFrame:
    return sales.network_counts(t.sales("Godown", "Statefrom", "Stateto"))


@query
def distinct_from_sketches(t: RetailTables) -> DataFrame:
    """Orders and SKUs per month from stored daily sketches, next to the exact counts."""
    store = sketches.DistinctStore(t.spark, scratch_path(t.spark, "sketches"), ["Orderid", "SKU"])
    cols = ("Date", "Orderid", "SKU")
    parts = t.at_grain("part")
    for i, (since, until) in enumerate(((None, "1998-03-15"), ("1998-01-01", "2000-06-01"),
                                        ("2000-06-01", None))):
        store.add(parts.sales(*cols, since=since, until=until), f"load {i}")
    store.compact()
    exact = parts.sales(*cols).groupBy(month_key("Date").alias("period")).agg(
        F.count_distinct("Orderid").alias("orders"), F.count_distinct("SKU").alias("skus"))
    allowed = 4 * sketches.standard_error()
    near = [(F.abs(F.col(est) - F.col(n)) <= F.ceil(F.col(n) * allowed)).alias(f"{n}_near")
            for est, n in (("Orderid", "orders"), ("SKU", "exact_skus"))]
    exact = exact.withColumnRenamed("skus", "exact_skus")
    return exact.join(store.monthly(), "period").select("period", "orders", "exact_skus", *near)


@query
def historical_monthly(t: RetailTables) -> DataFrame:
    return sales.historical_monthly(t.history("Date", "Quantity", "Amount"),
                                    t.recent("Date", "Quantity", "Amount"))


@query
def historical_span(t: RetailTables) -> DataFrame:
    return sales.historical_span(t.history("Date"), t.recent("Date"))


@query
def seasonal_month_means(t: RetailTables) -> DataFrame:
    return sales.seasonal_month_means(t.history("Date", "Quantity", "Amount"))


@query
def yoy_growth(t: RetailTables) -> DataFrame:
    return sales.yoy_growth(t.sales("Date", "Amount"))


@query
def channel_summary(t: RetailTables) -> DataFrame:
    return channels.channel_summary(t.sales("Partyname", "Quantity", "Amount"))


@query
def channel_yearly_pivot(t: RetailTables) -> DataFrame:
    return channels.channel_yearly_pivot(t.sales("Date", "Partyname", "Quantity", "Amount"),
                                         CHANNELS)


@query
def channel_monthly_pivot(t: RetailTables) -> DataFrame:
    return channels.channel_monthly_pivot(t.sales("Date", "Partyname", "Quantity", "Amount"),
                                          (2000, 2001), CHANNELS)


@query
def channel_yearly_share(t: RetailTables) -> DataFrame:
    return channels.channel_yearly_share(t.sales("Date", "Partyname", "Amount"), CHANNELS)


@query
def analysis_overview(t: RetailTables) -> DataFrame:
    return channels.analysis_overview(t.sales("Date", "SKU", "Quantity", "Amount"))


@query
def daily_volatility(t: RetailTables) -> DataFrame:
    return channels.daily_volatility(t.sales("Date", "Quantity"))


@query
def top_skus_by_quantity(t: RetailTables) -> DataFrame:
    return channels.top_skus_by_quantity(t.sales("SKU", "Quantity"), t.sku_master())


@query
def top_states_by_revenue(t: RetailTables) -> DataFrame:
    return channels.top_states_by_revenue(t.sales("Stateto", "Amount"))


@query
def temporal_extremes(t: RetailTables) -> DataFrame:
    return channels.temporal_extremes(t.sales("Date", "Quantity"))


@query
def sales_trend(t: RetailTables) -> DataFrame:
    return channels.sales_trend_monthly(t.sales("Date", "Quantity"))


@query
def sales_trend_daily(t: RetailTables) -> DataFrame:
    return channels.sales_trend_daily(t.sales("Date", "Quantity"))


@query
def state_channel_distribution(t: RetailTables) -> DataFrame:
    return channels.state_channel_distribution(t.sales("Stateto", "Partyname", "Quantity"),
                                               CHANNELS, CHANNELS)


@query
def state_channel_summary(t: RetailTables) -> DataFrame:
    every = channels.state_channel_distribution(t.sales("Stateto", "Partyname", "Quantity"),
                                                CHANNELS, CHANNELS, n=None)
    return channels.state_channel_summary(every, CHANNELS)


@query
def bi_month_extremes(t: RetailTables) -> DataFrame:
    return channels.bi_month_extremes(t.sales("Date", "Quantity"))


@query
def bi_sku_performance(t: RetailTables) -> DataFrame:
    return channels.bi_sku_performance(t.sales("SKU", "Quantity", "Amount"))


@query
def bi_state_performance(t: RetailTables) -> DataFrame:
    return channels.bi_state_performance(t.sales("Stateto", "Quantity", "Amount"))


def _kpi_cells(t: RetailTables) -> DataFrame:
    return _stored(t, channels.kpi_cells(t.sales("Date", "SKU", "Stateto", "Quantity", "Amount")), "kpi-cells")


@query
def bi_concentration(t: RetailTables) -> DataFrame:
    return channels.bi_concentration(_kpi_cells(t))


@query
def bi_row_means(t: RetailTables) -> DataFrame:
    return channels.bi_row_means(t.sales("Date", "Quantity"))


@query
def price_stats(t: RetailTables) -> DataFrame:
    return channels.price_stats(t.sales("Rate", "Quantity"))


@query
def kpi_report(t: RetailTables) -> DataFrame:
    return channels.kpi_report(_kpi_cells(t))


# -- windows and features -----------------------------------------------------------------


def _daily(t: RetailTables) -> DataFrame:
    return features.daily_sku_sales(t.sales("Date", "SKU", "Quantity", "Amount"))


def _daily_recent(t: RetailTables) -> DataFrame:
    return features.daily_sku_sales(t.recent("Date", "SKU", "Quantity", "Amount"))


@query
def daily_sku_sales(t: RetailTables) -> DataFrame:
    return features.daily_sku_sales(t.sales("Date", "SKU", "Quantity", "Amount"))


@query
def daily_lags(t: RetailTables) -> DataFrame:
    return features.daily_lags(_daily(t)).drop("Rows", "Counted")


def _rounded(frame: DataFrame, digits: int, *prefixes: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in frame.columns
                              if c.startswith(prefixes)})


@query
def daily_rolling_means(t: RetailTables) -> DataFrame:
    rolled = features.daily_rolling_means(_daily(t)).drop("Rows", "Counted")
    return _rounded(rolled, 6, "Quantity_rolling", "Amount_rolling")


@query
def daily_trend_slope(t: RetailTables) -> DataFrame:
    sloped = features.daily_trend_slope(_daily(t)).drop("Rows", "Counted")
    return _rounded(sloped, 6, "Quantity_trend")


@query
def daily_features(t: RetailTables) -> DataFrame:
    built = features.daily_features(_daily(t))
    return _rounded(built, 6, "Quantity_rolling", "Amount_rolling", "Quantity_trend")


def _monthly(t: RetailTables) -> DataFrame:
    return features.monthly_sku_sales(t.sales("Date", "SKU", "Quantity", "Amount", "Rate"))


@query
def monthly_sku_sales(t: RetailTables) -> DataFrame:
    return _monthly(t)


@query
def monthly_features(t: RetailTables) -> DataFrame:
    built = features.monthly_features(_monthly(t), post_restart_year=POST_RESTART_YEAR)
    return _rounded(built.drop("Rate"), 6, "MA_", "YoY", "Month_")


@query
def monthly_features_short(t: RetailTables) -> DataFrame:
    """Part-level SKUs of the recent period: short histories of every length."""
    recent = t.at_grain("part").recent("Date", "SKU", "Quantity", "Amount", "Rate")
    built = features.monthly_features(features.monthly_sku_sales(recent),
                                      post_restart_year=POST_RESTART_YEAR)
    return _rounded(built.drop("Rate"), 6, "MA_", "YoY", "Month_")


@query
def restart_features(t: RetailTables) -> DataFrame:
    seasonal, yoy = _patterns(t)
    built = features.restart_features(_monthly(t), seasonal, yoy, RESTART_YEAR)
    return _rounded(built.drop("Rate"), 6, "MA_", "Month_", "Historical")


@query
def pct_change(t: RetailTables) -> DataFrame:
    return features.pct_change(_monthly(t), "Quantity", 3).drop("Rate")


@query
def last_n_rows(t: RetailTables) -> DataFrame:
    return features.last_n_rows(_daily(t))


@query
def share_of_total(t: RetailTables) -> DataFrame:
    per_sku = t.sales("SKU", "Quantity").groupBy("SKU").agg(F.sum("Quantity").alias("quantity"))
    return sales.share_of_total(per_sku, "quantity")


# -- forecasts --------------------------------------------------------------------------------


@query
def predict_next_month(t: RetailTables) -> DataFrame:
    return OrderingChain(t, top_n=15).predictions


@query
def predict_next_month_all(t: RetailTables) -> DataFrame:
    return OrderingChain(t).predictions


@query
def seasonal_multiplier(t: RetailTables) -> DataFrame:
    return forecast.seasonal_multiplier(_daily_recent(t))


@query
def confidence_score(t: RetailTables) -> DataFrame:
    profile = forecast.demand_profile(_daily_recent(t))
    scored = forecast.confidence_score(profile, forecast.history_counts(t.history("SKU")))
    return scored.select("SKU", "sale_days", "confidence_score", "confidence")


@query
def confidence_score_by_part(t: RetailTables) -> DataFrame:
    return confidence_score(t.at_grain("part"))


@query
def enhanced_confidence(t: RetailTables) -> DataFrame:
    scored = forecast.enhanced_confidence(OrderingChain(t).predictions, ("#1/", "#2/"))
    return scored.select("SKU", "confidence_score", "confidence")


@query
def confidence_distribution(t: RetailTables) -> DataFrame:
    return forecast.confidence_distribution(OrderingChain(t).predictions)


@query
def prediction_report(t: RetailTables) -> DataFrame:
    return forecast.prediction_report(OrderingChain(t).predictions.drop("growth_rate"))


@query
def prediction_top10(t: RetailTables) -> DataFrame:
    return forecast.prediction_top10(OrderingChain(t).predictions)


@query
def prediction_comparison(t: RetailTables) -> DataFrame:
    return forecast.comparison_top(_comparison(t))


def _comparison(t: RetailTables) -> DataFrame:
    return forecast.prediction_comparison(OrderingChain(t).predictions,
                                          t.recent("SKU", "Quantity"), t.sku_master())


@query
def prediction_comparison_summary(t: RetailTables) -> DataFrame:
    return forecast.comparison_summary(_comparison(t))


@query
def seasonal_patterns(t: RetailTables) -> DataFrame:
    return _patterns(t)[0]


@query
def yoy_patterns(t: RetailTables) -> DataFrame:
    return _patterns(t)[1].withColumn("yoy", F.round("yoy", 8))


@query
def pattern_lookup(t: RetailTables) -> DataFrame:
    seasonal, yoy = _patterns(t.at_grain("part"))
    asked = t.at_grain("part").recent("SKU", "Date").select(
        "SKU", F.month("Date").alias("month")).distinct()
    return forecast.pattern_lookup(asked, seasonal, yoy).withColumn(
        "yoy_growth", F.round("yoy_growth", 8))


@query
def simple_monthly_predict(t: RetailTables) -> DataFrame:
    # Brand names are asked for as well: no part is sold under them, so they are discontinued.
    parts = t.at_grain("part")
    asked = parts.sku_master().select("sku").unionByName(
        t.at_grain("brand").sku_master().select("sku"))
    return forecast.simple_monthly_predict(asked, parts.sales("Date", "SKU", "Quantity"))


@query
def top5_monthly_predict(t: RetailTables) -> DataFrame:
    return forecast.top5_monthly_predict(t.sales("Date", "SKU", "Quantity"))


def _channel_forecast(t: RetailTables, n: int | None = 20) -> DataFrame:
    return forecast.channel_predict(t.sales("Date", "SKU", "Partyname", "Stateto", "Quantity"),
                                    CHANNELS, n)


@query
def channel_predict(t: RetailTables) -> DataFrame:
    return _channel_forecast(t).withColumn("top_states", F.array_join(F.transform(
        "top_states", lambda s: F.concat(s["state"], F.lit("("), s["quantity"].cast("string"),
                                         F.lit(","), s["percentage"].cast("string"),
                                         F.lit(")"))), "; "))


@query
def channel_predict_summary(t: RetailTables) -> DataFrame:
    return forecast.channel_predict_summary(_channel_forecast(t, n=None))


def _moving_average_test(t: RetailTables) -> DataFrame:
    """Three-month mean as the forecast of each SKU's last fifth of months."""
    marked = forecast.holdout_tail(_monthly(t).select("SKU", "Date", "Quantity"))
    return forecast.backtest(marked, None, growth=0.0, keep=["is_test"]).where("is_test")


@query
def accuracy_metrics(t: RetailTables) -> DataFrame:
    metrics = forecast.accuracy_metrics(_moving_average_test(t))
    shown = F.array_join(F.transform("predictions", lambda p: F.concat(
        F.date_format(p["Date"], "yyyy-MM"), F.lit("="),
        p["actual"].cast("long").cast("string"))), "; ")
    return _rounded(metrics.withColumn("predictions", shown), 6, "mae", "mape", "avg_")


@query
def accuracy_report(t: RetailTables) -> DataFrame:
    report = forecast.accuracy_report(forecast.accuracy_metrics(_moving_average_test(t)))
    return _rounded(report, 4, "overall", "safety", "variation")


@query
def holdout_split(t: RetailTables) -> DataFrame:
    parts = t.at_grain("part")
    monthly = features.monthly_sku_sales(parts.sales("Date", "SKU", "Quantity", "Amount", "Rate"))
    return forecast.holdout_tail(monthly.select("SKU", "Date"))


# -- Spark ML ---------------------------------------------------------------------------------


def _daily_model_input(t: RetailTables) -> DataFrame:
    best = sales.identify_top_skus(t.recent("Date", "SKU", "Quantity", "Amount")).select("SKU")
    return features.daily_features(_daily_recent(t).join(best, "SKU", "left_semi"))


@query
def train_daily_model(t: RetailTables) -> DataFrame:
    """Held-back rows of the daily model and whether its two errors can be used."""
    rows = _stored(t, _daily_model_input(t), "daily-table")
    tested = ml.daily_model_metrics(ml.train_daily_model(rows), rows)
    return tested.select("validation_rows", _usable("mape").alias("mape_usable"),
                         (_usable("rmse") & (F.col("rmse") < F.col("spread"))).alias("beats_constant"),
                         (F.col("passes") == (F.col("mape") <= 12)).alias("gate_holds"))


def _usable(value: str) -> Column:
    """Whether a model's number is there, finite and not negative."""
    return F.coalesce((F.col(value) >= 0) & (F.col(value) < float("inf")), F.lit(False))


def _tested_rows(t: RetailTables, tested: DataFrame) -> DataFrame:
    """Test rows with what can be checked of their predictions without the model: that each is
    usable, and that together they miss by less than the best constant would, which a model that
    has learnt nothing does not."""
    stored = _stored(t, tested, "tested")
    return stored.select("SKU", "Date", "actual", _usable("predicted").alias("usable"),
                         _beats_constant(stored, "predicted").alias("beats_constant"))


def _beats_constant(tested: DataFrame, predicted: str) -> Column:
    error = F.col(predicted) - F.col("actual")
    return tested.agg(
        (F.sum(error * error) < F.var_pop("actual") * F.count("*") * 0.999).alias("b")).scalar()


def _plausible(scored: DataFrame, table: DataFrame, predicted: str, factor: Column | float = 1.0) -> DataFrame:
    """Adds whether a SKU's forecast lies between a tenth and ten times its mean training month,
    times ``factor``."""
    levels = table.groupBy(F.col("SKU").alias("_sku")).agg(F.max(ml.LEVEL).alias("_level"))
    usual = F.col("_level") * factor
    return scored.join(levels, F.col("sku") == F.col("_sku")).withColumn(
        "plausible", _usable(predicted) & F.col(predicted).between(usual / 10, usual * 10))


def _monthly_table(t: RetailTables) -> DataFrame:
    return _stored(t, ml.monthly_training_table(_monthly(t), POST_RESTART_YEAR), "monthly-table")


def _restart_table(t: RetailTables) -> DataFrame:
    seasonal, yoy = _patterns(t)
    return _stored(t, ml.restart_training_table(_monthly(t), seasonal, yoy, RESTART_YEAR), "restart-table")


@query
def train_monthly_model(t: RetailTables) -> DataFrame:
    table = _monthly_table(t)
    return _tested_rows(t, ml.model_test_rows(ml.train_monthly_model(table), table))


@query
def train_restart_model(t: RetailTables) -> DataFrame:
    table = _restart_table(t)
    return _tested_rows(t, ml.model_test_rows(ml.train_restart_model(table), table))


@query
def score_next_month(t: RetailTables) -> DataFrame:
    seasonal, yoy = _patterns(t)
    table = _restart_table(t)
    scored = ml.score_next_month_seasonal(ml.train_restart_model(table), table, seasonal, yoy)
    return _plausible(scored, table, "predicted_quantity", F.col("seasonal_adjustment")).select(
        "sku", "next_month", "confidence", "has_historical_patterns",
        F.round("seasonal_adjustment", 6).alias("seasonal_adjustment"), "plausible")


@query
def score_next_month_monthly(t: RetailTables) -> DataFrame:
    """The same from the monthly model over the whole history."""
    table = _monthly_table(t)
    scored = ml.score_next_month(ml.train_monthly_model(table), table, POST_RESTART_YEAR)
    return _plausible(scored, table, "predicted_quantity").select(
        "sku", "next_month", "confidence", "plausible")


@query
def monthly_model_accuracy(t: RetailTables) -> DataFrame:
    table = _monthly_table(t)
    tested = ml.model_test_rows(ml.train_monthly_model(table), table)
    metrics = forecast.accuracy_metrics(tested)
    return metrics.select("SKU", "test_months",
                          F.round("avg_monthly_demand", 6).alias("avg_monthly_demand"),
                          (_usable("mae") & _usable("mape") & (F.col("mape") <= 200)).alias("usable"))


@query
def analyze_top_skus_monthly(t: RetailTables) -> DataFrame:
    found = ml.analyze_top_skus_monthly(_monthly(t), post_restart_year=POST_RESTART_YEAR)
    return found.select("SKU", "test_months",
                        F.round("avg_monthly_demand", 6).alias("avg_monthly_demand"), "next_month",
                        (_usable("mae") & _usable("predicted_quantity")).alias("usable"),
                        F.col("predicted_quantity").between(
                            F.col("avg_monthly_demand") / 10, F.col("avg_monthly_demand") * 10)
                        .alias("plausible"))


@query
def ensemble_forecast(t: RetailTables) -> DataFrame:
    found = _stored(t, ml.ensemble_forecast(_monthly_table(t)), "ensemble")
    blend = sum(F.col(name) * weight for name, weight in ml.ENSEMBLE.items())

    def missed(name: str) -> Column:
        return F.sum((F.col(name) - F.col("actual")) ** 2)

    worst = F.greatest(*[missed(name) for name in ml.ENSEMBLE])
    return found.select(
        "SKU", "Date", "actual", _usable("predicted").alias("usable"),
        _beats_constant(found, "predicted").alias("beats_constant"),
        (F.abs(F.greatest(blend, F.lit(0.0)) - F.col("predicted")) < 1e-6).alias("is_blend"),
        found.agg((missed("predicted") <= worst).alias("b")).scalar().alias("beats_worst"))


@query
def model_registry(t: RetailTables) -> DataFrame:
    root = scratch_path(t.spark, "models")
    table = _restart_table(t)
    model = ml.train_restart_model(table, trees=20)
    skus = table.select("SKU").distinct()
    path = ml.save_model(t.spark, model, skus, root, "monthly", AS_OF)
    loaded = ml.load_model(path)
    known = ml.load_registry(t.spark, root)
    scored = ml.model_test_rows(loaded, table).groupBy("SKU").agg(
        F.avg("predicted").alias("mean_predicted")).withColumnRenamed("SKU", "_scored")
    both = known.join(scored, F.col("sku") == F.col("_scored"))
    return _plausible(both, table, "mean_predicted").select(
        "sku", "model_type", F.col("version").isNotNull().alias("versioned"), "plausible")


@query
def needs_retraining(t: RetailTables) -> DataFrame:
    """Models trained on a day fixed by the SKU, checked against its last sale."""
    sold = t.sales("SKU", "Date").groupBy("SKU").agg(F.max("Date").alias("last_sale"))
    age = (replenish.cover_days(F.col("SKU")) * 4 - 18).cast("int")
    registry = sold.where(age > 0).select(
        F.col("SKU").alias("sku"),
        F.date_sub(F.lit(AS_OF).cast("date"), age).cast("timestamp").alias("training_date"))
    checked = ml.needs_retraining(sold.select("SKU"), registry, sold, AS_OF)
    return checked.withColumn("last_trained", F.to_date("last_trained"))


# -- replenishment ----------------------------------------------------------------------------


@query
def estimate_moq(t: RetailTables) -> DataFrame:
    return replenish.estimate_moq(OrderingChain(t).predictions)


@query
def estimate_inventory(t: RetailTables) -> DataFrame:
    return OrderingChain(t).inventory


@query
def reorder_points(t: RetailTables) -> DataFrame:
    return OrderingChain(t).reorder


@query
def ordering_schedule(t: RetailTables) -> DataFrame:
    return OrderingChain(t).schedule


@query
def ordering_summary(t: RetailTables) -> DataFrame:
    chain = OrderingChain(t)
    return replenish.ordering_summary(chain.reorder, chain.schedule, AS_OF)


@query
def ordering_pipeline(t: RetailTables) -> DataFrame:
    """The whole chain with every stage written and read back."""
    paths = run_pipeline(t, scratch_path(t.spark, "pipeline"))
    return t.spark.read.parquet(paths["ordering_schedule"])


@query
def urgent_orders_top5(t: RetailTables) -> DataFrame:
    return replenish.urgent_orders_top(OrderingChain(t).schedule)


@query
def ordering_by_urgency(t: RetailTables) -> DataFrame:
    schedule = OrderingChain(t).schedule
    return (replenish.ordering_by_urgency(schedule, "CRITICAL")
            .unionByName(replenish.ordering_by_urgency(schedule, "HIGH"))
            .unionByName(replenish.ordering_by_urgency(schedule, "MEDIUM")))


@query
def ordering_counts(t: RetailTables) -> DataFrame:
    return replenish.ordering_counts(OrderingChain(t).schedule)


@query
def urgency_summary(t: RetailTables) -> DataFrame:
    return replenish.urgency_summary(OrderingChain(t).schedule)


@query
def inventory_items(t: RetailTables) -> DataFrame:
    chain = OrderingChain(t)
    return replenish.inventory_items(chain.schedule, chain.sku_master, "CRITICAL").unionByName(
        replenish.inventory_items(chain.schedule, chain.sku_master, "HIGH"))


@query
def inventory_status(t: RetailTables) -> DataFrame:
    return replenish.inventory_status(OrderingChain(t).schedule)


@query
def inventory_health(t: RetailTables) -> DataFrame:
    return replenish.inventory_health(OrderingChain(t).reorder)


@query
def critical_stock(t: RetailTables) -> DataFrame:
    return replenish.critical_stock(OrderingChain(t).reorder)


@query
def comprehensive_ordering_batch(t: RetailTables) -> DataFrame:
    return OrderingChain(t).comprehensive_batch


@query
def comprehensive_ordering_api(t: RetailTables) -> DataFrame:
    return _text_godowns(OrderingChain(t).comprehensive)


@query
def comprehensive_summary(t: RetailTables) -> DataFrame:
    return replenish.comprehensive_summary(OrderingChain(t).comprehensive,
                                           t.recent("Godown", "Statefrom", "Stateto"))


@query
def key_insights(t: RetailTables) -> DataFrame:
    chain = OrderingChain(t)
    return replenish.key_insights(t.recent("Date", "SKU", "Quantity", "Amount"),
                                  chain.schedule, chain.predictions, chain.sku_master)


@query
def actionable_insights(t: RetailTables) -> DataFrame:
    chain = OrderingChain(t)
    return replenish.actionable_insights(t.recent("Date", "Quantity", "Amount"), chain.reorder,
                                         chain.schedule, chain.predictions)


# -- returns ----------------------------------------------------------------------------------


@query
def returns_overview(t: RetailTables) -> DataFrame:
    return returns.returns_overview(t.returns("Quantity", "Amount"))


@query
def returns_by_sku(t: RetailTables) -> DataFrame:
    return returns.returns_by(t.returns("SKU", "Quantity", "Amount"), "SKU")


@query
def returns_by_sku_chart(t: RetailTables) -> DataFrame:
    return returns.returns_chart(t.returns("SKU", "Quantity", "Amount"), "SKU")


@query
def returns_by_state(t: RetailTables) -> DataFrame:
    return returns.returns_by(t.returns("Stateto", "Quantity", "Amount"), "Stateto")


@query
def returns_by_state_chart(t: RetailTables) -> DataFrame:
    return returns.returns_chart(t.returns("Stateto", "Quantity", "Amount"), "Stateto")


@query
def returns_monthly(t: RetailTables) -> DataFrame:
    return returns.returns_monthly(t.returns("Date", "Quantity"))


@query
def returns_trend(t: RetailTables) -> DataFrame:
    return returns.returns_trend_monthly(t.returns("Date", "Quantity"))


@query
def returns_trend_daily(t: RetailTables) -> DataFrame:
    return returns.returns_trend_daily(t.returns("Date", "Quantity"))


@query
def high_return_skus_p80(t: RetailTables) -> DataFrame:
    return returns.high_return_skus(t.at_grain("part").returns("SKU", "Quantity"))


def _sku_sides(t: RetailTables, *extra: str) -> tuple[DataFrame, DataFrame]:
    """Part-level sales and returns: rates differ widely between parts."""
    parts = t.at_grain("part")
    return parts.sales("SKU", "Quantity", *extra), parts.returns("SKU", "Quantity", *extra)


@query
def return_rate_by_sku(t: RetailTables) -> DataFrame:
    return returns.top_return_rates(returns.return_rate_by_sku(*_sku_sides(t)), "sku")


@query
def return_rate_by_sku_all(t: RetailTables) -> DataFrame:
    return returns.return_rate_by_sku(*_sku_sides(t))


@query
def return_rate_totals(t: RetailTables) -> DataFrame:
    return returns.return_rate_totals(*_sku_sides(t, "Amount"))


@query
def return_rate_by_state(t: RetailTables) -> DataFrame:
    return returns.top_return_rates(returns.return_rate_by_state(
        t.sales("Stateto", "Quantity"), t.returns("Stateto", "Quantity")), "state")


@query
def return_rate_monthly(t: RetailTables) -> DataFrame:
    return returns.return_rate_monthly(t.sales("Date", "Quantity"),
                                       t.returns("Date", "Quantity"))


@query
def return_rate_range(t: RetailTables) -> DataFrame:
    return returns.return_rate_range(return_rate_monthly(t))


@query
def return_rate_dow(t: RetailTables) -> DataFrame:
    return returns.return_rate_dow(t.sales("Date", "Quantity"), t.returns("Date", "Quantity"))


@query
def high_risk_returns(t: RetailTables) -> DataFrame:
    return returns.high_risk_skus(*_sku_sides(t))


@query
def high_risk_states(t: RetailTables) -> DataFrame:
    return returns.high_risk_states(t.sales("Stateto", "Quantity"),
                                    t.returns("Stateto", "Quantity"), 40)


@query
def high_risk_impact(t: RetailTables) -> DataFrame:
    parts, cols = t.at_grain("part"), ("SKU", "Stateto", "Quantity", "Amount")
    cells = returns.return_cells(parts.sales(*cols), parts.returns(*cols), "SKU", "Stateto")
    return returns.high_risk_impact(returns.rate_of_cells(cells, "SKU", "sku"),
                                    returns.rate_of_cells(cells, "Stateto", "state"), 50, 40)


@query
def return_risk_tiers(t: RetailTables) -> DataFrame:
    return returns.return_risk_tiers(returns.return_rate_by_sku(*_sku_sides(t)))


# -- streaming --------------------------------------------------------------------------------


def _event_stream(t: RetailTables) -> DataFrame:
    stream = jobs.read_stream(t.spark, f"{t.root}/events.parquet*", t.table("events").schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query
def stream_ingest_sales(t: RetailTables) -> DataFrame:
    out = scratch_path(t.spark, "stream-sales")
    lines = jobs.read_stream(t.spark, f"{t.root}/lineitem.parquet*", t.table("lineitem").schema)
    arriving = lines.select(
        F.col("l_shipdate").cast("date").alias("Date"),
        F.col("l_partkey").cast("string").alias("SKU"),
        F.col("l_quantity").cast("long").alias("Quantity"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("Amount"))
    jobs.ingest_sales(arriving, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    stored = t.spark.read.parquet(f"{out}/data")
    return stored.groupBy(month_key("Date").alias("Month")).agg(
        F.count("*").alias("rows"), F.sum("Quantity").alias("quantity"))


RAW_SALE = ["Date", "SKU", "Quantity", "Amount"]


@query
def stream_ingest_checked(t: RetailTables) -> DataFrame:
    """Arriving text rows, some of them spoiled: stored and rejected rows by reason."""
    out = scratch_path(t.spark, "stream-checked")
    lines = jobs.read_stream(t.spark, f"{t.root}/lineitem.parquet*", t.table("lineitem").schema)
    units = F.col("l_quantity").cast("long").cast("string")
    raw = lines.select(
        F.when(F.col("l_tax") == 0, "n/a").otherwise(
            F.date_format("l_shipdate", "yyyy-MM-dd")).alias("Date"),
        F.concat(F.lit("  "), F.col("l_partkey").cast("string"),
                 F.when(F.col("l_partkey") % 7 == 0, "!").otherwise("")).alias("SKU"),
        F.when(F.col("l_discount") == 0, "many").when(F.col("l_returnflag") == "R", F.concat(
            F.lit("-"), units)).otherwise(units).alias("Quantity"),
        F.when(F.col("l_partkey") % 5 > 0, F.col("l_extendedprice").cast("string")).otherwise(" ")
        .alias("Amount"))
    ingest.ingest_checked(raw, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    sound = ingest.accepted(t.spark, f"{out}/data", RAW_SALE).agg(
        F.lit("").alias("reasons"), F.count("*").alias("rows"), F.sum("Quantity").alias("quantity"))
    turned_away = ingest.rejected(t.spark, f"{out}/data", RAW_SALE).groupBy(
        F.array_join("reasons", ", ").alias("reasons")).agg(
        F.count("raw").alias("rows"), F.lit(None).cast("long").alias("quantity"))
    return sound.unionByName(turned_away)


@query
def closing_stock_stream(t: RetailTables) -> DataFrame:
    """Stock movement from arriving lines: closed days from the stream's state, then the open ones."""
    out = scratch_path(t.spark, "stream-stock")
    lines = jobs.read_stream(t.spark, f"{t.root}/lineitem.parquet*", t.table("lineitem").schema)
    arriving = t.stock_lines(lines).withColumn("at", F.col("Date").cast("timestamp"))
    closed = stock.closing_stock_stream(arriving, "at")
    with state_on_disk(t.spark):
        started = jobs.run_to_table(closed, f"{out}/data", f"{out}/checkpoint")
    started.awaitTermination()
    done = t.spark.read.schema(stock.OUTPUT).parquet(f"{out}/data")
    return stock.with_open_stock(done, t.closing_stock())


@query
def stream_dedupe(t: RetailTables) -> DataFrame:
    """Every event arrives twice; one copy of each is kept."""
    out = scratch_path(t.spark, "stream-dedupe")
    twice = _event_stream(t)
    unique = jobs.dedupe(twice.unionByName(_event_stream(t)), ["event_id"], "ts", "40 days")
    jobs.run_to_table(unique, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{out}/data").groupBy("event_type").agg(
        F.count("*").alias("events"), F.count_distinct("event_id").alias("distinct_events"))


@query
def stream_daily_sales(t: RetailTables) -> DataFrame:
    out = scratch_path(t.spark, "stream-daily")
    units = F.lit(1).cast("long")
    daily = jobs.daily_sales(_event_stream(t).withColumn("units", units), "ts", ["event_type"],
                             "units", "value", "1 hour")
    jobs.run_to_table(daily, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    final = t.spark.read.schema(daily.schema).parquet(f"{out}/data")
    arrived = t.table("events").withColumns({"ts": F.col("ts").cast("timestamp"), "units": units})
    return jobs.with_open_days(final, arrived, "ts", ["event_type"], "units", "value")


# -- planning rules from the requirement documents ------------------------------------------------


@query
def safety_stock_z(t: RetailTables) -> DataFrame:
    return planning.safety_stock_z(forecast.demand_profile(_daily(t)), t.moq_leadtime())


@query
def urgency_by_cover(t: RetailTables) -> DataFrame:
    plan = planning.order_plan(OrderingChain(t).reorder, AS_OF)
    return plan.groupBy("urgency").agg(F.count("*").alias("skus"))


@query
def moq_round_up(t: RetailTables) -> DataFrame:
    return planning.order_plan(OrderingChain(t).reorder, AS_OF).select("sku", "order_quantity")


@query
def order_date(t: RetailTables) -> DataFrame:
    return planning.order_plan(OrderingChain(t).reorder, AS_OF).select("sku", "order_date")


@query
def rolling_stats(t: RetailTables) -> DataFrame:
    return _rounded(features.rolling_stats(_daily(t)).drop("Rows", "Counted", "Amount"), 4,
                    "Quantity_mean", "Quantity_std")


@query
def dedupe_sales(t: RetailTables) -> DataFrame:
    """The table stacked on itself collapses to one row per key."""
    once = t.at_grain("part").sales("Orderid", "SKU", "Statefrom", "Date", "Quantity", "Amount")
    copies = once.withColumn("copy", F.lit(1)).unionByName(once.withColumn("copy", F.lit(2)))
    kept = quality.dedupe_sales(copies, keep_first_by="copy")
    return kept.groupBy(F.year("Date").alias("Year"), "copy").agg(
        F.count("*").alias("rows"), F.count_distinct("Orderid").alias("orders"))


@query
def closing_stock(t: RetailTables) -> DataFrame:
    return planning.closing_stock_latest(t.closing_stock())


@query
def closing_stock_movement(t: RetailTables) -> DataFrame:
    return planning.closing_stock_movement(t.closing_stock())


@query
def resolve_godown(t: RetailTables) -> DataFrame:
    resolved = planning.resolve_godown(t.raw_godown_lines(), t.godown_master())
    return resolved.groupBy("GodownName").agg(F.count("*").alias("rows"),
                                              F.count_distinct("Godown").alias("spellings"),
                                              F.sum("Quantity").alias("quantity"))


def _positions(t: RetailTables) -> DataFrame:
    return planning.location_positions(t.location_days())


@query
def shortfall(t: RetailTables) -> DataFrame:
    return planning.shortfall_of(_positions(t))


@query
def bom_buildable(t: RetailTables) -> DataFrame:
    return planning.bom_buildable(t.bom(), t.raw_material())


@query
def group_moq(t: RetailTables) -> DataFrame:
    """Part types as order groups: a group must order half of what it sells."""
    orders = _group_orders(t)
    minimum = orders.groupBy("group").agg((F.sum("sales") / 2).cast("long").alias("group_moq"))
    return planning.group_moq(orders, minimum)


def _group_orders(t: RetailTables) -> DataFrame:
    sold = t.sales("SKU", "Quantity").groupBy("SKU").agg(F.sum("Quantity").alias("sales"))
    return sold.select(F.element_at(F.split("SKU", "/"), -1).alias("group"),
                       F.col("SKU").alias("sku"),
                       (F.col("sales") % 100).alias("need"), "sales")


@query
def effective_lead_time(t: RetailTables) -> DataFrame:
    size = F.sum("p_size")
    parts = t.table("part").groupBy(F.col("p_brand").alias("sku")).agg(
        (size % 30).cast("int").alias("procurement_days"),
        (F.max("p_size") % 7).cast("int").alias("manufacturing_days"),
        (F.count("*") % 20).cast("int").alias("transfer_days"),
        F.when(size % 2 == 0, F.min("p_size")).cast("int").alias("intake_days"))
    return planning.effective_lead_time(parts)


@query
def forecast_levels(t: RetailTables) -> DataFrame:
    return forecast.forecast_levels(t.sales("Date", "SKU", "Partyname", "Stateto", "Godown",
                                            "Quantity"))


@query
def backtest_metrics(t: RetailTables) -> DataFrame:
    return forecast.backtest_metrics(forecast.backtest(_monthly(t)))


@query
def rolling_backtest(t: RetailTables) -> DataFrame:
    """A model per cutoff next to the moving average; the flags fail for a model that has learnt
    nothing."""
    table = _stored(t, ml.origin_table(_monthly(t)), "origins")
    last_sale = t.sales("Date").agg(F.max("Date")).first()[0]
    errors = ml.origin_metrics(ml.rolling_origin(table, ml.origins(table, last_sale=last_sale)))
    return errors.select(
        "cutoff", "tests", *[c for c in errors.columns if c.startswith("average_")],
        (F.col("mae") <= F.col("average_mae")).alias("mae_below_average"),
        (F.col("rmse") <= F.col("average_rmse")).alias("rmse_below_average"),
        (F.col("r2") >= F.col("average_r2")).alias("r2_above_average"))


@query
def festival_flags(t: RetailTables) -> DataFrame:
    flagged = quality.festival_flags(t.sales("Date", "Quantity"))
    flags = ["is_diwali", "is_big_billion_days", "is_amazon_prime_day"]
    return flagged.groupBy(*flags).agg(F.count("*").alias("rows"),
                                       F.sum("Quantity").alias("quantity"))


@query
def outlier_filter(t: RetailTables) -> DataFrame:
    days = t.sales("Date", "SKU", "Quantity", "Amount")
    kept = quality.outlier_filter(features.daily_sku_sales(days), threshold=3.0)
    return kept.groupBy("SKU").agg(F.count("*").alias("days"),
                                   F.sum("Quantity").alias("quantity"))


@query
def quality_rules(t: RetailTables) -> DataFrame:
    sold = t.sales("Date", "SKU", "Quantity", "Amount")
    returned = t.returns("Date", "SKU", "Quantity", "Amount").withColumn(
        "Amount", F.when(F.dayofmonth("Date") > 1, F.col("Amount")))
    return quality.quality_summary(quality.quality_rules(sold.unionByName(returned)))


@query
def stockout_outlook(t: RetailTables) -> DataFrame:
    return planning.stockout_outlook_of(_positions(t))


def _short_and_own(t: RetailTables) -> tuple[DataFrame, DataFrame]:
    """Whole units short per location, and a tenth of the SKU's sales as own stock."""
    positions = _positions(t)
    rows = planning.shortfall_of(positions).where(F.col("level") == "godown")
    short = rows.select(
        "sku", F.concat_ws("/", "channel", "godown").alias("location"),
        F.ceil("shortfall").cast("long").alias("shortfall"))
    return short, positions.groupBy("sku").agg(
        (F.sum("total_qty") / 10).cast("long").alias("own_qty"))


@query
def stock_transfer(t: RetailTables) -> DataFrame:
    return planning.stock_transfer(*_short_and_own(t))


@query
def stock_transfer_shared(t: RetailTables) -> DataFrame:
    """The same shortfalls served in proportion, in whole units."""
    return planning.stock_transfer_shared(*_short_and_own(t))

"""Report edge cases: zero quantities, single months, ties, missing keys and columns."""

import datetime as dt
import hashlib

import pytest
from retail_help import rows
from pyspark.sql import functions as F

from tillcast.operators import channels, quality, returns, sales
from tillcast.sources import readers, schemas, sinks

SALES = "Date date, SKU string, Quantity long, Amount double"


def _sales(spark, data):
    return spark.createDataFrame(data, SALES)


def test_zero_quantity_gives_null_rate(spark):
    got = rows(sales.sku_performance(_sales(spark, [
        (dt.date(2025, 1, 1), "Z", 1, -5.0), (dt.date(2025, 1, 3), "Z", -1, -5.0),
        (dt.date(2025, 1, 3), None, 9, 9.0)])))
    assert len(got) == 1
    assert got[0]["Revenue_Per_Unit"] is None
    assert (got[0]["Days_Active"], got[0]["Total_Revenue"]) == (3, -10.0)


def test_growth_with_one_month_and_zero_base(spark):
    one = _sales(spark, [(dt.date(2025, 1, 1), "A", 1, 5.0)])
    assert sales.business_overview(one).first().growth_rate == 0.0
    base0 = _sales(spark, [(dt.date(2025, 1, 1), "A", 1, 0.0), (dt.date(2025, 2, 1), "A", 1, 5.0)])
    assert sales.business_overview(base0).first().growth_rate == 0.0
    trends = rows(sales.monthly_trends(base0.selectExpr("*", "SKU AS Orderid")), "Month")
    assert trends[1]["Revenue_Growth"] is None and trends[1]["Quantity_Growth"] == 0.0


def test_ties_are_broken_by_key(spark):
    frame = _sales(spark, [(dt.date(2025, 1, 1), s, 1, 5.0) for s in "CBAD"])
    top = sales.top_skus(sales.sku_performance(frame), 2).collect()
    assert [r.SKU for r in top] == ["A", "B"]


def test_weekday_without_sales_is_listed(spark):
    got = rows(sales.dow_revenue(_sales(spark, [(dt.date(2025, 1, 6), "A", 1, 5.0)])), "weekday")
    assert [r["DayOfWeek"] for r in got][0] == "Monday"
    assert [r["Amount"] for r in got] == [5.0] + [None] * 6


def test_week_label_counts_from_sundays(spark):
    frame = _sales(spark, [(dt.date(2025, 1, d), "A", 1, 1.0) for d in (1, 4, 5, 12)])
    weeks = [r["Week"] for r in rows(readers.with_period_labels(frame), "Date")]
    assert weeks == ["2025-W00", "2025-W00", "2025-W01", "2025-W02"]


def test_money_sum_does_not_depend_on_order(spark):
    data = [(dt.date(2025, 1, 1), "A", 1, 0.1 * (i % 97) + 1e9 * (i % 2)) for i in range(4000)]
    sums = {_sales(spark, data).repartition(n).agg(
        channels.money_sum("Amount").alias("m")).first().m for n in (1, 3, 16)}
    assert len(sums) == 1


def test_channel_without_sales_is_zero(spark):
    frame = spark.createDataFrame([(dt.date(2025, 1, 1), "Amazon Stores", 3, 6.0)],
                                  "Date date, Partyname string, Quantity long, Amount double")
    got = rows(channels.channel_yearly_pivot(frame))[0]
    assert (got["Flipkart Store_revenue"], got["Flipkart Store_quantity"]) == (0.0, 0)
    share = rows(channels.channel_yearly_share(frame))[0]
    assert share["Amazon Stores_percentage"] == 100.0


def test_return_rates_keep_both_sides(spark):
    sold = spark.createDataFrame([("A", 10), ("B", 5), ("Z", 0)], "SKU string, Quantity long")
    back = spark.createDataFrame([("A", -4), ("C", -2), ("Z", -1)], "SKU string, Quantity long")
    got = {r["sku"]: r["return_rate"] for r in rows(returns.return_rate_by_sku(sold, back))}
    assert got == {"A": 40.0, "B": 0.0, "C": 0.0, "Z": 0.0}


def test_returns_without_state_column(spark):
    back = spark.createDataFrame([("A", -4, -9.0)], "SKU string, Quantity long, Amount double")
    assert returns.returns_by(back, "Stateto").count() == 0
    none = back.limit(0)
    assert returns.returns_overview(none).first().avg_return_amount == 0.0


@pytest.mark.parametrize("values", [[7], [3, 3, 3], list(range(100)), [-5, 0, 10 ** 9, 2, 2],
                                    [1.5, 2.25, -8.0, 4.0], [i * 0.37 for i in range(3000)] + [1e15]])
def test_exact_quantile(spark, values):
    import numpy as np

    from tillcast.functions.frames import exact_quantile
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    for q in (0.0, 0.25, 0.8, 1.0):
        for cells in (4, 65536):
            got = exact_quantile(frame, "v", q, cells).first().quantile
            assert got == pytest.approx(np.percentile(values, q * 100))


def test_running_total_over_one_hot_group(spark):
    from tillcast.functions.frames import running_before
    data = [("g", f"k{i:04d}", (i * 7919) % 501) for i in range(2000)]
    frame = spark.createDataFrame(data, "g string, k string, v long")
    got = {r["k"]: r["before"] for r in rows(running_before(frame, "g", "v", "v", "k"))}
    ahead = 0
    digest = lambda k: hashlib.md5(k.encode()).hexdigest()
    for _, key, value in sorted(data, key=lambda r: (-r[2], digest(r[1]), r[1])):
        assert got[key] == ahead
        ahead += value


def test_equal_ranks_are_dealt_out(spark):
    """A group of equal ranks: no sorted part holds more than a small share of it."""
    from tillcast.functions.frames import running_before
    n = 200_000
    frame = spark.range(n).selectExpr("'g' AS g", "CAST(id AS STRING) AS k", "1L AS v")
    got = running_before(frame, "g", "v", "v", "k").agg(
        F.count_distinct("before").alias("distinct"), F.max("before").alias("last")).first()
    assert (got["distinct"], got["last"]) == (n, n - 1)
    parts = frame.groupBy(F.substring(F.md5("k"), 1, 3)).count().agg(F.max("count")).first()[0]
    assert parts < n / 1000


def test_clean_sales(spark):
    raw = spark.createDataFrame([("2025-01-05", "A", "1"), ("bad", "B", "2"), (None, "C", "3")],
                                " Date string, `sku` string, `Quantity ` string")
    raw = raw.toDF(" Date", "sku", "Quantity ")
    cleaned = readers.clean_sales(raw)
    assert cleaned.columns == ["Date", "SKU", "Quantity"]
    assert [r["SKU"] for r in rows(cleaned)] == ["A"]
    day_first = spark.createDataFrame([("31-12-2024 10:30",)], "Date string")
    assert rows(readers.clean_sales(day_first, "dd-MM-yyyy HH:mm"))[0]["Date"] == dt.date(
        2024, 12, 31)


def test_master_last_entry_wins(spark):
    entries = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), (None, "x", 3)],
                                    "sku string, category string, n int")
    assert rows(readers.sku_master(entries, "n")) == [{"sku": "a", "category": "new"}]


def test_uploads_are_checked_and_counted(spark, tmp_path):
    with pytest.raises(sinks.RejectedUpload, match="Amount"):
        sinks.ingest_sales(spark.createDataFrame([(1,)], "SKU int"), str(tmp_path / "s"))
    good = _sales(spark, [(dt.date(2025, 1, 1), "A", 1, 5.0)] * 3)
    path = str(tmp_path / "sales")
    assert sinks.ingest_sales(good, path) == 3
    assert sinks.ingest_sales(good, path) == 3
    assert spark.read.parquet(path).count() == 6


def test_missing_sources(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.first_available(spark, [str(tmp_path / "a.parquet")])
    fresh = {r["source"]: r for r in rows(readers.data_freshness(
        spark, {"none": str(tmp_path / "no"), "there": "/root/testdata/sf0.001/part.parquet"}))}
    assert not fresh["none"]["file_exists"] and fresh["there"]["file_exists"]
    assert fresh["none"]["last_updated"] == fresh["there"]["last_modified"]


def test_csv_round_trip(spark, tmp_path):
    frame = _sales(spark, [(dt.date(2025, 1, 1), "A", 1, 5.0)]).selectExpr(
        "Date", "SKU", "Quantity", "Amount", "5.0D AS Rate", "'p' AS Partyname", "'g' AS Godown",
        "'f' AS Statefrom", "'t' AS Stateto", "'o' AS Orderid")
    paths = sinks.write_results({"sales": frame}, str(tmp_path), "csv")
    back = readers.read_sales(spark, paths["sales"], "csv")
    assert rows(back)[0]["Month"] == "2025-01" and rows(back)[0]["Quantity"] == 1


def test_request_validation(spark):
    requests = spark.createDataFrame(
        [("A", "2025-01-15", 50.0, 45.0, 40.0, 1, 2), ("A", "invalid", None, 1.0, 1.0, 13, 7),
         ("A", "2025-01-15", 1.0, 1.0, 1.0, 0, 0)],
        "sku string, date string, quantity_lag1 double, quantity_lag7 double, "
        "quantity_lag30 double, month int, day_of_week int")
    good, bad, zero = quality.validate_prediction_input(requests).collect()
    assert good.is_valid and good.errors == [] and zero.is_valid
    assert bad.errors == ["Missing required field: quantity_lag1",
                          "Date must be in valid format (YYYY-MM-DD)",
                          "Month must be between 1 and 12",
                          "Day of week must be between 0 and 6"]
    unknown = quality.validate_prediction_input(requests, "weekly").first()
    assert unknown.errors == ["Unknown prediction type: weekly"]
    template = schemas.request_template("monthly_prediction")
    assert len(template.fieldNames()) == 17
    with pytest.raises(ValueError):
        schemas.request_template("weekly")


def test_duplicates_keep_the_first(spark):
    raw = spark.createDataFrame(
        [("o", "s", "f", dt.date(2025, 1, 1), 2, 5), ("o", "s", "f", dt.date(2025, 1, 1), 1, 9),
         ("o", "s", "x", dt.date(2025, 1, 1), 3, 7)],
        "Orderid string, SKU string, Statefrom string, Date date, arrival int, Quantity long")
    got = rows(quality.dedupe_sales(raw, keep_first_by="arrival"), "Statefrom")
    assert [(r["Statefrom"], r["Quantity"]) for r in got] == [("f", 9), ("x", 7)]


def test_views_answer_sql(spark, tables):
    tables.register_views()
    got = spark.sql("SELECT count(*) AS n, count(DISTINCT s.SKU) AS skus FROM sales s "
                    "LEFT JOIN sku_master m ON s.SKU = m.sku WHERE m.category IS NOT NULL").first()
    assert (got.n, got.skus) == (tables.table("lineitem").count(), 25)
    parts = spark.sql("SELECT (SELECT count(*) FROM recent_sales) AS r, "
                      "(SELECT count(*) FROM historical_sales) AS h").first()
    assert parts.r + parts.h == got.n


def test_terms_fall_back_to_the_estimate(spark):
    estimate = spark.createDataFrame([("a", 20, 10, "d", 100.0)], schemas.MOQ_LEADTIME)
    names_only = spark.createDataFrame([("a", "Heater")], "sku string, category string")
    assert rows(readers.moq_or_estimate(names_only, estimate))[0]["moq"] == 20
    assert rows(readers.moq_or_estimate(None, estimate))[0]["moq"] == 20
    own = estimate.selectExpr("sku", "moq + 5 AS moq", "lead_time_days", "supplier", "unit_cost")
    assert rows(readers.moq_or_estimate(own, estimate))[0]["moq"] == 25


def test_one_hot_sku_with_a_third_of_all_rows(spark):
    """Skewed input gives whole results and the same sums as counting by hand."""
    n = 30000
    hot = spark.range(n).selectExpr(
        "date_add(DATE'2025-01-01', CAST(id % 90 AS INT)) AS Date",
        "CASE WHEN id % 3 = 0 THEN 'HOT' ELSE concat('S', CAST(id % 1000 AS STRING)) END AS SKU",
        "id % 7 AS Quantity", "CAST(id % 11 AS DOUBLE) AS Amount",
        "concat('G', CAST(id % 400 AS STRING)) AS Godown")
    per_sku = {r["SKU"]: r for r in rows(sales.sku_performance(hot))}
    assert per_sku["HOT"]["Total_Orders"] == n // 3
    assert sum(r["Total_Quantity"] for r in per_sku.values()) == sum(i % 7 for i in range(n))
    best = {r["SKU"]: r for r in rows(sales.sku_top_godowns(hot))}
    assert len(best["HOT"]["godown_distribution"]) == 3


def test_units_without_a_warehouse_count_in_the_total_only(spark):
    frame = spark.createDataFrame([("A", None, 9), ("A", "x", 1), ("A", "y", 2), ("B", None, 4)],
                                  "SKU string, Godown string, Quantity long")
    got = {r["SKU"]: r for r in rows(sales.sku_top_godowns(frame))}
    assert got["A"]["godown_distribution"] == [{"godown": "y", "quantity": 2},
                                               {"godown": "x", "quantity": 1}]
    assert (got["A"]["total_quantity"], got["B"]["total_quantity"]) == (12, 4)
    assert got["B"]["godown_distribution"] == []


def test_csv_columns_are_found_by_name(spark, tmp_path):
    folder = tmp_path / "sales.csv"
    folder.mkdir()
    (folder / "a.csv").write_text(
        "Orderid, Date ,SKU,Extra,Quantity,Amount,Partyname\n7,2024-05-01,s1,x,3,5.5,A\n8,bad,s2,y,z,1,B\n")
    found = rows(readers.read_sales(spark, str(folder)), "Orderid")
    assert [(r["Orderid"], str(r["Date"]), r["SKU"], r["Quantity"], r["Amount"], r["Rate"], r["Partyname"])
            for r in found] == [("7", "2024-05-01", "s1", 3, 5.5, None, "A"),
                                ("8", "None", "s2", None, 1.0, None, "B")]
    (folder / "a.csv").write_text("Date,SKU,Quantity\n2024-05-01,s1,3\n")
    with pytest.raises(ValueError, match="Amount"):
        readers.read_sales(spark, str(folder))


def test_last_entry_of_the_last_file_wins(spark, tmp_path):
    folder = tmp_path / "master.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("sku,category\nX,old\nY,first\nY,second\n")
    (folder / "b.csv").write_text("sku,category\n" + "P,pad\n" * 5000 + "X,new\n")
    found = {r["sku"]: r["category"] for r in rows(readers.sku_master(
        readers.read_table(spark, str(folder), "sku STRING, category STRING")))}
    assert found == {"X": "new", "Y": "second", "P": "pad"}


def test_one_sided_keys_of_return_rates(spark):
    sold = spark.createDataFrame([("a", 10), ("b", 5)], "SKU string, Quantity long")
    back = spark.createDataFrame([("b", -5), ("c", -2)], "SKU string, Quantity long")
    assert {r["sku"] for r in rows(returns.return_rate_by_sku(sold, back))} == {"a", "b", "c"}


def test_scratch_lies_on_shared_storage(spark):
    from tillcast.session import scratch_path
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second
    assert first.startswith(spark.conf.get("spark.checkpoint.dir"))

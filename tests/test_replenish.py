"""Reorder chain: a checked five-row example and the branches it does not reach."""

import random

from pyspark.sql import functions as F
from retail_help import rows

from tillcast.operators import forecast, planning, replenish

CHAIN = [
    ("CMSM01C", 2617, 87.24925424904615, 482,
     (785, 15, 348, 1656, 5.5, 3444, "High", "CRITICAL")),
    ("LRM03", 601, 20.045791245791243, 162, (240, 12, 80, 320, 8.1, 679, "High", "CRITICAL")),
    ("LRM02", 1406, 46.89234522720342, 469, (421, 15, 187, 890, 10.0, 1641, "High", "CRITICAL")),
    ("JSD-02", 235, 7.864327485380118, 94, (117, 10, 31, 109, 12.0, 220, "Medium", "HIGH")),
    ("CMSM01D", 34, 1.1583924349881798, 14, (20, 10, 4, 15, 12.1, 32, "Medium", "HIGH"))]


def _predictions(spark, data):
    return spark.createDataFrame(
        data, "SKU string, predicted_monthly_quantity long, predicted_daily_average double")


def _inventory(spark, data):
    return spark.createDataFrame(data, "sku string, available_stock long")


def _chain(spark):
    predictions = _predictions(spark, [r[:3] for r in CHAIN])
    inventory = _inventory(spark, [(r[0], r[3]) for r in CHAIN])
    return replenish.reorder_points(predictions, inventory, replenish.estimate_moq(predictions))


def test_chain_reproduces_known_rows(spark):
    reorder = _chain(spark)
    schedule = replenish.ordering_schedule(reorder)
    got = {r["sku"]: r for r in rows(reorder.join(schedule.select("sku", "urgency"), "sku"))}
    for sku, _, _, _, expected in CHAIN:
        r = got[sku]
        assert (r["moq"], r["lead_time_days"], r["safety_stock"], r["reorder_point"],
                r["days_remaining"], r["recommended_order_qty"], r["order_priority"],
                r["urgency"]) == expected


def test_schedule_order_and_texts(spark):
    schedule = replenish.ordering_schedule(_chain(spark)).collect()
    assert [r.sku for r in schedule] == ["CMSM01C", "LRM03", "LRM02", "JSD-02", "CMSM01D"]
    assert schedule[0].order_date == "URGENT - Order Today"
    assert schedule[3].order_date == "Order within 3 days"
    assert schedule[0].estimated_cost == 344400


def test_summary(spark):
    reorder = _chain(spark)
    summary = replenish.ordering_summary(reorder, replenish.ordering_schedule(reorder),
                                         "2025-12-20").first()
    assert summary.total_skus_analyzed == 5
    assert summary.urgent_orders == 3
    assert summary.total_estimated_order_value == 100.0 * (3444 + 679 + 1641 + 220 + 32)
    assert summary.stockout_risk_skus == 1


def test_no_demand_low_priority_and_missing_terms(spark):
    predictions = _predictions(spark, [("IDLE", 0, 0.0), ("CALM", 300, 10.0), ("MID", 300, 10.0),
                                       ("OWN", 300, 10.0)])
    inventory = _inventory(spark, [("IDLE", 5), ("CALM", 1000), ("MID", 139), ("OWN", 180)])
    moq = spark.createDataFrame([("CALM", 50, 10), ("MID", 50, 10)],
                                "sku string, moq long, lead_time_days int")
    got = {r["sku"]: r for r in rows(replenish.reorder_points(predictions, inventory, moq))}
    assert got["IDLE"]["days_remaining"] == 999.0
    assert not got["IDLE"]["needs_reorder"] and got["IDLE"]["recommended_order_qty"] == 0
    assert got["CALM"]["order_priority"] == "Low"
    # No terms on file: 14 days and ten days of demand.
    assert (got["OWN"]["lead_time_days"], got["OWN"]["moq"]) == (14, 100)
    schedule = {r["sku"]: r for r in rows(replenish.ordering_schedule(
        replenish.reorder_points(predictions, inventory, moq)))}
    assert schedule["MID"]["urgency"] == "MEDIUM"
    assert schedule["MID"]["order_date"] == "Order in 1 days"
    assert "CALM" not in schedule and "IDLE" not in schedule


def test_inventory_estimate_is_repeatable_and_in_range(spark):
    predictions = _predictions(spark, [(f"S{i}", 300, 10.0) for i in range(200)])
    first = rows(replenish.estimate_inventory(predictions), "sku")
    assert first == rows(replenish.estimate_inventory(predictions), "sku")
    assert all(50 <= r["current_stock"] < 150 for r in first)
    assert len({r["current_stock"] for r in first}) > 30


def test_empty_schedule_counts(spark):
    none = replenish.ordering_schedule(_chain(spark).where(F.lit(False)))
    status = replenish.inventory_status(none).first()
    assert status.total_items == 0 and status.health_score == 0.0
    assert replenish.ordering_counts(none).first().total_estimated_cost == 0.0


def test_planning_rules(spark):
    frame = spark.createDataFrame([(40, 100), (100, 100), (101, 100), (250, 100)],
                                  "q long, moq long")
    rounded = [r.o for r in frame.select(
        planning.moq_round_up(F.col("q"), F.col("moq")).alias("o")).collect()]
    assert rounded == [100, 100, 200, 300]
    cover = spark.createDataFrame([(30.0,), (70.0,), (140.0,), (141.0,)], "s double").select(
        planning.urgency_by_cover(F.col("s"), F.lit(10.0)).alias("u"))
    assert [r.u for r in cover.collect()] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def test_group_top_up_and_transfer(spark):
    orders = spark.createDataFrame(
        [("g", "a", 10, 50), ("g", "b", 10, 30), ("g", "c", 0, 30), ("h", "d", 100, 5)],
        "group string, sku string, need long, sales long")
    minimum = spark.createDataFrame([("g", 110), ("h", 50)], "group string, group_moq long")
    got = {r["sku"]: r["top_up"] for r in rows(planning.group_moq(orders, minimum))}
    # Equal sales go by the md5 of the SKU, as ``running_before`` says: c before b.
    assert got == {"a": 50, "b": 10, "c": 30, "d": 0}
    short = spark.createDataFrame([("s", "x", 5), ("s", "y", 9), ("s", "z", 5)],
                                  "sku string, location string, shortfall long")
    own = spark.createDataFrame([("s", 12)], "sku string, own_qty long")
    given = {r["location"]: r["transfer_qty"] for r in rows(planning.stock_transfer(short, own))}
    assert given == {"y": 9, "x": 3, "z": 0}


def test_shared_transfer(spark):
    """Sums are exact, no location gets more than it lacks, and shares are within one unit."""
    pick = random.Random(2)
    short = [(f"s{k}", f"loc{i}", pick.randint(0, 40)) for k in range(8) for i in range(pick.randint(1, 60))]
    short += [("ties", f"t{i}", 3) for i in range(500)] + [("none", "x", 5)]
    own = [(f"s{k}", pick.choice([0, 7, 100, 333, 5000])) for k in range(8)] + [("ties", 1000), ("spare", 9)]
    got = rows(planning.stock_transfer_shared(
        spark.createDataFrame(short, "sku string, location string, shortfall long"),
        spark.createDataFrame(own, "sku string, own_qty long")), "sku", "location")
    assert {r["sku"] for r in got} <= {s for s, _ in own} and all(r["shortfall"] > 0 for r in got)
    for sku, stock in own:
        mine = [r for r in got if r["sku"] == sku]
        total = sum(r["shortfall"] for r in mine)
        assert sum(r["transfer_qty"] for r in mine) == min(stock, total)
        for r in mine:
            assert 0 <= r["transfer_qty"] <= r["shortfall"]
            assert r["still_short"] == r["shortfall"] - r["transfer_qty"]
            if total > stock:
                assert abs(r["transfer_qty"] - stock * r["shortfall"] / total) < 1
    ties = [r["transfer_qty"] for r in got if r["sku"] == "ties"]
    assert sorted(ties) == [2] * 500 and sum(ties) == 1000


def test_positions_equal_demand_and_stock_apart(spark, tables):
    """One pass over the days gives what two passes over the sales do."""
    positions = planning.location_positions(tables.location_days())
    months = forecast.recent_months(tables.sales("Date", "SKU", "Partyname", "Godown", "Quantity"),
                                    ["SKU", "Partyname", "Godown"])
    demand = months.select(F.col("SKU").alias("sku"), F.col("Partyname").alias("channel"),
                           F.col("Godown").alias("godown"), (F.col("recent_mean") * 1.1).alias("demand"))
    stock = planning.closing_stock_latest(tables.closing_stock())
    keys = ["level", "sku", "channel", "godown"]
    want = rows(planning.shortfall(demand, stock), *keys)
    assert rows(planning.shortfall_of(positions), *keys) == want
    assert rows(planning.stockout_outlook_of(positions), "sku") == rows(
        planning.stockout_outlook(demand, stock), "sku")
    plan = planning.shortfall_of(positions)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem") == 1

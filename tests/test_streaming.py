"""Streams equal the batch result; late rows and repeats are dropped."""

import datetime as dt
import random

from pyspark.sql import functions as F
from retail_help import rows

from tillcast.operators.planning import LOCATION, closing_stock_movement
from tillcast.plans.queries import QUERIES
from tillcast.session import STATE_STORE
from tillcast.streaming import ingest, jobs, stock

EVENTS = "ts timestamp, key string, n long, value double"


def _write(spark, folder, *batches):
    for batch in batches:
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def _at(day, hour=12):
    return dt.datetime(2024, 1, day, hour)


def _run(stream, spark, base):
    jobs.run_to_table(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out")


def test_daily_totals_grow_by_runs_and_skip_late_rows(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path)

    def daily():
        stream = jobs.read_stream(spark, source, EVENTS, files_per_trigger=1)
        return _run(jobs.daily_sales(stream, "ts", ["key"], "n", "value"), spark, base)

    _write(spark, source, [(_at(1), "a", 1, 2.5), (_at(1, 15), "a", 2, 0.1), (_at(3), "a", 1, 1.0)])
    assert rows(daily(), "Date") == [
        {"Date": dt.date(2024, 1, 1), "key": "a", "Quantity": 3, "Amount": 2.6}]
    _write(spark, source, [(_at(1, 18), "a", 9, 9.0), (_at(6), "a", 1, 1.0)])
    got = rows(daily(), "Date")
    assert [(r["Date"].day, r["Quantity"]) for r in got] == [(1, 3), (3, 1)]


def test_repeats_are_dropped_across_runs(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path)

    def unique():
        stream = jobs.read_stream(spark, source, EVENTS)
        return _run(jobs.dedupe(stream, ["key"], "ts", "10 days"), spark, base)

    _write(spark, source, [(_at(1), "a", 1, 1.0), (_at(1), "a", 1, 1.0), (_at(2), "b", 1, 1.0)])
    assert unique().count() == 2
    _write(spark, source, [(_at(2), "a", 1, 1.0), (_at(3), "c", 1, 1.0)])
    assert sorted(r["key"] for r in rows(unique())) == ["a", "b", "c"]


def test_ingest_needs_the_sales_columns(spark, tmp_path):
    import pytest

    from tillcast.sources.sinks import RejectedUpload
    source = str(tmp_path / "in")
    _write(spark, source, [(_at(1), "a", 1, 1.0)])
    with pytest.raises(RejectedUpload):
        jobs.ingest_sales(jobs.read_stream(spark, source, EVENTS), str(tmp_path / "o"),
                          str(tmp_path / "c"))


def test_open_days_complete_the_daily_totals(spark, tmp_path):
    source, base = str(tmp_path / "in.parquet"), str(tmp_path)
    data = [(_at(1), "a", 1, 2.5), (_at(1, 15), "b", 2, 0.1), (_at(3), "a", 1, 1.0), (_at(6), "a", 1, 1.0)]
    _write(spark, source, data[:2])
    _write(spark, source, data[2:])
    stream = jobs.read_stream(spark, f"{base}/in.parquet*", EVENTS)
    final = _run(jobs.daily_sales(stream, "ts", ["key"], "n", "value"), spark, base)
    arrived = spark.createDataFrame(data, EVENTS)
    got = rows(jobs.with_open_days(final, arrived, "ts", ["key"], "n", "value"), "Date", "key")
    assert [(r["Date"].day, r["key"], r["Quantity"]) for r in got] == [
        (1, "a", 1), (1, "b", 2), (3, "a", 1), (6, "a", 1)]


# -- checked ingest -----------------------------------------------------------------

RAW = "Date string, SKU string, Quantity string, Amount string"
COLS = ["Date", "SKU", "Quantity", "Amount"]


def _ingest(spark, source, base):
    stream = jobs.read_stream(spark, source, RAW, files_per_trigger=1)
    ingest.ingest_checked(stream, f"{base}/data", f"{base}/checkpoint").awaitTermination()
    counted = rows(ingest.arrivals(spark, f"{base}/data", COLS), "batch")
    return counted, rows(ingest.accepted(spark, f"{base}/data", COLS), "SKU"), rows(
        ingest.rejected(spark, f"{base}/data", COLS), "raw")


def test_replayed_batch_changes_nothing(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path)
    for good, bad in ((3, 1), (0, 2), (2, 0)):
        made = [("2024-01-01", f"S{i}", "1", "2.5") for i in range(good)]
        made += [("never", f"S{i}", "1", "2.5") for i in range(bad)]
        spark.createDataFrame(made, RAW).coalesce(1).write.mode("append").parquet(source)
    counted, sound, refused = _ingest(spark, source, base)
    assert sum(c["arrived"] for c in counted) == 8 == len(sound) + len(refused)
    assert all(c["arrived"] == c["stored"] + c["rejected"] for c in counted) and len(refused) == 3
    # The last batch was written, but the run died before it was marked as done.
    last = max(int(p.name) for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    assert _ingest(spark, source, base) == (counted, sound, refused)
    spark.createDataFrame([("2024-01-02", "T", "-1", "1")], RAW).write.mode("append").parquet(source)
    again = _ingest(spark, source, base)
    assert again[1] == sound and len(again[2]) == 4


# -- stock ----------------------------------------------------------------------------

SNAPSHOTS = "channel string, godown string, sku string, Date date, closing_qty long"


def _stock(spark, folder, base):
    stream = jobs.read_stream(spark, f"{folder}/*", SNAPSHOTS, files_per_trigger=1)
    closed = stock.closing_stock_stream(stream.withColumn("at", F.col("Date").cast("timestamp")), "at", "20 days")
    jobs.run_to_table(closed, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stock.OUTPUT).parquet(f"{base}/out")


def test_stock_equals_batch_for_any_order_and_restart(spark, tmp_path):
    """Rows of three locations and 25 days in files of mixed order, in one run or in several."""
    pick = random.Random(3)
    made = [("F", g, s, dt.date(2024, 1, 1 + d), pick.randint(1, 9)) for d in range(0, 25, 1)
            for g in ("north", "south") for s in ("A", "B") if pick.random() < 0.7]
    made += made[::5]  # units of one day from more than one file add up
    parts = [[r for r in made if r[3].day <= 9], [r for r in made if 6 <= r[3].day and r[3].day > 9 and r[3].day < 18],
             [r for r in made if r[3].day >= 18]]
    for turn, order in enumerate(((0, 1, 2), (1, 0, 2))):
        base, folder = tmp_path / f"run{turn}", tmp_path / f"in{turn}"
        for n, i in enumerate(order):
            mixed = parts[i][:]
            pick.shuffle(mixed)
            spark.createDataFrame(mixed, SNAPSHOTS).coalesce(1).write.parquet(f"{folder}/{n}")
            if turn == 1:  # a run per file, each from the state that the one before left
                _stock(spark, folder, base)
        closed = _stock(spark, folder, base)
        whole = spark.createDataFrame(made, SNAPSHOTS).groupBy(*LOCATION, "Date").agg(
            F.sum("closing_qty").alias("closing_qty"))
        keys = [*LOCATION, "Date"]
        want = rows(closing_stock_movement(whole).select(*closed.columns), *keys)
        done = rows(closed, *keys)
        assert 0 < len(done) < len(want) and all(r in want for r in done)
        assert rows(stock.with_open_stock(closed, whole), *keys) == want


def test_stock_on_a_session_with_the_default_store(spark, tmp_path):
    """The query's stream picks the store itself, and leaves the session as it was. Rows without a
    godown, units or day are kept: missing units make no movement, a missing day comes last."""
    day = dt.datetime(2024, 1, 1)
    lines = [(1, 1, 1, "O", 5.0, day), (2, 1, 1, "O", None, day + dt.timedelta(days=1)),
             (3, 1, 1, "O", 7.0, day + dt.timedelta(days=2)), (4, 1, None, "O", 3.0, day),
             (5, 1, None, "O", 4.0, day + dt.timedelta(days=1)), (6, 1, 1, "O", 2.0, day),
             (7, 1, 1, "O", 9.0, day + dt.timedelta(days=9)), (8, 1, 1, "O", 6.0, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linestatus string, "
                          "l_quantity double, l_shipdate timestamp_ntz").withColumns(
        {c: F.lit(1.0) for c in ("l_extendedprice", "l_discount")}).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "B", "T")], "p_partkey long, p_brand string, p_type string").write.parquet(
        f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "north", 0)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(
        f"{tmp_path}/supplier.parquet")
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        got = rows(QUERIES["closing_stock_stream"](spark, str(tmp_path)))
        assert spark.conf.get(STATE_STORE).endswith("HDFSBackedStateStoreProvider")
    finally:
        spark.conf.set(STATE_STORE, before)
    found = sorted(((r["godown"] or "", str(r["Date"]), r["closing_qty"], r["movement"]) for r in got))
    assert found == [("", "2024-01-01", 3, None), ("", "2024-01-02", 4, 1),
                     ("north", "2024-01-01", 7, None), ("north", "2024-01-02", None, None),
                     ("north", "2024-01-03", 7, None), ("north", "2024-01-10", 9, 2),
                     ("north", "None", 6, -3)]


def test_stock_state_follows_buckets_not_locations(spark, tmp_path):
    """5,000 locations, some with odd names, make fewer state rows than locations. Units add up across files, rows
    later than the watermark allows are dropped, and rows without a day do no harm."""
    odd = F.array(*[F.lit(x) for x in ("", None, "null", "a\tb", 'q"\\', "end\r\n", "\u00fc,%09", "x\u2028y")])
    names = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, "F").alias("channel"), odd[(F.col("id") % 8).cast("int")].alias("godown"),
        F.concat(F.lit("S"), (F.col("id") / 8).cast("int")).alias("sku"), "id")
    sent = names.select("channel", "godown", "sku", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("d"), "id").select(
        *LOCATION, F.expr("date_add(DATE'2024-01-01', d)").alias("Date"),
        F.when((F.col("id") + F.col("d")) % 5 > 0, F.col("id") * F.lit(10) ** 13 + F.col("d") ** 3).cast("long").alias("closing_qty"))
    extra = [("F", None, "S1", dt.date(2024, 1, 3), 7), ("F", "", "S0", None, 5), ("F", "", "S0", dt.date(2024, 1, 9), 1)]
    folder, base = str(tmp_path / "in"), str(tmp_path)
    sent.coalesce(1).write.parquet(f"{folder}/0")
    spark.createDataFrame(extra, SNAPSHOTS).coalesce(1).write.parquet(f"{folder}/1")

    def run():
        stream = jobs.read_stream(spark, f"{folder}/*", SNAPSHOTS).withColumn("at", F.col("Date").cast("timestamp"))
        started = jobs.run_to_table(stock.closing_stock_stream(stream, "at", "2 days"), f"{base}/out", f"{base}/checkpoint")
        started.awaitTermination()
        return started.lastProgress["stateOperators"][0], rows(
            spark.read.schema(stock.OUTPUT).parquet(f"{base}/out"), *LOCATION, "Date")

    state, got = run()
    assert state["numRowsTotal"] < 5000
    whole = sent.unionByName(spark.createDataFrame(extra[:1], SNAPSHOTS)).groupBy(*LOCATION, "Date").agg(
        F.sum("closing_qty").alias("closing_qty"))
    assert got == rows(closing_stock_movement(whole).select(*LOCATION, "Date", "closing_qty", "movement"), *LOCATION, "Date")
    late = [("F", "", "S0", dt.date(2024, 1, 7), 4), ("F", "", "S0", dt.date(2024, 1, 8), 3), ("F", "", "S0", dt.date(2024, 1, 20), 1)]
    spark.createDataFrame(late, SNAPSHOTS).coalesce(1).write.parquet(f"{folder}/2")
    state, again = run()
    assert sorted((r["Date"].day, r["closing_qty"]) for r in again if r not in got) == [(8, 3), (9, 1)]

"""Versions, loads with rejects, mixed headers, and partial sums of patterns and distinct counts."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from retail_help import rows

from tillcast.functions import bloom
from tillcast.operators import features, forecast, sketches
from tillcast.operators.quality import dedupe_sales
from tillcast.sources import loads, patterns, readers, versions

PLAIN = "k long, v string"


def frame(spark, *pairs):
    return spark.createDataFrame(list(pairs), PLAIN).repartition(2)


# -- versions ---------------------------------------------------------------------


def test_versions_grow_and_stay_readable(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"))
    assert table.current() is None
    with pytest.raises(versions.NoSuchVersion):
        table.read()
    assert table.append(frame(spark, (1, "a"), (2, None))) == 2
    assert table.append(frame(spark, (3, "c")), "mine") == 1
    assert table.append(frame(spark, (9, "other rows, known id")), "mine") == 0
    assert table.append(frame(spark, (2, None), (1, "a"))) == 0  # the same rows in another order
    assert table.append(frame(spark, (1, "a"), (2, None), (2, None))) == 3
    table.replace(frame(spark, (7, "x")))
    assert versions.summary(table) == [(1, 2, 1, 1), (2, 3, 2, 2), (3, 6, 3, 3), (4, 1, 1, 3)]
    assert [table.read(n).count() for n in (1, 2, 3)] == [2, 3, 6]
    assert rows(table.read()) == [{"k": 7, "v": "x"}]


def test_failed_write_leaves_the_old_version(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"))
    table.append(frame(spark, (1, "a")))
    broken = frame(spark, (5, "e"), (0, "f")).withColumn("k", F.lit(1).cast("long") / F.col("k"))
    with pytest.raises(PySparkException):
        table.append(broken.withColumn("k", F.col("k").cast("long")), "broken")
    assert versions.summary(table) == [(1, 1, 1, 1)]
    assert table.append(frame(spark, (5, "e")), "broken") == 1  # the id was not used up
    half = tmp_path / "t" / "manifests" / f"{3:012d}"
    half.write_text('{"number": 3, "segm')  # a writer that died in its manifest
    assert table.current().number == 2 and table.read().count() == 2


def test_two_writers_meet(spark, tmp_path, monkeypatch):
    """The slower one finds its number taken and adds to what the faster one made."""
    slow, fast = (versions.VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    slow.append(frame(spark, (1, "a")))
    real, met = slow._create, []

    def late(version):
        if not met:
            met.append(fast.append(frame(spark, (2, "b")), "fast"))
        return real(version)

    monkeypatch.setattr(slow, "_create", late)
    assert slow.append(frame(spark, (3, "c")), "slow") == 1
    assert sorted(r["k"] for r in rows(slow.read())) == [1, 2, 3]
    assert [v.number for v in slow.history()] == [1, 2, 3]


def test_compact_and_vacuum(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"))
    for i in range(3):
        table.append(frame(spark, (i, "x")))
    merged = table.compact()
    assert len(merged.segments) == 1 and merged.rows == 3 and table.append(frame(spark, (1, "x"))) == 0
    gone = table.vacuum(keep=1)
    assert len(gone) == 3 and table.read().count() == 3
    assert [v.number for v in table.history()] == [4]
    assert table.append(frame(spark, (9, "y"))) == 1 and table.read().count() == 4


def test_columns_of_an_upload(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"))
    table.append(frame(spark, (1, "a")))
    turned = spark.createDataFrame([("b", 2, "more")], "v string, k int, w string")
    assert table.append(turned) == 1
    assert table.read().dtypes == [("k", "bigint"), ("v", "string")]
    with pytest.raises(ValueError, match="lacks v"):
        table.append(spark.range(1).withColumnRenamed("id", "k"))
    empty = versions.VersionedTable(spark, str(tmp_path / "none"))
    assert empty.append(frame(spark, (1, "a")).limit(0)) == 0 and empty.read().count() == 0


def test_saving_tables_leaves_the_catalog_alone(spark, tmp_path):
    before = {x.name for x in spark.catalog.listTables()}
    versions.save_versions(spark, {"plain": frame(spark, (1, "a"))}, str(tmp_path))
    assert {x.name for x in spark.catalog.listTables()} == before


# -- rules and loads --------------------------------------------------------------

SALE = "Orderid string, SKU string, Statefrom string, Date string, Quantity string, Amount string"


def sale(order, sku="A", state="KA", day="2024-01-01", units="1", money="2.5"):
    return (order, sku, state, day, units, money)


def test_reasons_of_rejects(spark):
    cases = {
        "ok": sale("ok"), "blank": sale("blank", sku=" "), "date": sale("date", day="01/02/2024"),
        "units": sale("units", units="two"), "taken": sale("taken", units="-3"),
        "signs": sale("signs", sku="A;B"), "all": sale("all", None, None, None, None, None),
        "two": sale("two", day="x", money="y"), "space": sale("space", day=" 2024-01-05 ", units=" 4 ")}
    got = {r["Orderid"]: r for r in rows(loads.checked(spark.createDataFrame(list(cases.values()), SALE)))}
    assert {k: r["reasons"] for k, r in got.items()} == {
        "ok": None, "space": None, "blank": ["missing SKU"], "date": ["bad Date"],
        "units": ["bad Quantity"], "taken": ["negative Quantity"], "signs": ["bad SKU"],
        "all": ["missing Date", "missing SKU", "missing Quantity", "missing Amount"],
        "two": ["bad Date", "bad Amount"]}
    assert got["space"]["Date"] == dt.date(2024, 1, 5) and got["space"]["Quantity"] == 4
    assert got["ok"]["raw"] is None and '"Quantity":"two"' in got["units"]["raw"]
    short = loads.checked(spark.createDataFrame([("A", "1")], "SKU string, Quantity string"))
    assert rows(short)[0]["reasons"] == ["missing Date", "missing Amount"]


def test_loads_equal_dedupe_of_the_union(spark, tmp_path):
    first = [sale(str(i % 40), day=f"2024-01-{i % 28 + 1:02d}") for i in range(200)]
    second = [sale(str(i % 60), day=f"2024-01-{i % 28 + 1:02d}") for i in range(300)]
    second += [sale(None), sale(None), sale("bad", units="x"), sale("1", state=None)]
    third = [sale(str(i), day="2024-02-01") for i in range(50)] + [sale(None)]
    store = loads.SalesStore(spark, str(tmp_path / "s"), bits=1 << 20)
    got = [store.load(spark.createDataFrame(part, SALE).repartition(3), name)
           for part, name in ((first, "1"), (second, "2"), (first, "1"), (third, "3"), (second, "again"))]
    union = spark.createDataFrame(first + second + third, SALE)
    sound = loads.checked(union).where("reasons IS NULL").drop("reasons", "raw")
    keys = list(loads.SALE)
    want = rows(dedupe_sales(sound, keys).select(*keys), *keys)
    assert rows(store.sales.read().select(*keys), *keys) == want
    assert [g.arrived for g in got] == [200, 304, 200, 51, 304]
    assert [g.rejected for g in got] == [0, 1, 0, 0, 1] and got[2].stored == got[4].stored == 0
    assert all(g.arrived == g.stored + g.rejected + g.repeated for g in got)
    store.compact()
    assert store.load(spark.createDataFrame(third, SALE), "once more").stored == 0
    assert rows(store.sales.read().select(*keys), *keys) == want


def test_a_load_reads_its_rows_once(spark, tmp_path):
    """The upload's id and the counts come with the writing."""
    seen = spark.sparkContext.accumulator(0)

    def counted(value):
        seen.add(1)
        return value

    mark = F.udf(counted, "string").asNondeterministic()
    raw = spark.createDataFrame([sale(str(i)) for i in range(50)], SALE).withColumn("Orderid", mark("Orderid"))
    store = loads.SalesStore(spark, str(tmp_path / "s"), bits=1 << 20)
    assert store.load(raw) == loads.Loaded(50, 50, 0, 0) and seen.value == 50
    plain = spark.createDataFrame([sale(str(i)) for i in range(50)], SALE)
    assert store.sales.current().uploads == (versions.fingerprint(plain),)
    assert store.load(plain) == loads.Loaded(50, 0, 0, 50)


def test_load_after_a_failure_between_filter_and_rows(spark, tmp_path, monkeypatch):
    store = loads.SalesStore(spark, str(tmp_path / "s"), bits=1 << 20)
    store.load(spark.createDataFrame([sale("1")], SALE))
    upload = spark.createDataFrame([sale("1"), sale("2"), sale("x", units="?")], SALE)
    real = store.sales.append

    def fails(*_):
        raise OSError("storage went away")

    monkeypatch.setattr(store.sales, "append", fails)
    with pytest.raises(OSError):
        store.load(upload)
    monkeypatch.setattr(store.sales, "append", real)
    assert store.load(upload) == loads.Loaded(3, 1, 1, 1)
    assert store.sales.read().count() == 2 and store.rejects.read().count() == 1


def test_only_possible_repeats_are_joined(spark, tmp_path):
    store = loads.SalesStore(spark, str(tmp_path / "s"))
    store.load(spark.createDataFrame([sale(f"a{i}") for i in range(2000)], SALE))
    fresh = loads.checked(spark.createDataFrame([sale(f"b{i}") for i in range(2000)], SALE))
    assert store.marked(fresh).where("maybe").count() < 20
    full = bloom.build(fresh, ["Orderid"], 1 << 15)  # a filter with nearly every bit set
    assert bloom.with_maybe(fresh, ["Orderid"], full, 1 << 15).where("NOT maybe").count() == 0


# -- patterns ---------------------------------------------------------------------


def test_folded_patterns_equal_a_rebuild(spark, tables, tmp_path):
    cols = ("Date", "SKU", "Quantity")
    whole = features.monthly_sku_sales(tables.sales(*cols, "Amount", "Rate"))
    want = [rows(f, "SKU") for f in (forecast.seasonal_patterns(whole), forecast.yoy_patterns(whole))]
    store = patterns.PatternStore(spark, str(tmp_path / "p"))
    cuts = [None, "1996-03-10", "1998-01-01", "2000-07-20", None]
    parts = [tables.sales(*cols, since=a, until=b) for a, b in zip(cuts, cuts[1:])]
    for i in (2, 0, 3, 1):
        assert store.fold(parts[i], f"load {i}") > 0
    assert store.fold(parts[2], "load 2") == 0
    assert store.fold(parts[1], "by mistake") > 0
    store.take_back(parts[1], "undo")
    for _ in range(2):
        got = [rows(f, "SKU") for f in store.patterns()]
        for g, w in zip(got, want):
            key = [k for k in ("SKU", "month") if k in w[0]]
            value = {tuple(r[k] for k in key): r for r in w}
            assert len(g) == len(w)
            for r in g:
                other = value[tuple(r[k] for k in key)]
                assert all(r[c] == pytest.approx(other[c]) for c in other)
        store.compact()
    assert len(store.table.current().segments) == 1


def test_new_month_does_not_read_the_history(spark, tmp_path):
    """Folding a load plans a scan of that load alone."""
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    schema = "Date date, SKU string, Quantity long"
    spark.createDataFrame([(dt.date(2023, 1, 5), "A", 3)], schema).write.parquet(old)
    spark.createDataFrame([(dt.date(2024, 1, 5), "A", 4), (None, "A", 1), (dt.date(2024, 1, 6), None, 1)],
                          schema).write.parquet(new)
    store = patterns.PatternStore(spark, str(tmp_path / "p"))
    store.fold(spark.read.parquet(old))
    cells = patterns.monthly_cells(spark.read.parquet(new))
    assert [f for f in cells.inputFiles() if "/old/" in f] == []
    store.fold(spark.read.parquet(new))
    assert rows(store.monthly(), "Year") == [
        {"SKU": "A", "Year": 2023, "Month": 1, "Quantity": 3}, {"SKU": "A", "Year": 2024, "Month": 1, "Quantity": 4}]


# -- files whose headers differ -----------------------------------------------------


def test_mixed_headers(spark, tmp_path):
    files = {
        "a.csv": "Date,SKU,Quantity,Amount\n2024-01-01,A,1,2.5\n",
        "b.csv": "﻿Amount, sku ,Note,\"Quantity\",Date\n7,B,\"x, y\",2,2024-01-02\n,,,,\n",
        "more/c.csv": "DATE,SKU,QTY,Amount,Amount\n2024-01-03,C,3,9,1\n",
        "empty.csv": "", "header.csv": "Date,SKU,Quantity,Amount\n", "_SUCCESS": "",
        "same.csv": "Date,SKU,Quantity,Amount\n2024-01-04,D,x,4\n"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    schema = "Date date, SKU string, Quantity bigint, Amount double, Godown string"
    required = ["Date", "SKU", "Quantity", "Amount"]
    got = rows(readers.read_mixed(spark, str(tmp_path), schema, required, {"qty": "Quantity"}), "SKU")
    assert [(r["Date"] and r["Date"].day, r["SKU"], r["Quantity"], r["Amount"], r["Godown"]) for r in got] == [
        (1, "A", 1, 2.5, None), (2, "B", 2, 7.0, None), (3, "C", 3, 9.0, None), (4, "D", None, 4.0, None),
        (None, None, None, None, None)]
    (tmp_path / "bad.csv").write_text("Date,SKU,Amount\n2024-01-05,E,1\n")
    with pytest.raises(ValueError, match="Quantity in .*bad.csv"):
        readers.read_mixed(spark, str(tmp_path), schema, required, {"qty": "Quantity"})
    (tmp_path / "none").mkdir()
    assert readers.read_mixed(spark, str(tmp_path / "none"), schema, required).count() == 0


# -- sketches ---------------------------------------------------------------------


def test_sketches_of_any_cut_count_alike(spark, tmp_path):
    sold = spark.range(60000).selectExpr(
        "date_add(DATE'2024-01-01', CAST(id % 90 AS INT)) AS Date", "CAST(id % 7001 AS STRING) AS Orderid",
        "CAST(id % 311 AS STRING) AS SKU")
    store = sketches.DistinctStore(spark, str(tmp_path / "s"), ["Orderid", "SKU"])
    for i, where in enumerate(("Date < '2024-02-20'", "Date >= '2024-02-01'", "SKU < '2'")):
        assert store.add(sold.where(where), str(i)) > 0
    assert store.add(sold.where("SKU < '2'"), "2") == 0
    exact = {r["m"]: r for r in rows(sold.groupBy(F.date_format("Date", "yyyy-MM").alias("m")).agg(
        F.count_distinct("Orderid").alias("o"), F.count_distinct("SKU").alias("s")))}
    whole = rows(sketches.estimates(sketches.daily_sketches(sold, ["Orderid", "SKU"]),
                                    F.date_format("Date", "yyyy-MM"), ["Orderid", "SKU"]), "period")
    for _ in range(2):
        got = rows(store.monthly(), "period")
        assert [r["period"] for r in got] == [r["period"] for r in whole] and len(got) == 3
        for r in [*got, *whole]:
            assert abs(r["Orderid"] - exact[r["period"]]["o"]) <= 4 * sketches.standard_error() * 7001
            assert abs(r["SKU"] - exact[r["period"]]["s"]) <= 3
        store.compact()
    week = rows(store.trailing("2024-01-31", 7))[0]
    true = sold.where("Date BETWEEN '2024-01-25' AND '2024-01-31'").select("Orderid").distinct().count()
    assert abs(week["Orderid"] - true) <= 4 * sketches.standard_error() * true

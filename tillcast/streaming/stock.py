"""Closing stock and its movement while snapshots arrive, in any order of files.

A location and SKU keeps the days it has heard of and not yet closed, and the units of its last
closed day. Locations and SKUs are dealt to buckets by a hash, and a bucket is one key of the
stream's state, so calls to the state follow the buckets and not the locations. A timer wakes a
bucket when the watermark has passed its first open day: all days that are closed by then leave
in order, each with its change against the day before. What arrives later than the watermark
allows is dropped, as in every stream with a watermark; within that delay the result does not
depend on how the rows were dealt to files and runs, because units of one day add up and days
leave only when no more can come.

State of a bucket: a line for each open day of its locations, at most the days within the delay,
and a line for each location that has closed a day. Before the state, rows of one bucket and event
time are added up and packed into texts of such lines; Python handles texts and columns, not rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tillcast.operators.planning import LOCATION

OUTPUT = "channel string, godown string, sku string, Date date, closing_qty bigint, movement bigint"
DAY_MS = 86_400_000
BUCKETS = 1024
PACK_ROWS = 500_000  # rows added up at a time
PACK_LINES = 64  # lines of a text on its way to the state
OUT_LINES = 10_000  # lines of a text on its way out
OPEN = {"location": pa.string(), "day": pa.int32(), "units": pa.int64()}
LAST = {"location": pa.string(), "units": pa.int64()}
BEFORE_ALL = -2**31
BETWEEN, NONE = "\x1f", "%"
ESCAPES = {"%": "%25", "\t": "%09", "\n": "%0A", "\r": "%0D", BETWEEN: "%1F"}


def _as_text(names: Sequence[Column]) -> Column:
    """Names as one text without tabs and line ends."""
    safe = []
    for name in names:
        for sign, escape in ESCAPES.items():
            name = F.replace(name, F.lit(sign), F.lit(escape))
        safe.append(F.coalesce(name, F.lit(NONE)))
    return F.concat_ws(BETWEEN, *safe)


def _as_name(part: Column) -> Column:
    """A name from its part of ``_as_text``."""
    name = part
    for sign, escape in reversed(ESCAPES.items()):
        name = F.replace(name, F.lit(escape), F.lit(sign))
    return F.when(~part.contains("%"), part).when(part != NONE, name)


def _to_lines(table: pa.Table) -> pa.Array:
    """A row as a line; its location has neither tabs nor line ends."""
    texts = [pc.fill_null(c.combine_chunks().cast(pa.string()), "") for c in table.columns]
    return pc.binary_join_element_wise(*texts, "\t")


def _joined(lines: pa.Array) -> str:
    """Lines as one text."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines), "\n")[0].as_py()


def _from_lines(text: str, columns: dict[str, pa.DataType]) -> pa.Table:
    if not text.strip("\n"):
        return pa.schema(columns).empty_table()
    raw = text.encode()
    return csv.read_csv(
        pa.BufferReader(raw),
        csv.ReadOptions(use_threads=False, block_size=len(raw) + 1, column_names=list(columns)),
        csv.ParseOptions(delimiter="\t", quote_char=False),
        csv.ConvertOptions(column_types=columns, null_values=[""]))


def _added(rows: pa.Table, keys: Sequence[str]) -> pa.Table:
    """Units per key; null where all are."""
    units = rows.group_by(list(keys), use_threads=False).aggregate([("units", "sum")])
    return units.rename_columns({"units_sum": "units"}).select([*keys, "units"])


def _packs(rows: pa.Table, event_time: str) -> pa.RecordBatch:
    """Rows of one bucket and event time as texts of lines. Rows without a day leave no line, but
    their event time."""
    rows = _added(rows, ["_bucket", event_time, "location", "day"])
    rows = rows.take(pc.sort_indices(rows, [("_bucket", "ascending"), (event_time, "ascending")]))
    bucket, at = (rows[c].combine_chunks() for c in ("_bucket", event_time))
    lines = pc.if_else(pc.is_valid(rows["day"].combine_chunks()), _to_lines(rows.select(list(OPEN))), "")
    ms = pc.fill_null(at.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy()
    place = np.arange(len(rows))
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (np.diff(bucket.to_numpy()) != 0) | (ms[1:] != ms[:-1])
    in_run = place - np.maximum.accumulate(np.where(fresh, place, 0))
    starts = np.flatnonzero(in_run % PACK_LINES == 0)
    texts = pa.ListArray.from_arrays(np.append(starts, len(rows)).astype(np.int32), lines)
    return pa.RecordBatch.from_arrays(
        [bucket.take(pa.array(starts)), at.take(pa.array(starts)), pc.binary_join(texts, "\n")],
        names=["_bucket", event_time, "lines"])


def _pack(event_time: str):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACK_ROWS:
                yield _packs(pa.Table.from_batches(held), event_time)
                held, n = [], 0
        if n:
            yield _packs(pa.Table.from_batches(held), event_time)

    return packed


class StockLedger(StatefulProcessor):
    """Open days and last closed units of the locations and SKUs of one bucket."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "lines string")
        self.last = handle.getValueState("last", "lines string")

    @staticmethod
    def _kept(state) -> str:
        row = state.get()
        return "" if row is None else row[0]

    @staticmethod
    def _keep(state, table: pa.Table) -> None:
        state.update((_joined(_to_lines(table)),))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = _from_lines(self._kept(self.open), OPEN)
        new = _from_lines("\n".join(lines for _, _, lines in rows), OPEN)
        days = _added(pa.concat_tables([kept, new]), ["location", "day"])
        self._keep(self.open, days)
        self._wake(pc.min(kept["day"]).as_py(), pc.min(days["day"]).as_py())
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # A day is closed once the watermark has passed its end.
        closed_to = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS
        now = timerValues.getCurrentWatermarkInMs() // DAY_MS
        days = _from_lines(self._kept(self.open), OPEN)
        closed = pc.less(days["day"], max(closed_to, now))
        still_open = days.filter(pc.invert(closed))
        last = _from_lines(self._kept(self.last), LAST)
        last = last.add_column(1, "day", pa.array(np.full(len(last), BEFORE_ALL, np.int32)))
        days = pa.concat_tables([last, days.filter(closed)]).combine_chunks()
        days = days.take(pc.sort_indices(days, [("location", "ascending"), ("day", "ascending")]))
        location, units = days["location"].combine_chunks(), days["units"].combine_chunks()
        goes_on = pc.equal(location[1:], location[:-1])  # the row before is of the same location
        change = pc.if_else(goes_on, pc.subtract_checked(units[1:], units[:-1]), None)
        moved = days.append_column("movement", pa.concat_arrays([pa.nulls(1, pa.int64()), change]))
        ends = pa.concat_arrays([pc.invert(goes_on), pa.array([True])])
        self._keep(self.last, days.filter(ends).select(list(LAST)))
        self._keep(self.open, still_open)
        self._wake(None, pc.min(still_open["day"]).as_py())
        out = _to_lines(moved.filter(pc.greater(days["day"], BEFORE_ALL)))
        for start in range(0, len(out), OUT_LINES):
            yield Row(lines=_joined(out[start:start + OUT_LINES]))

    def _wake(self, before: int | None, first: int | None) -> None:
        """Sets the timer to the end of the first open day."""
        if before == first:
            return
        if before is not None:
            self.handle.deleteTimer((before + 1) * DAY_MS)
        if first is not None:
            self.handle.registerTimer((first + 1) * DAY_MS)

    def close(self) -> None:
        pass


def closing_stock_stream(snapshots: DataFrame, event_time: str, delay: str = "1 day",
                         buckets: int = BUCKETS) -> DataFrame:
    """Closed days of a stream with ``channel, godown, sku, Date, closing_qty`` and an event
    time, in the columns of ``planning.closing_stock_movement``. A bucket's state is read and
    written whole; a checkpoint belongs to its number of buckets."""
    texts = [F.col(c).cast("string") for c in LOCATION]
    rows = snapshots.select(
        F.pmod(F.xxhash64(*texts), F.lit(buckets)).cast("int").alias("_bucket"), event_time,
        _as_text(texts).alias("location"), F.unix_date("Date").alias("day"),
        F.col("closing_qty").alias("units"))
    packed = T.StructType([rows.schema["_bucket"], rows.schema[event_time], T.StructField("lines", T.StringType())])
    # Dealt by event time too: a location with many rows is spread over its days.
    packs = rows.repartition("_bucket", event_time).mapInArrow(_pack(event_time), packed)
    closed = (packs.withWatermark(event_time, delay).groupBy("_bucket")
              .transformWithState(StockLedger(), "lines string", "append", "eventTime"))
    parts = closed.select(F.explode(F.split("lines", "\n")).alias("line")).select(
        F.split("line", "\t").alias("p"))
    names = parts.select(F.split(F.col("p")[0], BETWEEN).alias("l"), "p")
    return names.select(
        *[_as_name(F.col("l")[i]).alias(c) for i, c in enumerate(LOCATION)],
        F.date_from_unix_date(F.col("p")[1].cast("int")).alias("Date"),
        *[F.when(F.col("p")[i] != "", F.col("p")[i]).cast("bigint").alias(c)
          for i, c in ((2, "closing_qty"), (3, "movement"))])


def with_open_stock(closed: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The closed days and, from the snapshots as they stand, the days that are still open. A
    location's first open day is compared with its last closed one; units without a day come last."""
    last = closed.groupBy(*[F.col(c).alias(f"_{c}") for c in LOCATION]).agg(
        F.max("Date").alias("_day"), F.max_by("closing_qty", "Date").alias("_units"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in LOCATION]
    open_days = snapshots.join(last, same, "left").where(
        "_day IS NULL OR Date IS NULL OR Date > _day")
    by_day = Window.partitionBy(*LOCATION).orderBy(F.col("Date").asc_nulls_last())
    before = F.when(F.row_number().over(by_day) == 1, F.col("_units")).otherwise(
        F.lag("closing_qty").over(by_day))
    moved = open_days.withColumn("movement", F.col("closing_qty") - before)
    columns: Sequence[str] = closed.columns
    return closed.unionByName(moved.select(*columns))


cloudpickle.register_pickle_by_value(sys.modules[__name__])

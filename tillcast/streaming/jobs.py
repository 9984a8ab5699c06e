"""Structured Streaming forms of the upload, the duplicate check and the daily trend.

All jobs run with ``availableNow``: a scheduled run takes in what has arrived
and ends. State and progress live in the checkpoint folder, which must be on
storage all executors share.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tillcast.functions.numeric import as_money, money_units
from tillcast.sources.schemas import REQUIRED_SALES
from tillcast.sources.sinks import check_columns


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str,
                files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """File stream with a declared schema. The path may have wildcards and match files or
    folders of part files."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str,
                 mode: str = "append", fmt: str = "parquet") -> StreamingQuery:
    """Starts one pass over what is available, written to ``path`` exactly once."""
    return (stream.writeStream.outputMode(mode).format(fmt)
            .option("checkpointLocation", checkpoint).option("path", path)
            .trigger(availableNow=True).start())


def ingest_sales(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stores arriving sales rows that carry the required columns' types."""
    check_columns(stream, REQUIRED_SALES)
    return run_to_table(stream, path, checkpoint)


def dedupe(stream: DataFrame, keys: Sequence[str], event_time: str,
           delay: str = "1 hour") -> DataFrame:
    """First arrival per key; a key is forgotten once the watermark has passed it."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def daily_sales(stream: DataFrame, event_time: str, keys: Sequence[str], quantity: str,
                amount: str, delay: str = "1 hour") -> DataFrame:
    """Daily totals per key; a day is final once the watermark has passed its end.

    Rows that arrive after that are dropped.
    """
    return _per_day(stream.withWatermark(event_time, delay), event_time, keys, quantity, amount)


def _per_day(events: DataFrame, event_time: str, keys: Sequence[str], quantity: str,
             amount: str) -> DataFrame:
    return (events.groupBy(F.window(event_time, "1 day").alias("_day"), *keys)
            .agg(F.sum(quantity).alias("Quantity"), money_units(amount).alias("_m"))
            .select(F.to_date("_day.start").alias("Date"), *keys, "Quantity",
                    as_money(F.col("_m")).alias("Amount")))


def with_open_days(final: DataFrame, events: DataFrame, event_time: str, keys: Sequence[str],
                   quantity: str, amount: str) -> DataFrame:
    """The final days of ``daily_sales`` and, from the events as they stand, the days after
    them, which the stream holds back until the watermark has passed. Only events after the
    last final day are read."""
    last = final.agg(F.max("Date").alias("d")).first()["d"]
    if last is not None:
        events = events.where(F.col(event_time) >= F.lit(last + timedelta(days=1)).cast("timestamp"))
    return final.unionByName(_per_day(events, event_time, keys, quantity, amount))

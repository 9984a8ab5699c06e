"""Arriving sales checked row by row, with a table of what was turned away.

Every micro-batch is written once, into a folder of its own that the batch's number names,
sound rows and rejects side by side. A batch that is played again after a failure overwrites
that folder with the same rows, so nothing is stored twice and nothing is lost: sound and
rejected rows together are the rows that arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tillcast.sources.loads import TYPES, checked


def ingest_checked(raw: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """One pass over the available rows of a stream of text columns into ``folder``, which
    belongs to the checkpoint: both live and go together."""
    def store(batch: DataFrame, number: int) -> None:
        (checked(batch).withColumn("accepted", F.col("reasons").isNull())
         .write.mode("overwrite").partitionBy("accepted").parquet(f"{folder}/batch={number}"))

    return (raw.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _stored(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    types = {**TYPES, "reasons": "array<string>"}
    schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in [*columns, "reasons", "raw"])
    wanted = T.StructType.fromDDL(schema + ", batch bigint, accepted boolean")
    return spark.read.schema(wanted).parquet(folder)


def accepted(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """The sound rows; rejects are not read."""
    return _stored(spark, folder, columns).where("accepted").select(*columns)


def rejected(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """``batch, reasons, raw`` of the rows turned away."""
    return _stored(spark, folder, columns).where("NOT accepted").select("batch", "reasons", "raw")


def arrivals(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Per batch the rows that arrived, were stored and were turned away."""
    return _stored(spark, folder, columns).groupBy("batch").agg(
        F.count("*").alias("arrived"), F.count_if("accepted").alias("stored"),
        F.count_if(~F.col("accepted")).alias("rejected"))

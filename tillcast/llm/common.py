"""Helpers shared by the text operators."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.session import scratch_path

# What the contracts call white space: blank and the control characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SALTS = 64
SLICE = 1 << 20  # characters of text that a Python task holds as strings at a time


def ship(module_name: str) -> None:
    """Sends a module's functions to Python workers by value, so that executors
    need no copy of this package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read back: lineage ends here,
    and a lost executor costs no recomputation."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def text_slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch, null as empty, in slices of about ``SLICE`` characters, with the
    place of the first."""
    at, texts, size = 0, [], 0
    for i, value in enumerate(column):
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= SLICE:
            yield at, texts
            at, texts, size = i + 1, [], 0
    if texts:
        yield at, texts


def whole(text: Column | str) -> Column:
    """The text with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Texts of one byte per character take the fast path."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, UPPER.lower())))


def fresh(frame: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the frame is called so."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def salt_of(*columns: str) -> Column:
    """One of a fixed number of salts, from the row's own columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def with_group_facts(rows: DataFrame, key: str, spread: str, facts: dict[str, Column],
                     merge: dict[str, Column], left: bool = False,
                     keep: Column | None = None) -> DataFrame:
    """Adds facts about a row's group to each row, whatever the group's size.

    ``facts`` aggregate the rows of one (key, salt), ``merge`` combines those
    per key under the same names. A group never meets in one task: partial
    results are at most one row per salt, and the facts go back to the rows
    over (key, salt), so a group with a third of all rows is dealt out to as
    many tasks as there are salts. ``keep`` drops groups after merging; with
    ``left`` the rows of dropped groups stay with null facts.
    """
    salted = rows.withColumn("_salt", salt_of(spread))
    parts = salted.groupBy(key, "_salt").agg(*[v.alias(n) for n, v in facts.items()])
    merged = parts.groupBy(key).agg(*[v.alias(n) for n, v in merge.items()],
                                    F.collect_list("_salt").alias("_salts"))
    if keep is not None:
        merged = merged.where(keep)
    back = merged.select(F.col(key).alias("_key"), *merge, F.explode("_salts").alias("_s"))
    on = (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_s"))
    return salted.join(back, on, "left" if left else "inner").drop("_key", "_s", "_salt")


def with_key_facts(rows: DataFrame, key: str, spread: str, facts: DataFrame) -> DataFrame:
    """Joins ``facts``, one row per key, to all rows; a hot key is dealt out over salts."""
    salted = rows.withColumn("_salt", salt_of(spread))
    used = salted.select(key, "_salt").distinct().join(facts, key)
    back = used.withColumnsRenamed({key: "_key", "_salt": "_s"})
    on = (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_s"))
    return salted.join(back, on).drop("_key", "_s", "_salt")


ship(__name__)

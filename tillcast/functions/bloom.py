"""A Bloom filter over key columns as a small table of bitmaps.

The filter has at most ``MOST_BITS`` bits (64 MB), so it can go to all tasks by broadcast
whatever the number of keys; a fuller filter only lets more rows through to the exact check.
Filters of the same width merge by OR, so one can be kept next to a growing table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 1 << 15  # bits in one bitmap of bitmap_construct_agg
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
SEEDS = ("a", "b", "c")


def width(keys: int, per_key: int = 12) -> int:
    """Bits for so many keys: a power of two within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, keys * per_key - 1).bit_length()))


def _spots(keys: Sequence[str], bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in keys]), F.lit(bits))
            for seed in SEEDS]


def build(rows: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """``page, map``: the bitmaps of the rows' keys."""
    spots = rows.select(F.explode(F.array(*_spots(keys, bits))).alias("p"))
    return spots.groupBy(F.floor(F.col("p") / PAGE).cast("int").alias("page")).agg(
        F.bitmap_construct_agg(F.col("p") % PAGE).alias("map"))


def merge(maps: DataFrame) -> DataFrame:
    """Bitmaps of several filters of one width as one filter."""
    return maps.groupBy("page").agg(F.bitmap_or_agg("map").alias("map"))


def with_maybe(rows: DataFrame, keys: Sequence[str], maps: DataFrame, bits: int,
               name: str = "maybe") -> DataFrame:
    """Adds ``name``: false only if the row's keys are not among those of the filter."""
    columns, held = rows.columns, []
    for i, spot in enumerate(_spots(keys, bits)):
        page, bitmap, at = f"_page{i}", f"_map{i}", f"_spot{i}"
        part = F.broadcast(maps.select(F.col("page").alias(page), F.col("map").alias(bitmap)))
        rows = rows.withColumn(at, spot).join(
            part, F.floor(F.col(at) / PAGE).cast("int") == F.col(page), "left")
        bit = F.col(at) % PAGE
        byte = F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1)))
        # The upper four bits are the first digit; looking digits up is cheaper than ``conv``.
        digit = F.substring(byte, F.when(bit % 8 >= 4, 1).otherwise(2), F.lit(1))
        value = F.position(digit, F.lit("0123456789ABCDEF")) - 1
        held.append(F.coalesce(F.getbit(value, (bit % 4).cast("int")) == 1, F.lit(False)))
    found = held[0]
    for more in held[1:]:
        found = found & more
    return rows.select(*[F.col(f"`{c}`") for c in columns], found.alias(name))

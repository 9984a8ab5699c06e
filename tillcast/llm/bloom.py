"""Bloom filters of bounded size, in plain columns.

A filter is a table of bitmaps ``(seg, map)``. It holds at most ``MOST_BITS``
bits (64 MB), so it may be broadcast whatever the data; a fuller filter lets
more rows pass as possible members, which an exact step then decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = 32768  # bits in a value of bitmap_construct_agg
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29


def filter_bits(rows: int, per_row: int = 16) -> int:
    """Bits of a filter for so many rows: a power of two within the bounds."""
    bits = LEAST_BITS
    while bits < rows * per_row and bits < MOST_BITS:
        bits *= 2
    return bits


def positions(h: Column, bits: int) -> list[Column]:
    """Two positions from the two halves of a 64-bit hash."""
    return [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))]


def bitmaps(hits: DataFrame) -> DataFrame:
    """The bitmaps of the positions ``hits.p``."""
    return (hits.groupBy(F.floor(F.col("p") / SEGMENT).cast("int").alias("seg"))
            .agg(F.bitmap_construct_agg(F.col("p") % SEGMENT).alias("map")))


def with_maybe(rows: DataFrame, h: Column, maps: DataFrame, bits: int, name: str) -> DataFrame:
    """Adds ``name``: false only if the filter rules the hash out."""
    own = "_bf"
    while any(c.lower().startswith(own) for c in rows.columns):
        own = f"_{own}"
    columns, held = rows.columns, []
    for i, p in enumerate(positions(h, bits)):
        seg, bitmap, spot = f"{own}_seg{i}", f"{own}_map{i}", f"{own}_p{i}"
        part = F.broadcast(maps.select(F.col("seg").alias(seg), F.col("map").alias(bitmap)))
        rows = rows.withColumn(spot, p).join(
            part, F.floor(F.col(spot) / SEGMENT).cast("int") == F.col(seg), "left")
        at = F.col(spot) % SEGMENT
        byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))),
                      16, 10).cast("int")
        held.append(F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
    return rows.select(*columns, (held[0] & held[1]).alias(name))


def maybe_among(docs: DataFrame, id_col: str, ids: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: false only if the document's id, null included, is not among ``ids``.

    Rows marked false need no join with the ids, and so no shuffle."""
    bits = filter_bits(ids.count())
    spots = positions(F.xxhash64(ids.columns[0]), bits)
    hits = ids.select(F.explode(F.array(*spots)).alias("p")).distinct()
    return with_maybe(docs, F.xxhash64(id_col), bitmaps(hits), bits, name)

"""Shards of near equal bytes by histogram sort.

Rows are ordered by key: the text's crc32, so that equal texts lie together, then
the id, then a number that tells equal rows apart. A splitter starts as the range
of all keys. Each round cuts the open ranges into at most ``PROBES`` parts by
evenly spaced candidate boundaries, counts the exact bytes below each of them over
all partitions, and keeps the part in which the splitter's target lies, narrowed
to the keys that occur in it. A splitter is settled when its range holds a single
row or fewer bytes than the tolerance allows; the nearer end of the range is the
cut. With tolerance 0 a row is in the shard that holds the middle of its bytes.
A group of equal texts, however large, is cut by id. Then the rows are exchanged
once, into ranges of shard and key, and numbered where they lie.

Everything is columns. The driver sees at most ``PROBES`` + 1 counts per splitter
and round.

Defined cases: a null text has no bytes and counts 1, like an empty one; a null id
comes first; ids that are not whole numbers are ordered by their hash; repeated
rows are dealt one by one; with fewer rows than shards, or one very long text,
some shards are empty; an empty table gives an empty result; of further columns
only those named in ``carry`` are read, names that clash included.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.common import fresh, written

PROBES = 256
KEYS = ("_crc", "_place", "_row")
FIRST = -(1 << 63)


@dataclass(frozen=True)
class Range:
    """Keys with fixed leading parts and a span of the part at ``level``; what lies below."""

    lows: tuple[int, ...]
    highs: tuple[int, ...]
    level: int
    below: int
    size: int
    rows: int

    def deeper(self) -> Range:
        """The same keys seen by the first part that differs among them."""
        level = self.level
        while level < len(KEYS) - 1 and self.lows[level] == self.highs[level]:
            level += 1
        return replace(self, level=level)

    def holds(self) -> Column:
        held = F.col(KEYS[self.level]).between(self.lows[self.level], self.highs[self.level])
        for i in range(self.level):
            held = held & (F.col(KEYS[i]) == self.lows[i])
        return held

    def shift(self) -> int:
        low, high, bits = self.lows[self.level], self.highs[self.level], 0
        while (high >> bits) - (low >> bits) >= PROBES:
            bits += 1
        return bits

    def probe(self) -> Column:
        bits = self.shift()
        return (F.shiftright(F.col(KEYS[self.level]), bits)
                - F.lit(self.lows[self.level] >> bits)).cast("int")

    def from_here(self, after: bool) -> Column:
        """Whether a row's key is in or after the range (``after``: only after it)."""
        at = F.col(KEYS[self.level])
        past = at > self.highs[self.level] if after else at >= self.lows[self.level]
        for i in reversed(range(self.level)):
            key = F.col(KEYS[i])
            past = (key > self.lows[i]) | ((key == self.lows[i]) & past)
        return past


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str]) -> DataFrame:
    """``_id, _size, _crc, _place, _row, _kept``; written, so that the row numbers stay."""
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    place = (F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)) if whole else
             F.when(F.col(id_col).isNull(), F.lit(FIRST)).otherwise(
                 F.xxhash64(F.col(id_col).cast("string"))))
    raw = F.col(text_col).cast("binary")
    kept = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("int")
    return written(docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("_size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("_crc"), place.alias("_place"),
        F.monotonically_increasing_id().alias("_row"), kept.alias("_kept")), "shard-keys")


_FACTS = [F.sum, F.count, *[F.min] * len(KEYS), *[F.max] * len(KEYS)]


def _measured(below: int, level: int, found: Sequence) -> Range:
    size, rows, *ends = found
    return Range(tuple(ends[:len(KEYS)]), tuple(ends[len(KEYS):]), level, below, size,
                 rows).deeper()


def _facts() -> list[Column]:
    columns = ["_size", "_size", *KEYS, *KEYS]
    return [f(c).alias(f"f{i}") for i, (f, c) in enumerate(zip(_FACTS, columns, strict=True))]


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[Range, bool]]:
    """For each cut between shards the settled range and whether the cut lies behind it."""
    first = rows.agg(*_facts()).first()
    if not first[1]:
        return []
    total = first[0]
    slack = tolerance * total / shards
    open_at = {i: _measured(0, 0, first) for i in range(1, shards)}
    settled: dict[int, Range] = {}
    left = rows
    while True:
        for i in list(open_at):
            if open_at[i].rows == 1 or open_at[i].size <= slack:
                settled[i] = open_at.pop(i)
        if not open_at:
            break
        ranges = sorted(set(open_at.values()), key=lambda r: (r.lows, r.level))
        if ranges[0].rows < first[1]:
            left = written(left.where(reduce(Column.__or__, [r.holds() for r in ranges])),
                           "shard-open")
        which, probe = F.lit(None).cast("int"), F.lit(None).cast("int")
        for k, r in enumerate(ranges):
            held = r.holds()
            which = F.when(held, k).otherwise(which)
            probe = F.when(held, r.probe()).otherwise(probe)
        counted = left.select("_size", *KEYS, which.alias("_which"), probe.alias("_probe")).where(
            "_which IS NOT NULL").groupBy("_which", "_probe").agg(*_facts()).collect()
        parts = sorted(counted, key=lambda c: (c["_which"], c["_probe"]))
        for i, before in open_at.items():
            below = before.below
            for part in parts:
                if ranges[part["_which"]] != before:
                    continue
                size = part["f0"]
                if shards * (below + size) > i * total:
                    open_at[i] = _measured(below, before.level, part[2:])
                    break
                below += size
    return [(r, 2 * (i * total - shards * r.below) > shards * r.size)
            for i, r in sorted(settled.items())]


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id",
                    text_col: str = "text", tolerance: float = 0.0,
                    carry: Sequence[str] = ()) -> DataFrame:
    """``id, size, text_crc32, shard, slot`` and the columns in ``carry``, one row per row. A name
    that ``carry`` has too gets underscores in front.

    ``tolerance`` is the share of a shard's mean bytes by which a cut may be off."""
    rows = keyed(docs, id_col, text_col, carry)
    shard = F.lit(0)
    for at, after in splitters(rows, shards, tolerance):
        shard = shard + at.from_here(after).cast("int")
    order = ["_shard", *KEYS]
    placed = written(rows.withColumn("_shard", shard).repartitionByRange(*order)
                     .sortWithinPartitions(*order)
                     .withColumn("_at", F.monotonically_increasing_id()), "shards")
    # At most one row per task and shard.
    pieces = placed.groupBy("_shard", F.shiftright("_at", 33).alias("_task")).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_task").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = pieces.select("_shard", "_task", (
        F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_move"))
    numbered = placed.withColumn("_task", F.shiftright("_at", 33)).join(
        F.broadcast(starts), ["_shard", "_task"])
    names = [fresh(docs.select(id_col, *carry), n) for n in ("size", "text_crc32", "shard", "slot")]
    made = [F.col("_size"), F.col("_crc"), F.col("_shard"), F.col("_at") + F.col("_move")]
    return numbered.select(
        F.col("_id").alias(id_col), *[c.alias(n) for c, n in zip(made, names, strict=True)],
        *[F.col("_kept")[c].alias(c) for c in carry])


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id",
                 text_col: str = "text", tolerance: float = 0.0001) -> None:
    """All rows and columns of ``docs`` in one folder per shard below ``path``."""
    rest = [c for c in docs.columns if c != id_col]
    (shard_documents(docs, shards, id_col, text_col, tolerance, rest)
     .write.partitionBy(fresh(docs, "shard")).parquet(path))

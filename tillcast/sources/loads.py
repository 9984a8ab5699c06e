"""Loads into a stored table: rows checked against the rules, and no sale stored twice.

A load is cut in two. Rows that break a rule go to a reject table with their reasons and the
text they came as; the others lose the copies inside the load and meet the stored table. A Bloom
filter of the stored keys is kept next to it: a row that the filter has not seen is new for
certain and passes straight through, and only possible repeats are joined with the stored
keys. The result equals removing duplicates from all loads together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillcast.functions import bloom
from tillcast.operators.quality import dedupe_sales
from tillcast.session import scratch_path
from tillcast.sources.versions import VersionedTable, row_sums, upload_id

SALE = ("Orderid", "SKU", "Statefrom", "Date")
TYPES = {"Date": "date", "Quantity": "bigint", "Amount": "double"}
# Fixed value: what a SKU may be written with.
SKU_SIGNS = "^[A-Za-z0-9#/._ -]+$"


def _rules(raw: DataFrame, required: Sequence[str]) -> list[tuple[Column, str]]:
    """Tests that are true for a row that breaks the rule, in a fixed order."""
    tests = [(F.trim(F.col(c)).isNull() | (F.trim(F.col(c)) == ""), f"missing {c}")
             for c in required if c in raw.columns]
    tests += [(F.lit(True), f"missing {c}") for c in required if c not in raw.columns]
    for name, kind in TYPES.items():
        if name in raw.columns:
            tests.append(((F.trim(F.col(name)) != "") & parsed(name, kind).isNull(), f"bad {name}"))
    if "SKU" in raw.columns:
        text = F.trim(F.col("SKU"))
        tests.append(((text != "") & ~text.rlike(SKU_SIGNS), "bad SKU"))
    if "Quantity" in raw.columns:
        tests.append((parsed("Quantity", "bigint") < 0, "negative Quantity"))
    return tests


def reasons(raw: DataFrame, required: Sequence[str] = ("Date", "SKU", "Quantity", "Amount")) -> Column:
    """The rules a row of text columns breaks, in a fixed order; empty if it breaks none."""
    return F.array_compact(F.array(*[F.when(test, why) for test, why in _rules(raw, required)]))


def _broken(raw: DataFrame, required: Sequence[str] = ("Date", "SKU", "Quantity", "Amount")) -> Column:
    """Whether a row breaks a rule, without the list: that one is evaluated step by step."""
    found = F.lit(False)
    for test, _ in _rules(raw, required):
        found = found | F.coalesce(test, F.lit(False))
    return found


def parsed(name: str, kind: str = "string") -> Column:
    text = F.trim(F.col(name))
    if kind == "date":
        return F.try_to_date(text, "yyyy-MM-dd")
    return text.try_cast(kind) if kind != "string" else text


def checked(raw: DataFrame) -> DataFrame:
    """Parsed columns, ``reasons`` (null for a sound row) and, for a row that breaks a rule,
    ``raw``: the row as it came, in JSON."""
    columns = [parsed(c, TYPES.get(c, "string")).alias(c) for c in raw.columns]
    broken = _broken(raw)
    return raw.select(*columns, F.when(broken, reasons(raw)).alias("reasons"),
                      F.when(broken, F.to_json(F.struct(*raw.columns))).alias("raw"))


@dataclass(frozen=True)
class Loaded:
    """What became of a load's rows."""

    arrived: int
    stored: int
    rejected: int
    repeated: int


class SalesStore:
    """Stored sales, their rejects and the filter of their keys, below one folder."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str] = SALE,
                 bits: int = bloom.width(20_000_000)):
        self.spark, self.keys, self.bits = spark, list(keys), bits
        root = folder.rstrip("/")
        self.sales = VersionedTable(spark, f"{root}/sales")
        self.rejects = VersionedTable(spark, f"{root}/rejects")
        self.filter = VersionedTable(spark, f"{root}/filter-{bits}")

    def load(self, raw: DataFrame, upload: str | None = None) -> Loaded:
        """Checks, cuts and stores a load of text columns. A load that is already stored, or
        that failed half-way, can be given again with the same result."""
        path, sums, counts = scratch_path(self.spark, "load"), Observation(), Observation()
        seen = raw if upload else raw.observe(sums, *row_sums(raw.columns))
        # Read several times, from files that do not change; id and counts come with the writing.
        checked(seen).observe(counts, F.count("*").alias("n"), F.count("reasons").alias("bad")
                              ).write.parquet(path)
        upload = upload or upload_id(sums.get)
        now = self.sales.current()
        rows = self.spark.read.parquet(path)
        arrived, bad = counts.get["n"], counts.get["bad"]
        refused = rows.where("reasons IS NOT NULL") if bad else rows.limit(0)
        self.rejects.append(refused.withColumn("upload", F.lit(upload)), upload)
        if now and upload in now.uploads:
            return Loaded(arrived, 0, bad, arrived - bad)
        once = dedupe_sales(rows.where("reasons IS NULL").drop("reasons", "raw"), self.keys)
        fresh = self.unseen(once) if now else once
        # Keys enter the filter before the table names the rows: a failure in between leaves
        # bits too many, which costs a check, never a row.
        part = self.sales.staged(fresh)
        self.filter.append(bloom.build(self.sales.read_staged(part), self.keys, self.bits), upload)
        stored = self.sales.append(part, upload)
        return Loaded(arrived, stored, bad, arrived - bad - stored)

    def marked(self, rows: DataFrame) -> DataFrame:
        """Adds ``maybe``: false only for rows whose key is not stored."""
        return bloom.with_maybe(rows, self.keys, bloom.merge(self.filter.read()), self.bits)

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows whose key is not stored. Of both sides only possible repeats are joined:
        stored keys are first held against a filter of the doubtful rows."""
        columns = rows.columns
        path = scratch_path(self.spark, "marked")
        self.marked(rows).write.parquet(path)
        marked = self.spark.read.parquet(path)
        doubtful = marked.where("maybe").drop("maybe")
        bits = bloom.width(doubtful.count())
        near = bloom.with_maybe(self.sales.read().select(*self.keys), self.keys,
                                bloom.build(doubtful, self.keys, bits), bits).where("maybe")
        stored = near.select(*[F.col(k).alias(f"_{k}") for k in self.keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]
        checked_rows = doubtful.join(stored, same, "left_anti")
        return marked.where("NOT maybe").select(*columns).unionByName(checked_rows.select(*columns))

    def compact(self) -> None:
        """One segment of sales, and one bitmap a page."""
        self.sales.compact()
        self.filter.replace(bloom.merge(self.filter.read()))

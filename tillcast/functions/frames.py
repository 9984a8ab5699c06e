"""Helpers that keep global steps bounded: one-row bundles, exact quantiles,
running totals over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def bundle(spark: SparkSession, *one_row_frames: DataFrame) -> DataFrame:
    """Columns of several one-row frames side by side.

    Each frame is read as a scalar subquery, so nothing is joined and the plan
    fails rather than multiplies if a frame has more than one row.
    """
    packed = spark.range(1).select(*[
        frame.select(F.struct(*frame.columns)).scalar().alias(f"b{i}")
        for i, frame in enumerate(one_row_frames)
    ])
    return packed.select(*[
        F.col(f"b{i}")[name].alias(name)
        for i, frame in enumerate(one_row_frames) for name in frame.columns
    ])


def total(frame: DataFrame, value: Column) -> Column:
    """Aggregate of a whole frame as a scalar column for use in another frame."""
    return frame.agg(value.alias("t")).scalar()


def drop_null_keys(frame: DataFrame, *keys: str) -> DataFrame:
    """Rows whose group keys are all present; groups with a missing key are not reported."""
    for key in keys:
        frame = frame.where(F.col(key).isNotNull())
    return frame


def top_by(frame: DataFrame, n: int | None, value: str, *keys: str,
           ascending: bool = False) -> DataFrame:
    """First ``n`` rows by ``value``; equal values are ordered by the keys."""
    first = F.col(value).asc() if ascending else F.col(value).desc()
    ordered = frame.orderBy(first, *keys)
    return ordered if n is None else ordered.limit(n)


def exact_quantile(frame: DataFrame, value: str, q: float, cells: int = 65536) -> DataFrame:
    """One-row frame ``quantile``: linearly interpolated quantile of a whole column.

    No task ever holds the column. Equal values are counted; the counts are
    added up per cell of sign and magnitude (a 64th of a power of two, so one
    far value draws no others together), then per equal-width part of the one
    or two cells that hold the wanted ranks (at most ``cells`` rows each). Only
    the distinct values of the one or two parts left are put in order. Cells
    and parts follow from the values alone, so a re-run after a lost executor
    finds the same ones.
    """
    counted = (frame.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
               .groupBy("v").agg(F.count("*").alias("c")))
    last = counted.agg((F.sum("c") - 1).cast("double").alias("last"))
    size = F.floor(F.log2(F.greatest(F.abs("v"), F.lit(2.0 ** -1000))) * 64)
    placed = counted.select(
        "v", "c", last.select("last").scalar().alias("last"), F.lit(0).cast("long").alias("base"),
        F.when(F.col("v") < 0, -size - 200000).when(F.col("v") > 0, size + 200000)
        .otherwise(F.lit(0)).alias("cell"))

    def holds(before: Column, count: Column) -> Column:
        low, high = F.floor(F.col("last") * q), F.ceil(F.col("last") * q)
        return (low < before + count) & (high >= before)

    def narrowed(rows: DataFrame, within: list[str], part: str) -> DataFrame:
        """Rows of the parts that hold a wanted rank, with the count ahead of the part."""
        per_part = rows.groupBy(*within, part).agg(
            F.sum("c").alias("n"), F.min("base").alias("base"), F.min("last").alias("last"))
        line = Window.partitionBy(*within).orderBy(part)
        ahead = per_part.withColumn("ahead", F.col("base") + F.sum("n").over(line) - F.col("n"))
        wanted = ahead.where(holds(F.col("ahead"), F.col("n"))).select(*within, part, "ahead")
        # Two ranks lie in two parts at most, so this side is always tiny.
        return (rows.join(F.broadcast(wanted), [*within, part])
                .withColumn("base", F.col("ahead")).drop("ahead"))

    near = narrowed(placed, [], "cell")
    ends = near.groupBy("cell").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    step = F.try_divide(F.col("hi") - F.col("lo"), F.lit(float(cells)))
    place = F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), step)), F.lit(0))
    parted = near.join(F.broadcast(ends), "cell").withColumn(
        "part", F.least(place, F.lit(cells - 1)))
    inside = narrowed(parted, ["cell"], "part")
    within = F.sum("c").over(Window.partitionBy("cell", "part").orderBy("v")) - F.col("c")
    found = (inside.withColumn("before", F.col("base") + within)
             .where(holds(F.col("before"), F.col("c")))
             .agg(F.min("v").alias("a"), F.max("v").alias("b"), F.min("last").alias("last")))
    part = F.col("last") * q - F.floor(F.col("last") * q)
    return found.select((F.col("a") + (F.col("b") - F.col("a")) * part).alias("quantile"))


def running_before(frame: DataFrame, group: str, value: str, rank_by: str, tie: str,
                   out: str = "before") -> DataFrame:
    """Sum of ``value`` over the rows of ``group`` that rank ahead of each row.

    Rows rank by ``rank_by`` (not negative), highest first, then by the md5 of
    ``tie``, then by ``tie``. A group may be of any size, and so may its ties:
    it is split into bands of nearly equal ``rank_by``, a band into its values,
    and the rows of one value into 4096 parts by the first digits of the md5.
    Totals are accumulated level by level, and only the rows of a part are sorted.
    """
    rank = F.greatest(F.col(rank_by).cast("double"), F.lit(0.0))
    digest = F.md5(F.col(tie).cast("string").cast("binary"))
    banded = frame.withColumns({
        "_band": F.floor(F.log2(rank + 1) * 64).cast("int"), "_rank": rank, "_md5": digest,
        "_part": F.substring(digest, 1, 3)})

    def ahead(rows: DataFrame, keys: list[str], by: Column, name: str) -> DataFrame:
        line = Window.partitionBy(*keys).orderBy(by)
        return rows.withColumn(name, F.sum("_sum").over(line) - F.col("_sum"))

    def summed(rows: DataFrame, total: str, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum(total).alias("_sum"))

    parts = summed(banded, value, group, "_band", "_rank", "_part")
    ranks = summed(parts, "_sum", group, "_band", "_rank")
    bands = summed(ranks, "_sum", group, "_band")
    offsets = (
        ahead(parts, [group, "_band", "_rank"], F.col("_part"), "_a").drop("_sum")
        .join(ahead(ranks, [group, "_band"], F.col("_rank").desc(), "_b").drop("_sum"),
              [group, "_band", "_rank"])
        .join(ahead(bands, [group], F.col("_band").desc(), "_c").drop("_sum"), [group, "_band"])
        .select(F.col(group).alias("_g"), F.col("_rank").alias("_r"), F.col("_part").alias("_p"),
                (F.col("_a") + F.col("_b") + F.col("_c")).alias("_offset")))
    local = Window.partitionBy(group, "_rank", "_part").orderBy("_md5", tie)
    within = F.coalesce(F.sum(value).over(local.rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0))
    return (banded.withColumn("_within", within)
            .join(offsets, (F.col(group) == F.col("_g")) & (F.col("_rank") == F.col("_r"))
                  & (F.col("_part") == F.col("_p")))
            .withColumn(out, F.col("_offset") + F.col("_within"))
            .drop("_band", "_rank", "_md5", "_part", "_within", "_g", "_r", "_p", "_offset"))

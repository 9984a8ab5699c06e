"""Exact duplicate removal with two passes over a Bloom filter.

The first pass finds the filter positions that were hit more than once. In the
second pass a row whose positions are not all among them is unique for
certain and goes straight to the output. Only the others meet in a shuffle,
where the full digest decides, so the filter saves work and never changes a
result.

Defined cases: a null text is the empty text; a null id ranks behind every
other id; rows that repeat an id and a text count as one document each and
stay or go together; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.bloom import bitmaps, filter_bits, positions, with_maybe
from tillcast.llm.common import BLANKS, whole, with_group_facts, written


def squeezed(text: Column) -> Column:
    """The text without any blank."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def repeated_filter(rows: DataFrame, bits: int) -> DataFrame:
    """Bitmaps of the positions hit at least twice by ``rows._h``."""
    hit = rows.select(F.explode(F.array(*positions(F.col("_h"), bits))).alias("p"))
    return bitmaps(hit.groupBy("p").agg(F.count("*").alias("n")).where("n > 1"))


def maybe_repeated(rows: DataFrame, maps: DataFrame, bits: int) -> DataFrame:
    """Adds ``maybe``: false only if the row's hash occurs once."""
    return with_maybe(rows, F.col("_h"), maps, bits, "maybe")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    Of rows with the same text (blanks aside) the one with the most code
    points in its original text stays, then the smallest id. Texts are read
    once; what the passes share is an id, a length and a 32-byte digest.
    """
    text = whole(text_col)
    rows = written(docs.select(
        F.col(id_col).alias("_id"), F.char_length(text).alias("_len"),
        F.unhex(F.sha2(squeezed(text), 256)).alias("_sha"))
        .withColumn("_h", F.xxhash64("_sha")), "exact-rows")
    bits = filter_bits(rows.count())
    flagged = written(maybe_repeated(rows, repeated_filter(rows, bits), bits).drop("_h"),
                      "exact-flags")
    best = F.min(F.struct((-F.col("_len")).alias("l"), F.col("_id").isNull().alias("n"),
                          F.col("_id").alias("i")))
    grouped = with_group_facts(
        flagged.where("maybe"), "_sha", "_id",
        facts={"_n": F.count("*"), "_best": best},
        merge={"_n": F.sum("_n"), "_best": F.min("_best")})
    once = flagged.where("NOT maybe").select(
        "_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "_sha")
    many = grouped.select("_id", F.col("_best.i").alias("keep_id"),
                          F.col("_n").alias("group_size"), "_sha")
    return once.unionByName(many).select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"))

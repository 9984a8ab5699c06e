"""Line-level duplicate removal across documents.

Lines are exploded with their position and their keys hashed once, to 128 bits.
Distinct documents are counted per hash; a key found in enough documents loses
its lines everywhere but in the document with the smallest id. What comes back
to a row are the positions of the lines it loses, and the text is put together
again from the other positions, in time proportional to its lines.

Defined cases: a null or empty text is one empty line; rows with the same id
are one document for counting, and each is rewritten by its own text; a null id
is a document that ranks behind every other, its rows dealt out by their texts;
an empty table gives an empty result; further columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import BLANKS, ascii_lower, fresh, whole, with_group_facts, written


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def key_hash(line: Column, min_chars: int) -> Column:
    """128-bit hash of the line's key, null if the key is too short to count."""
    key = line_key(line)
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key)))


def row_key(text_col: str) -> Column:
    """Tells rows of one id apart by their texts."""
    return F.unhex(F.md5(whole(text_col)))


def lost_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int = 10,
               min_docs: int = 2) -> DataFrame:
    """``(_id, _row, _drop)``: the positions of the lines that the rows of an id and text lose."""
    # Keys of whole texts are found before the lines are dealt out, once per text.
    cut = docs.select(F.col(id_col).alias("_id"), row_key(text_col).alias("_row"),
                      F.split(whole(text_col), "\n").alias("_lines"))
    lines = cut.select("_id", "_row", F.posexplode("_lines").alias("_pos", "_line"))
    keyed = written(lines.select("_id", "_row", "_pos", key_hash(F.col("_line"), min_chars).alias("_k"))
                    .where("_k IS NOT NULL"), "line-keys")
    ranked = keyed.withColumn("_rank", F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i")))
    facts = {"_first": F.min("_rank"), "_last": F.max("_rank")}
    merge = {"_first": F.min("_first"), "_last": F.max("_last")}
    # Two documents are there if the smallest id is not the largest one; more are counted, and
    # then rows of one id stay in one part of a key.
    enough, spread = F.col("_first") != F.col("_last"), "_row"
    if min_docs > 2:
        facts["_docs"] = F.count_distinct("_id") + F.max(F.col("_id").isNull().cast("int"))
        merge["_docs"] = F.sum("_docs")
        enough, spread = F.col("_docs") >= min_docs, "_id"
    elif min_docs < 2:
        enough = F.lit(True)
    shared = with_group_facts(ranked, "_k", spread, facts, merge, keep=enough)
    return (shared.where(F.col("_rank") != F.col("_first"))
            .groupBy("_id", "_row").agg(F.collect_list("_pos").alias("_drop")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = 10, min_docs: int = 2, lines_col: str = "n_lines",
               dropped_col: str = "n_dropped") -> DataFrame:
    """The documents with rewritten text, plus line counts before and of the loss.

    A count whose name is taken gets underscores in front. A text whose lines all stay is
    returned as it is.
    """
    lines_col, dropped_col = fresh(docs, lines_col), fresh(docs, dropped_col)
    drops = lost_lines(docs, id_col, text_col, min_chars, min_docs)
    mine, row, text_key, lost, split, empty = (
        fresh(docs, c) for c in ("_mine", "_row", "_text_key", "_drop", "_lines", "_empty"))
    # The text goes through the join as its lines, so that it is cut once.
    keyed = docs.select(*[c for c in docs.columns if c != text_col], F.col(text_col).isNull().alias(empty),
                        F.split(whole(text_col), "\n").alias(split), row_key(text_col).alias(text_key))
    joined = keyed.join(drops.select(F.col("_id").alias(mine), F.col("_row").alias(row),
                                     F.col("_drop").alias(lost)),
                        keyed[id_col].eqNullSafe(F.col(mine)) & (F.col(text_key) == F.col(row)), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(lost))
    text = (F.when(F.col(empty), F.lit(None)).when(F.col(lost).isNull(), F.array_join(split, "\n"))
            .otherwise(F.array_join(F.transform(kept, lambda p: F.get(F.col(split), p)), "\n")))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.size(split).cast("long").alias(lines_col),
        F.when(F.col(lost).isNotNull(), F.size(split) - F.size(kept)).otherwise(F.lit(0))
        .cast("long").alias(dropped_col))

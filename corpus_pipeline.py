"""From raw documents to token ids: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as
Parquet and read again as the next stage's documents. All but the last return
the columns of ``docs``, further ones included. Decisions about single
documents come back through a Bloom filter of bounded size: texts that it
clears pass straight through, and only the others meet the decision in a join.

Defined cases: every stage takes null texts, ids and other columns, repeated
rows and empty tables. Rows that share an id are one document to the joins
that bring a decision back: a contaminated id takes all its rows along, and of
repeated rows one stays after the near-duplicate stage. Rows without an id
stay there unless a document with an id is in their group.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm import langid
from tillcast.llm.bloom import maybe_among
from tillcast.llm.bpe import encode
from tillcast.llm.common import fresh, table, written
from tillcast.llm.decontaminate import find_contamination
from tillcast.llm.line_dedup import line_dedup
from tillcast.llm.simhash import simhash_groups


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter) go; a missing ``lang`` is filled in,
    unless there is no labelled text to learn from."""
    model = langid.train(docs.where(~langid.held_out("doc_id", 5, 0)))
    if not model.langs:
        return langid.lettered(docs)
    name, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    named = langid.identify(docs, model, lang_name=name, score_name=score)
    kept = named.where(F.col(name) != langid.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", name)).select(docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds already go; no document does."""
    total, lost = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    cut = line_dedup(docs, lines_col=total, dropped_col=lost)
    size = F.when(F.col(lost) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", size).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id stays."""
    groups = written(simhash_groups(docs), "groups")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    keep = written(groups.where(stays).groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    doubtful = groups.where(~stays).select("doc_id").unionByName(
        keep.where("n > 1").select("doc_id")).distinct()
    maybe, mine, rows = (fresh(docs, c) for c in ("_maybe", "_kept", "_rows"))
    marked = maybe_among(docs, "doc_id", doubtful, maybe)
    sure = marked.where(~F.col(maybe)).select(docs.columns)
    kept = marked.where(maybe).join(
        keep.select(F.col("doc_id").alias(mine), F.col("n").alias(rows)),
        F.col("doc_id").eqNullSafe(F.col(mine)))
    once = kept.where((F.col(rows) == 1) | F.col(mine).isNull()).select(docs.columns)
    again = kept.where((F.col(rows) > 1) & F.col(mine).isNotNull()).select(docs.columns)
    return sure.unionByName(once).unionByName(again.dropDuplicates(["doc_id"]))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    maybe, mine = fresh(docs, "_maybe"), fresh(docs, "_hit")
    hit = written(found.where("contaminated").select(F.col("doc_id").alias(mine)).distinct(), "hits")
    marked = maybe_among(docs, "doc_id", hit, maybe)
    checked = marked.where(maybe).join(hit, F.col("doc_id").eqNullSafe(F.col(mine)), "left_anti")
    return marked.where(~F.col(maybe)).unionByName(checked).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` and whether decoding the ids gives the text again."""
    coded = encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", repeated_lines),
    ("simhash_dedup", near_duplicates),
    ("decontamination", contamination),
    ("bpe", tokens),
]

# Language identification, 64-bit XXH64 fingerprints and BPE have no SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Spelling variants of words by letter counts in blocked Gram matrices.

Two words that differ by one inserted or deleted letter have letter counts at
squared distance 1, by one replaced letter at 2. Words are dealt into blocks of
equal length and equal letter totals in ``GROUPS`` parts of the alphabet. One
edit moves a word to a block one longer or shorter, or to one of equal length
where at most one letter has changed part, so a block meets only those. For two
blocks a matrix product of their letter counts gives all squared distances; the
pairs at 2 or less are then checked for a single edit, letter by letter. Each
pair of words meets in exactly one pair of blocks.

A block holds about ``BLOCK_WORDS`` words or ``BLOCK_CHARS`` letters: where a
length and its totals have more, words are dealt by a hash, and all pairs of
those blocks are compared. What leaves a pair of blocks is, per word, the number
of its near words and the most frequent one, never the pairs themselves.

Defined cases: a null text has no words; a null id counts as the empty text in
the rule that damages runs; repeated rows count as often as they occur; among
equally frequent near words the first in code-point order is the form; words of
any length take part; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import ascii_lower, ship, with_group_facts, with_key_facts, written

# Common letters first, so that dealing them out in turn gives parts of about equal use.
LETTERS = "etaoinshrdlucmwfgypbvkjxqz" + "".join(map(chr, range(0xC0, 0x100)))
PLACE = np.array([max(0, LETTERS.find(chr(c))) for c in range(256)])
RUN = "[A-Za-zÀ-ÿ]+"
GROUPS = 5
BLOCK_WORDS, BLOCK_CHARS = 2048, 1 << 16
TILE = 1 << 19  # distances, or letters of candidates, held at a time

# Steps from a block to its partners, each pair of blocks from one side only: the same letter
# totals, one letter more in a part, or one letter moved from a part to an earlier one.
STEPS = [(0,) * GROUPS] + [
    tuple(int(g == i) - int(g == j) for g in range(GROUPS))
    for i in range(GROUPS) for j in (None, *range(i + 1, GROUPS))]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                damage: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """``word, n``: words of at least ``shortest`` letters with at least ``least`` occurrences.

    A run whose crc32 with its document's id is a multiple of ``damage`` loses a letter."""
    number = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(number.alias("d"), F.explode(
        F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("r"))
    runs = runs.select("d", ascii_lower(F.col("r")).alias("r"))
    coded = runs.select("r", F.crc32(F.concat("d", F.lit(":"), "r").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("r")).cast("int")
    cut = F.concat(F.substring("r", F.lit(1), at),
                   F.substring(F.col("r"), at + 2, F.char_length("r")))
    words = coded.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("r")).alias("word"))
    return (words.where(F.char_length("word") >= shortest).groupBy("word")
            .agg(F.count("*").alias("n")).where(F.col("n") >= least))


def _totals(word: Column) -> list[Column]:
    """Letters of the word in each part of the alphabet."""
    size, rest = F.char_length(word), []
    for g in range(GROUPS - 1):
        rest.append(size - F.char_length(F.translate(word, LETTERS[g::GROUPS], "")))
    return [*rest, size - sum(rest[1:], rest[0])]


def _cell(totals: list[Column]) -> Column:
    return F.concat_ws("-", *[t.cast("string") for t in totals])


def blocks(words: DataFrame) -> DataFrame:
    """``cell, part, totals, words, ns``: the words of a block with their counts."""
    placed = words.select("word", "n", F.array(*_totals(F.col("word"))).alias("totals"))
    placed = placed.withColumn("cell", _cell([F.col("totals")[g] for g in range(GROUPS)]))
    size = {"_rows": F.count("*"), "_chars": F.sum(F.char_length("word"))}
    sized = with_group_facts(placed, "cell", "word", size, {k: F.sum(k) for k in size})
    parts = F.ceil(F.greatest(F.col("_rows") / BLOCK_WORDS, F.col("_chars") / BLOCK_CHARS))
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int"))
    return dealt.groupBy("cell", "part").agg(
        F.min("totals").alias("totals"), F.collect_list(F.struct("word", "n")).alias("w")).select(
        "cell", "part", "totals", F.col("w.word").alias("words"), F.col("w.n").alias("ns"))


def block_pairs(packed: DataFrame) -> DataFrame:
    """``words, ns, words2, ns2, same``: every pair of blocks that may hold near words."""
    names = packed.select("cell", "part", "totals")
    steps = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in STEPS]))
    ahead = names.select("cell", "part", "totals", steps.alias("s")).select(
        F.col("cell").alias("c1"), F.col("part").alias("p1"),
        _cell([F.col("totals")[g] + F.col("s")[g] for g in range(GROUPS)]).alias("c2"))
    other = names.select(F.col("cell").alias("c2"), F.col("part").alias("p2"))
    named = ahead.join(other, "c2").where("c1 <> c2 OR p1 <= p2")
    first = packed.select(F.col("cell").alias("c1"), F.col("part").alias("p1"), "words", "ns")
    second = packed.select(F.col("cell").alias("c2"), F.col("part").alias("p2"),
                           F.col("words").alias("words2"), F.col("ns").alias("ns2"))
    return named.join(first, ["c1", "p1"]).join(second, ["c2", "p2"]).select(
        "words", "ns", "words2", "ns2", F.expr("c1 = c2 AND p1 = p2").alias("same"))


def letter_matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of words of one length as numbers, and how often each word has each letter."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    column = PLACE[codes.reshape(len(words), -1)]
    cells = (np.arange(len(words))[:, None] * len(LETTERS) + column).ravel()
    counts = np.bincount(cells, minlength=len(words) * len(LETTERS))
    # Squares up to 2^24 are whole in single precision.
    kind = np.float32 if column.shape[1] <= 2000 else np.float64
    return column, counts.reshape(len(words), len(LETTERS)).astype(kind)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` become those of ``b``, as long or one longer, by a single edit."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1)
    return head.sum(axis=1) + tail.sum(axis=1) >= a.shape[1]


def near_pairs(left: list[str], right: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of near words; the words of ``right`` are as long as those of ``left`` or one
    longer. With ``same`` both are one list and a pair is given once."""
    a, counts = letter_matrix(left)
    b, others = letter_matrix(right)
    # |x - y|^2 = x.x + y.y - 2 x.y as one product, over the letters that both sides have.
    both = counts.any(axis=0) & others.any(axis=0)
    one = np.ones((len(left), 1), counts.dtype), np.ones((len(right), 1), others.dtype)
    x = np.hstack([counts[:, both] * -2, (counts * counts).sum(axis=1, keepdims=True), one[0]])
    y = np.hstack([others[:, both], one[1], (others * others).sum(axis=1, keepdims=True)]).T
    found, rows = [], max(1, TILE // len(right))
    for at in range(0, len(left), rows):
        i, j = np.nonzero(x[at:at + rows] @ y <= 2)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        some = max(1, TILE // b.shape[1])
        for s in range(0, len(i), some):
            fits = one_edit(a[i[s:s + some]], b[j[s:s + some]])
            found.append((i[s:s + some][fits], j[s:s + some][fits]))
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate([none, *[f[0] for f in found]]),
            np.concatenate([none, *[f[1] for f in found]]))


def _summary(left: list[str], n: list[int], right: list[str], n2: list[int],
             same: bool) -> list[tuple[str, int, int, str]]:
    """Per word with near words in a pair of blocks: their number, and the most frequent one."""
    i, j = near_pairs(left, right, same)
    if not len(i):
        return []
    words, counts = left + right, n + n2
    j = j if same else j + len(left)
    used = np.unique(np.concatenate([i, j])).tolist()
    order = sorted(used, key=lambda k: (-counts[k], words[k]))
    rank = np.full(len(words), len(words), dtype=np.int64)
    rank[order] = np.arange(len(order))
    best = np.full(len(words), len(words), dtype=np.int64)
    np.minimum.at(best, i, rank[j])
    np.minimum.at(best, j, rank[i])
    total = np.bincount(np.concatenate([i, j]), minlength=len(words))
    return [(words[k], int(total[k]), counts[order[best[k]]], words[order[best[k]]]) for k in used]


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` for the words ``word, n`` that have near words."""
    packed = written(blocks(words), "spelling-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = [batch.column(c)[at].as_py() for c in range(5)]
                found = _summary(*row)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*found), (
                            pa.string(), pa.int64(), pa.int64(), pa.string()))],
                        ["word", "near", "best_n", "best"])

    parts = block_pairs(packed).mapInArrow(run, "word string, near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("r"), "best"))
    return parts.groupBy("word").agg(F.sum("near").alias("n_near"), top.alias("t")).select(
        "word", "n_near", (-F.col("t.r")).alias("best_n"), F.col("t.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for the words ``word, form``: the last word that forms lead to. The reach
    doubles each round; a form at least twice as frequent as its word keeps chains short, and
    no circle is possible."""
    found = written(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        known = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        ahead = found.select("root").distinct().join(known, "root", "left")
        jumped = written(with_key_facts(found, "root", "word", ahead), "spelling-roots")
        if jumped.where("_next IS NOT NULL").isEmpty():
            return jumped.select("word", "root")
        found = jumped.select("word", F.coalesce("_next", "root").alias("root"))


def spelling_variants(words: DataFrame, ratio: float = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the words ``word, n``."""
    words = written(words.select("word", "n"), "spelling-words")
    near = words.join(near_words(words), "word", "left")
    is_form = F.col("best_n") >= F.col("n") * ratio
    formed = written(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-formed")
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ship(__name__)

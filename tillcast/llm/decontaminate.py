"""Benchmark decontamination over a distributed positional inverted index.

1. A scan counts the test items' words in all documents.
2. Every window of an item is looked up by its two rarest words.
3. A second scan writes the index to the shared folder: per document and word
   the list of positions, for the words of the test items.
4. The list of a window's rarest word is intersected with that of its second
   rarest, shifted by their distance; then every other word of the item has to
   be in place. Runs of matching words at least as long as a window are hits.

Proximity: with ``slop``, documents are also named in which the two rarest words
of a window stand at their distance give or take ``slop`` words.

Steps 1 and 3 get the test words by broadcast up to ``MOST_TERMS`` words; the
second scan then leaves out documents in which no such pair stands at its
distance, give or take ``slop``: an index serves ``near_matches`` up to the slop
that it was written with. With more test words every word of every document is
counted and indexed: the same result from a larger index.

Defined cases: a null text has no words, so it hits nothing and, as an item, is
found nowhere; an item of fewer words than a window is one window; rows that
repeat an id are judged one by one; items that repeat an id are one item whose
windows are those of all its rows; a null item id counts as the empty text; an
empty table gives an empty result or no hits; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.llm.common import ship, written

SPAN = 10
MOST_TERMS = 500_000
_ROOM = 500_000  # words counted before partial counts leave a task

# Everything but digits, letters and non-ASCII characters separates words.
_KEEP = [*range(48, 58), *range(97, 123), *range(128, 256)]
_TABLE = bytes(b if b in _KEEP else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _row_key(number: int | None, text: str | None) -> bytes:
    """Rows with the same key have the same id and text, and so the same result."""
    raw = b"\0" if text is None else text.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(f"{number}|".encode() + raw, digest_size=16).digest()


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_item, _name, _n, pos, term)``: the words of every item."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                  strict=True):
                found = words(text)
                key = hashlib.blake2b(f"{name}|{text}".encode(), digest_size=16).digest()
                out[0] += [key] * len(found)
                out[1] += [name or ""] * len(found)
                out[2] += [len(found)] * len(found)
                out[3] += range(len(found))
                out[4] += [w.decode("utf-8", "replace") for w in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.binary()), pa.array(out[1], pa.string()),
                 pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()),
                 pa.array(out[4], pa.string())], ["_item", "_name", "_n", "pos", "term"])

    return items.select(F.col(id_col).cast("string"), text_col).mapInArrow(
        cut, "_item binary, _name string, _n int, pos int, term string").distinct()


def _counted(docs: DataFrame, wanted: frozenset[bytes] | None) -> DataFrame:
    """``(term, n)`` over all documents, for the wanted words or for all."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, found = shared.value, Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode("utf-8", "replace") for w in found], pa.string()),
                 pa.array(list(found.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for text in batch.column(0):
                said = words(text.as_py())
                found.update(said if keep is None else filter(keep.__contains__, said))
                if len(found) > _ROOM:
                    yield out()
                    found.clear()
        yield out()

    return docs.mapInArrow(count, "term string, n long").groupBy("term").agg(
        F.sum("n").alias("n"))


def windows(listed: DataFrame, counts: DataFrame, span: int = SPAN) -> DataFrame:
    """``(_item, p1, t1, p2, t2)``: the two rarest words of every window that can occur."""
    rated = listed.join(counts.withColumnRenamed("term", "_t"), F.col("term") == F.col("_t"), "left")
    rated = rated.withColumn("_w", F.struct(F.coalesce("n", F.lit(0)).alias("n"),
                                            F.col("term").alias("t"), F.col("pos").alias("p")))
    ahead = Window.partitionBy("_item").orderBy("pos").rowsBetween(0, span - 1)
    seen = rated.select("_item", "pos", "_n", F.array_sort(
        F.collect_list("_w").over(ahead)).alias("_ws"))
    full = seen.where((F.col("pos") <= F.col("_n") - span) | ((F.col("pos") == 0) & (F.col("_n") < span)))
    first, second = F.get("_ws", F.lit(0)), F.coalesce(F.get("_ws", F.lit(1)), F.get("_ws", F.lit(0)))
    return full.where(first["n"] > 0).select(
        "_item", first["p"].alias("p1"), first["t"].alias("t1"),
        second["p"].alias("p2"), second["t"].alias("t2")).distinct()


def _index(docs: DataFrame, wanted: frozenset[bytes] | None,
           pairs: dict[bytes, list[tuple[int, bytes]]] | None, slop: int = 0) -> DataFrame:
    """``(_row, _id, n_words, term, positions)``: postings, and one row per document
    without a word that holds its number of words. With ``pairs`` only documents in which
    a pair stands at its distance, give or take ``slop``, have postings."""
    shared = docs.sparkSession.sparkContext.broadcast((wanted, pairs))

    def hopeful(said: list[bytes], look: dict) -> bool:
        for p, word in enumerate(said):
            for apart, other in look.get(word, ()):
                at = p + apart
                if other in said[max(0, at - slop):max(0, at + slop + 1)]:
                    return True
        return False

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, look = shared.value
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), ([], [], [], [], [])

            def flush(out=out):
                made = pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()),
                     pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()),
                     pa.array(out[4], pa.list_(pa.int32()))],
                    ["_row", "_id", "n_words", "term", "positions"])
                for column in out:
                    column.clear()
                return made

            for number, value in zip(ids, batch.column(1), strict=True):
                text = value.as_py()
                said, key = words(text), _row_key(number, text)
                rows = [(None, None)]
                if look is None or hopeful(said, look):
                    places: dict[bytes, list[int]] = {}
                    for p, word in enumerate(said):
                        if keep is None or word in keep:
                            places.setdefault(word, []).append(p)
                    rows += [(w.decode("utf-8", "replace"), ps) for w, ps in places.items()]
                for term, positions in rows:
                    for column, x in zip(out, (key, number, len(said), term, positions), strict=True):
                        column.append(x)
                if len(out[0]) > 50_000:
                    yield flush()
            yield flush()

    return docs.mapInArrow(
        post, "_row binary, _id long, n_words long, term string, positions array<int>")


def near_matches(index: DataFrame, spots: DataFrame, slop: int = 0) -> DataFrame:
    """``(_row, _item, diag, off)``: places where a window's two rarest words stand at their
    distance give or take ``slop`` words; ``diag`` is where the item would begin.

    With slop 0 this is the first step of the phrase search, else a proximity match. The
    index has to be written with that slop or a larger one."""
    lists = index.where("term IS NOT NULL").select("_row", "term", "positions")
    one = lists.select(F.col("_row"), F.col("term").alias("t1"), F.explode("positions").alias("_p"))
    begun = one.join(spots, "t1").select(
        "_row", "_item", (F.col("_p") - F.col("p1")).alias("diag"), "p2", F.col("t2").alias("term"))
    place = F.col("diag") + F.col("p2")
    met = begun.join(lists, ["_row", "term"])
    if slop == 0:
        return met.where(F.array_contains("positions", place)).select(
            "_row", "_item", "diag", F.lit(0).alias("off")).distinct()
    offs = F.filter(F.transform("positions", lambda p: p - place), lambda d: F.abs(d) <= slop)
    return (met.select("_row", "_item", "diag", F.array_min(F.transform(offs, F.abs)).alias("off"))
            .where("off IS NOT NULL").groupBy("_row", "_item", "diag").agg(F.min("off").alias("off")))


def phrase_runs(index: DataFrame, listed: DataFrame, starts: DataFrame, span: int = SPAN) -> DataFrame:
    """``(_row, _name, begin, end)``: runs of item words in place, as document positions."""
    lists = index.where("term IS NOT NULL").select("_row", "term", "positions")
    hoped = starts.select("_row", "_item", "diag").join(listed, "_item")
    place = F.col("diag") + F.col("pos")
    met = hoped.join(lists, ["_row", "term"]).where(F.array_contains("positions", place)).select(
        "_row", "_item", "_name", "_n", "diag", "pos").distinct()
    line = Window.partitionBy("_row", "_item", "diag").orderBy("pos")
    runs = met.withColumn("_run", F.col("pos") - F.row_number().over(line)).groupBy(
        "_row", "_item", "diag", "_run").agg(
        F.first("_name").alias("_name"), F.first("_n").alias("_n"), F.count("*").alias("_c"),
        F.min(place).alias("begin"), F.max(place).alias("end"))
    return runs.where(F.col("_c") >= F.least(F.col("_n"), F.lit(span))).select(
        "_row", "_name", "begin", "end")


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id",
                       item_text: str = "text", span: int = SPAN, slop: int = 0) -> DataFrame:
    """One row per document: ``id, n_words, n_hit, n_items, items`` (sorted item ids),
    ``contaminated``; with ``slop`` also ``n_near, near_items``, the proximity matches."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    listed = written(item_words(items, item_col, item_text), "items")
    terms = listed.select("term").distinct()
    small = terms.count() <= MOST_TERMS
    wanted = frozenset(r.term.encode() for r in terms.collect()) if small else None
    spots = written(windows(listed, _counted(rows.select("_text"), wanted), span), "windows")
    pairs = None
    if small:  # at most as many windows as test words, unless words repeat a lot
        small_pairs = spots.select("t1", (F.col("p2") - F.col("p1")).alias("d"), "t2").distinct()
        if small_pairs.count() <= MOST_TERMS:
            pairs = {}
            for r in small_pairs.collect():
                pairs.setdefault(r.t1.encode(), []).append((r.d, r.t2.encode()))
    index = written(_index(rows, wanted, pairs, slop), "postings")
    runs = written(phrase_runs(index, listed, near_matches(index, spots), span), "runs")
    covered = runs.select("_row", F.explode(F.sequence("begin", "end")).alias("p")).distinct()
    hits = covered.groupBy("_row").agg(F.count("*").alias("n_hit")).join(
        runs.groupBy("_row").agg(F.array_sort(F.collect_set("_name")).alias("items")), "_row")
    found = index.where("term IS NULL").select("_row", "_id", "n_words").join(hits, "_row", "left")
    near: list[Column] = []
    if slop:
        met = near_matches(index, spots, slop).select("_row", "_item").distinct()
        names = met.join(listed.select("_item", "_name").distinct(), "_item").groupBy("_row").agg(
            F.array_sort(F.collect_set("_name")).alias("near_items"))
        found = found.join(names, "_row", "left")
        near = [F.coalesce(F.size("near_items"), F.lit(0)).cast("long").alias("n_near"),
                F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items")]
    return found.select(
        F.col("_id").alias(id_col), "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), *near)


ship(__name__)

"""Near-duplicate groups by SimHash with pigeonring candidate filtering.

Fingerprints of 64 bits are cut into eight segments on a ring. If two differ
in at most ``R = 3`` bits, some segment starts a chain of consecutive
segments whose running number of differences never exceeds ``k * R / 8``
after ``k`` segments. Rounded down, those budgets are 0, 0, 1, 1, 1, 2, 2, 3.
The first five steps say: two segments agree, and of the next three at least
two agree. So every start gives three exact 32-bit keys, and two linked
fingerprints share a key: only such pairs get the full Hamming check.

A bucket passes on what its links connect, as stars, not all pairs. Buckets with
more than ``CROWD`` fingerprints are split exactly: the other 32 bits differ
in at most 3 bits too, so of eight 4-bit blocks five agree. The split buckets
share 52 bits and hold 4096 fingerprints at most.

Defined cases: a null text and a text without words have fingerprint zero,
linked like any other; fewer words than a shingle make one shingle; equal
fingerprints are one node, so copies and repeated rows cost nothing more; a
null id gets a class like any row but never names one unless all ids of the
class are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import (
    SALTS,
    UPPER,
    salt_of,
    ship,
    with_group_facts,
    with_key_facts,
    written,
)

R, SEGMENTS, WIDTH, SEED = 3, 8, 8, 42
CROWD = 1500
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_MASK = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i:i + size]), SEED)
                          for i in range(len(words) - size + 1)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for texts of any length
        block = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in range(64) if 2 * int(ones[i]) > len(hashes))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))],
                                         ["_id", "_fp"])


def _keys(fp: str = "_fp") -> list:
    """24 keys: start and choice above, the four agreeing segments below."""
    def segment(i: int):
        return F.shiftrightunsigned(F.col(fp), WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit(255))

    keys = []
    for start in range(SEGMENTS):
        for which, pair in enumerate(combinations((2, 3, 4), 2)):
            key = F.lit(start * 3 + which).cast("long")
            for i in (0, 1, *pair):
                key = F.shiftleft(key, WIDTH).bitwiseOR(segment(start + i))
            keys.append(key)
    return keys


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """What the bucket's links connect, as pairs of the smallest fingerprint and each other one.

    Breadth first: each step compares one fingerprint with those not reached
    yet, so memory is one row of the bucket's matrix."""
    links, waiting = [], np.arange(len(fps))
    while len(waiting) > 1:
        front, waiting = [waiting[0]], waiting[1:]
        tree = front.copy()
        while front and len(waiting):
            at = front.pop()
            near = _distance(fps[waiting], fps[at]) <= R
            reached = waiting[near]
            tree += list(reached)
            front += list(reached)
            waiting = waiting[~near]
        least = int(fps[tree].min())
        links += [(least, fp) for fp in fps[tree].tolist() if fp != least]
    return links


def _linker(crowd: int | None):
    """Reads rows sorted by key; emits links, or the rows of buckets above ``crowd``."""
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind, rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), kind, dtype=np.int32)), pa.array(rows[:, 0].copy()),
                 pa.array(rows[:, 1].copy())], ["kind", "a", "b"])

        held = np.empty((0, 2), dtype=np.int64)  # the unfinished last bucket
        crowded = None  # key of a bucket found too large; its rows stream through

        def close(block):
            starts = np.flatnonzero(np.r_[True, block[1:, 0] != block[:-1, 0]])
            ends = np.r_[starts[1:], len(block)]
            many, links = [], []
            two = starts[ends - starts == 2]  # most buckets: all at once
            near = two[_distance(block[two, 1], block[two + 1, 1])
                       <= R] if len(two) else two
            links += zip(block[near, 1].tolist(), block[near + 1, 1].tolist(), strict=True)
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                if crowd is not None and e - s > crowd:
                    many.append(block[s:e])
                else:
                    links += forest(block[s:e, 1].copy())
            if links:
                yield out(0, np.array(links, dtype=np.int64))
            for rows in many:
                yield out(1, rows)

        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1).astype(np.int64)
            if crowded is not None:
                same = rows[:, 0] == crowded
                if same.any():
                    yield out(1, rows[same])
                rows = rows[~same]
                if not len(rows):
                    continue
                crowded = None
            block = np.concatenate([held, rows])
            last = np.searchsorted(block[:, 0], block[-1, 0])
            held = np.ascontiguousarray(block[last:])
            if last:
                yield from close(np.ascontiguousarray(block[:last]))
            if crowd is not None and len(held) > crowd:
                crowded = int(held[0, 0])
                yield out(1, held)
                held = np.empty((0, 2), dtype=np.int64)
        if len(held):
            yield from close(held)
    return link


def _linked(keyed: DataFrame, crowd: int | None) -> DataFrame:
    rows = keyed.repartition("_key").sortWithinPartitions("_key").select("_key", "_fp")
    return rows.mapInArrow(_linker(crowd), "kind int, a long, b long")


def links(nodes: DataFrame) -> DataFrame:
    """``(a, b)`` over distinct fingerprints ``_fp``: connects all that a chain
    of links within R bits connects."""
    keyed = nodes.select("_fp", F.explode(F.array(*_keys())).alias("_key"))
    first = written(_linked(keyed, CROWD), "simhash-links")
    pairs = first.where("kind = 0").select("a", "b")
    crowded = first.where("kind = 1").select(F.col("a").alias("_top"), F.col("b").alias("_fp"))
    if not crowded.isEmpty():
        # The old key and five of the eight 4-bit blocks outside it, hashed together: a clash
        # of hashes only adds candidates, which are checked.
        choice = F.shiftrightunsigned("_top", 32).cast("int")
        masks = F.array(*[F.array(*[F.lit(m) for m in _rest_masks(c)])
                          for c in range(SEGMENTS * 3)])
        split = crowded.select("_fp", "_top", F.posexplode(
            F.element_at(masks, choice + 1)).alias("_w", "_m"))
        split = split.select("_fp", F.xxhash64(
            "_top", "_w", F.col("_fp").bitwiseAND(F.col("_m"))).alias("_key"))
        pairs = pairs.unionByName(
            written(_linked(split, None), "simhash-split").select("a", "b"))
    return pairs


def _rest_masks(choice: int) -> list[int]:
    """For a key, masks of five of the eight half-segments that the key leaves open."""
    start, which = divmod(choice, 3)
    used = {(start + i) % SEGMENTS for i in (0, 1, *list(combinations((2, 3, 4), 2))[which])}
    halves = [b for s in range(SEGMENTS) if s not in used for b in (8 * s, 8 * s + 4)]
    masks = [sum(15 << b for b in five) for five in combinations(halves, 5)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def components(pairs: DataFrame) -> DataFrame:
    """``(node, component)`` for all linked nodes; a component is named by its smallest node.

    Alternating stars: every node hangs its larger, then its smaller
    neighbours on the smallest one it knows, until all hang on one that hangs
    on none. Each round is two tables in the shared folder."""
    edges = written(pairs.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = written(_star(both, larger=True), "stars")
        edges = written(_star(edges, larger=False), "stars")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(edges.select(F.col("v").alias("node"),
                                      F.col("v").alias("component"))).distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether no node hangs on two others, or on one that hangs itself."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    seen = ends.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return seen.where("hangs > 1 OR (hangs = 1 AND holds = 1)").count() == 0


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Large star: neighbours above u move to the smallest neighbour of u (or u).
    Small star, where all neighbours are below: u and its neighbours move to the smallest of them."""
    # The minimum goes back to rows keyed (u, salt): a hub's rows are dealt out. A bit for each
    # salt tells which ones u has, so that one aggregation finds both.
    salted = pairs.withColumn("_salt", salt_of("v"))
    low = salted.groupBy("u").agg(F.min("v").alias("_m"),
                                  F.expr("bit_or(shiftleft(1L, _salt))").alias("_held"))
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("_held", s) == 1)
    back = low.select(F.col("u").alias("_u"), "_m", F.explode(salts).alias("_s"))
    joined = salted.join(back, (F.col("u") == F.col("_u")) & (F.col("_salt") == F.col("_s")))
    if larger:  # as many rows as links; the small star drops repeated ones
        return joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "_m").alias("v"))
    moves = F.when(F.col("v") == F.col("_m"), F.col("u")).otherwise(F.col("v"))
    return joined.select(moves.alias("u"), F.col("_m").alias("v")).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, fingerprint`` (16 hex digits), ``component_id``
    (smallest id reachable over links, its own included)."""
    rows = written(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(
        _fingerprints, "_id long, _fp long"), "simhash-rows")
    nodes = written(rows.groupBy("_fp").agg(F.min("_id").alias("_least")), "simhash-nodes")
    found = components(links(nodes))
    rooted = nodes.join(found, F.col("_fp") == F.col("node"), "left").select(
        "_fp", "_least", F.coalesce("component", "_fp").alias("_root"))
    named = with_group_facts(rooted, "_root", "_fp", facts={"_name": F.min("_least")},
                             merge={"_name": F.min("_name")}).select("_fp", "_name")
    return with_key_facts(rows, "_fp", "_id", named).select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_name").alias("component_id"))


ship(__name__)

"""Quality scores from a logistic regression over hashed word n-grams.

Words and runs of other signs are hashed; single ones and neighbouring pairs
count, as shares of the text, in one of ``SIZE`` weights. Training follows the
regularised leader: per weight it keeps the sum of adjusted gradients and of
squared gradients, from which the weight follows in closed form, with small
weights exactly zero. A score is one sparse dot product.

The model is fitted on a bounded sample of the labelled rows (``SAMPLE_ROWS``
rows of at most ``SAMPLE_CHARS`` code points each, picked by a hash of the id,
so that labels keep their shares); scoring reads every text whole.

Defined cases: a null or empty text has no features, so its score is that of
the bias alone; labels other than 0 and 1 and null labels are not learnt from;
an id that is labelled twice counts once per label row; without any training
row every score is 0.5; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.common import ship

SIZE = 1 << 18
SAMPLE_ROWS, SAMPLE_CHARS = 8000, 20_000
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 1e-4, 1e-4, 4
THRESHOLD = 0.7
BLOCK = 1 << 18  # characters hashed at a time
_PART = re.compile(rb"[A-Z]+|[a-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x20\n\t\r]+|\n")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the weights and the share of the text that each holds; index 0 is the bias."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    hashes = np.fromiter(map(zlib.crc32, _PART.findall(raw)), dtype=np.uint32)
    if not len(hashes):
        return np.zeros(1, np.int64), np.ones(1)
    pairs = hashes[:-1] * np.uint32(0x9E3779B1) + hashes[1:]
    pairs = (pairs ^ (pairs >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    both = np.concatenate([hashes, pairs ^ (pairs >> np.uint32(13))]) % np.uint32(SIZE - 1) + 1
    index, count = np.unique(both, return_counts=True)
    value = np.sqrt(count / len(hashes))
    return np.r_[0, index.astype(np.int64)], np.r_[1.0, value]


class Leader:
    """Follow-the-regularised-leader with one rate per weight."""

    def __init__(self, size: int = SIZE):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, index: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        rate = (BETA + np.sqrt(n)) / ALPHA + L2
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / rate)

    def update(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        slope = (logistic(float(w @ value)) - label) * value
        grown = self.n[index] + slope * slope
        self.z[index] += slope - (np.sqrt(grown) - np.sqrt(self.n[index])) / ALPHA * w
        self.n[index] = grown


def logistic(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[str, int]]) -> np.ndarray:
    """Weights learnt from (text, label) rows in the given order, ``PASSES`` times."""
    leader = Leader()
    ready = [(*features(text), label) for text, label in rows]
    for _ in range(PASSES):
        for index, value, label in ready:
            leader.update(index, value, label)
    return leader.weights().astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id",
           text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    marked = (labels.where(F.col(label_col).isin(0, 1))
              .select(F.col(id_col).alias("_i"), F.col(label_col).cast("int").alias("_y")))
    place = F.pmod(F.xxhash64("_i"), F.lit(1 << 20)) / (1 << 20)
    share = min(1.0, 1.5 * rows / max(1, marked.count()))
    picked = marked.withColumn("_place", place).where(F.col("_place") < share)
    texts = docs.where(F.char_length(text_col) <= SAMPLE_CHARS).select(
        F.col(id_col).alias("_d"), F.col(text_col).alias("_t"))
    found = texts.join(picked, F.col("_d") == F.col("_i")).select("_t", "_y", "_place").collect()
    ordered = sorted(found, key=lambda r: (r["_place"], r["_t"], r["_y"]))
    return [(r["_t"], r["_y"]) for r in ordered[:rows]]


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text",
          score_name: str = "score") -> DataFrame:
    """All columns of ``docs`` plus the score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    where = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            found = []
            for text in batch.column(where):
                index, value = features(text.as_py())
                found.append(float(logistic(float(w[index] @ value))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64())], schema.fieldNames())

    return docs.mapInArrow(run, schema)


ship(__name__)

"""Embedding whitening from a covariance over distinct vectors.

Vectors are brought to whole numbers, and identical ones become one fit row
whose weight is one or the number of its copies. Two passes over the fit rows
give the exact sums, then the covariance as weighted matrix products of centred
rows: a task adds up one matrix and passes on its rows, which are added per
matrix row. The eigenvectors of that matrix, whose size depends on the
dimension alone, are found on the driver. Every distinct vector is whitened
once and the result joins back to all rows with that vector, hot ones dealt out
over salts.

Defined cases: rows whose vector is null or holds a null or non-finite entry are
dropped, as are vectors (empty ones included) whose length is not the most common
one, the greater of equally common ones; entries are kept within 2^40 in units of
1/64; repeated rows and ids give a row each; equal eigenvalues keep the order in
which they are found; a component without variance has a null ``whitened``, and
is left out of ``identity_error``, which is null if none has any; a deviation
that no long can hold is null; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.common import ship, with_key_facts, written

SCALE, OFFSET, REACH = 64, 1_000_000, 1 << 40
COMPONENTS = 16
FLAT = 1e-13  # share of the total variance below which a component has none


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``_id, _x, _hash``: usable vectors as whole numbers, with a digest to join by."""
    values = F.col(vec_col).cast("array<double>")
    sound = F.forall(values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(values, lambda c: F.floor(F.greatest(F.lit(-float(REACH)), F.least(
        F.lit(float(REACH)), c * SCALE))).cast("long") + OFFSET)
    kept = rows.where(F.col(vec_col).isNotNull() & sound).select(
        F.col(id_col).alias("_id"), scaled.alias("_x"))
    return kept.withColumn("_hash", F.unhex(F.sha2(F.array_join(
        F.col("_x").cast("array<string>"), ","), 256)))


def _vectors(column: pa.Array, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind, copy=False)


def exact_sums(x: np.ndarray, weight: np.ndarray) -> list[int]:
    """Weighted sums of whole numbers, whatever their size."""
    if float(np.abs(x).max(initial=0)) * float(weight.sum()) < 2.0 ** 62:
        return (weight @ x).tolist()
    return (weight.astype(object) @ x.astype(object)).tolist()


def deviations(x: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Exact sums of squares of ``n * x - rest``."""
    if float(np.abs(x).max(initial=0)) * n < 2.0 ** 61:
        gap = x * n - np.array(rest, dtype=np.int64)
        if (gap.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < 2.0 ** 62:
            return (gap * gap).sum(axis=1).tolist()
    found = [sum((int(v) * n - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in found]


class Centre:
    """The exact mean as whole parts and fractions, so that centring rounds once."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = [s // n for s in sums]
        self.rest = [s - w * n for s, w in zip(sums, self.whole, strict=True)]
        self.base = np.array(self.whole, dtype=np.int64)
        self.fraction = np.array([r / n for r in self.rest])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.fraction


def weighted_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Total weight and exact sum per dimension of the fit rows ``_x, _w``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                weight = batch.column(1).to_numpy()
                part = exact_sums(_vectors(batch.column(0), np.int64), weight)
                total += int(weight.sum())
                sums = part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
        if sums is not None:
            exact = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([total]), pa.array([[Decimal(s) for s in sums]], pa.list_(exact))],
                ["w", "s"])

    parts = written(fit.select("_x", "_w").mapInArrow(run, "w long, s array<decimal(38,0)>"), "sums")
    places = parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    sums = {r["i"]: int(r["v"]) for r in places.collect()}
    return parts.agg(F.sum("w")).first()[0], [sums[i] for i in range(len(sums))]


def covariance(fit: DataFrame, vec: str, weight: str, n: int,
               centred: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray:
    """Weighted covariance, divisor ``n``, as a sum of the tasks' products of centred rows."""
    row = pa.list_(pa.float64())

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                c = centred(_vectors(batch.column(0), kind))
                part = (c * batch.column(1).to_numpy()[:, None]).T @ c
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), row)], ["i", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), _vectors(batch.column(1), np.float64)
                            if batch.num_rows else []):
                sums[i] = sums[i] + v if i in sums else v.copy()
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], row)],
                ["i", "v"])

    schema = "i int, v array<double>"
    found = (fit.select(vec, weight).mapInArrow(products, schema).repartition("i")
             .mapInArrow(added, schema).collect())
    return np.array([r["v"] for r in sorted(found, key=lambda r: r["i"])]) / n


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by size, unit eigenvectors as columns, and which have variance."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[top, np.arange(len(values))] < 0, -1.0, 1.0)
    return values, vectors, values > max(np.trace(cov), 0) * FLAT


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           most: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` per usable row.

    ``weights``: ``one`` takes each distinct vector once, ``count`` as often as it occurs."""
    spark = rows.sparkSession
    usable = whole_vectors(rows, id_col, vec_col)
    length = usable.groupBy(F.size("_x").alias("d")).count().orderBy(
        F.desc("count"), F.desc("d")).first()
    schema = T.StructType([rows.schema[id_col], *T.StructType.fromDDL(
        "component int, n long, deviation long, whitened double, explained double, "
        "identity_error double").fields])
    if length is None or length["d"] == 0:
        return spark.createDataFrame([], schema)
    usable = usable.where(F.size("_x") == length["d"])
    weight = F.count("*") if weights == "count" else F.lit(1).cast("long")
    fit = written(usable.groupBy("_hash", "_x").agg(weight.alias("_w")), "whitening-fit")
    n, sums = weighted_sums(fit)
    centre = Centre(n, sums)
    cov = covariance(fit, "_x", "_w", n, centre, np.int64)
    values, vectors, varies = components(cov, most)
    turn = vectors / np.sqrt(np.where(varies, values, 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(1), np.int64)
                white = centre(x) @ turn
                flat = pa.array(white.ravel(), mask=~np.broadcast_to(varies, white.shape).ravel())
                ends = pa.array(range(0, white.size + 1, white.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(
                        deviations(x - centre.base, n, centre.rest), pa.int64()),
                     pa.ListArray.from_arrays(ends, flat)], ["_hash", "_w", "_dev", "_white"])

    done = written(fit.select("_hash", "_x", "_w").mapInArrow(
        run, "_hash binary, _w long, _dev long, _white array<double>"), "whitened")
    used = int(varies.sum())
    error = None
    if used:
        kept = done.select(F.slice("_white", 1, used).alias("_white"), "_w")
        means = kept.agg(*[F.sum(F.col("_white")[i] * F.col("_w")).alias(f"m{i}")
                           for i in range(used)]).first()
        mean = np.array(list(means)) / n
        spread = covariance(kept, "_white", "_w", n, lambda v: v - mean, np.float64)
        error = float(np.abs(spread - np.eye(used)).max())
    total = float(np.trace(cov))
    shares = [float(v) / total if total > 0 else 0.0 for v in np.where(varies, values, 0.0)]
    back = with_key_facts(usable.select("_id", "_hash"), "_hash", "_id", done.drop("_w"))
    out = back.select("_id", "_dev", F.posexplode("_white").alias("_c", "whitened"))
    return out.select(
        F.col("_id").alias(id_col), (F.col("_c") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"), F.col("_dev").alias("deviation"), "whitened",
        F.get(F.array(*map(F.lit, shares)), F.col("_c")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))


ship(__name__)

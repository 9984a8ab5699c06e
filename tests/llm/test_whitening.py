"""Whitening against plain numpy and whole-number arithmetic."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from tillcast.llm import whitening
from tillcast.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def check(rows, vectors, weights="one", most=16):
    """All rows of a result against the vectors ``(id, entries)`` they come from."""
    usable = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in vectors]
    kinds = sorted({x for _, x in usable})
    copies = [sum(x == y for _, y in usable) for x in kinds] if weights == "count" else [1] * len(kinds)
    n, sums = sum(copies), [sum(w * x[d] for w, x in zip(copies, kinds)) for d in range(len(kinds[0]))]
    fit, weight = np.array(kinds, dtype=float), np.array(copies, dtype=float)
    centred = fit - np.array(sums) / n
    cov = (centred * weight[:, None]).T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    size = min(most, len(sums))
    assert len(rows) == len(usable) * size
    white = {}
    for r in rows:
        white.setdefault((r.vec_id, r.deviation), {})[r.component] = r.whitened
        assert r.n == n and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9
        assert r.identity_error < 1e-8
    found, base = [], []
    for i, x in usable:
        deviation = sum((n * v - s) ** 2 for v, s in zip(x, sums))
        found.append([white[i, deviation][c] for c in range(1, size + 1)])
        base.append(np.array(x) - np.array(sums) / n)
    # One linear map for all rows, along eigenvectors: it takes the covariance to one.
    turn, *_ = np.linalg.lstsq(np.array(base), np.array(found), rcond=None)
    assert np.allclose(np.array(base) @ turn, found, atol=1e-8)
    assert np.allclose(turn.T @ cov @ turn, np.eye(size), atol=1e-8)
    assert np.allclose(cov @ turn, turn * values[:size], rtol=1e-6, atol=1e-6 * values[0])


def test_query_on_the_whole_table(spark):
    stored = pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()
    vectors = [(r["vec_id"], r["embedding"]) for r in stored if r["embedding"] is not None and all(
        c is not None and math.isfinite(c) for c in r["embedding"])]
    check(QUERIES["op12_whitening"](spark, SMALL).collect(), vectors)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_copies_nulls_and_clashing_columns(spark, weights):
    pick = np.random.default_rng(3)
    hot = [float(v) for v in pick.normal(size=5)]
    good = [(i, [float(v) for v in pick.normal(size=5) * (1, 5, 1, 9, 2)]) for i in range(60)]
    good += [(100 + i, hot) for i in range(90)] + [(7, hot), (None, good[0][1])]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, []),
           (204, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0])]
    frame = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").selectExpr(
        "*", "1 AS _hash", "2 AS _x", "3 AS component", "4 AS n").repartition(5)
    check(whitening.whiten(frame, weights=weights).collect(), good, weights)
    check(whitening.whiten(frame, weights=weights, most=2).collect(), good, weights, 2)


def test_flat_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert sorted((r.vec_id, r.component) for r in one) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, 0.0, None)
               for r in one)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 5.0]) for i in range(9)], schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in line)
    for rows in ([], [(1, None)], [(1, [])]):
        none = whitening.whiten(spark.createDataFrame(rows, schema))
        assert none.count() == 0 and none.columns == one[0].__fields__


def test_exact_whole_numbers():
    x = np.array([[1 << 50, -(1 << 50)], [3, 4]], dtype=np.int64)
    weight = np.array([1 << 20, 7], dtype=np.int64)
    assert whitening.exact_sums(x, weight) == [(1 << 70) + 21, -(1 << 70) + 28]
    assert whitening.exact_sums(x[1:], weight[1:]) == [21, 28]
    assert whitening.deviations(x, 10, [5, 6]) == [None, 25 ** 2 + 34 ** 2]
    large = [(30 * 10 ** 7 - 5) ** 2 + (40 * 10 ** 7 - 6) ** 2]
    assert whitening.deviations(x[1:] * 10 ** 7, 10, [5, 6]) == large

"""Quality scores: held-out accuracy, the update rule against a plain one, hard cases."""

import math

import numpy as np
import pytest

from tillcast.llm import quality
from tillcast.llm.registry import QUERIES

MID = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    rows = QUERIES["op6_quality"](spark, MID).collect()
    assert len(rows) == spark.read.parquet(f"{MID}/documents.parquet").count()
    tested = [r for r in rows if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in tested) / len(tested)
    common = sum(truth[r.doc_id] for r in tested) / len(tested)
    assert right >= max(0.93, common)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_update_equals_plain_rule():
    rng = np.random.default_rng(0)
    leader, z, n = quality.Leader(6), [0.0] * 6, [0.0] * 6
    for _ in range(50):
        index = np.sort(rng.choice(6, 3, replace=False))
        value, label = rng.random(3), int(rng.integers(2))
        w = [0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / (
            (quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2) for i in range(6)]
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(index, value, strict=True))))
        for i, v in zip(index, value, strict=True):
            g = (p - label) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
            n[i] += g * g
        leader.update(index, value, label)
    assert leader.z == pytest.approx(z) and leader.n == pytest.approx(n)


def test_null_empty_long_and_empty_table(spark, docs):
    weights = quality.fit([("good words here", 1), ("BAD!! BAD!!", 0)] * 20)
    frame = docs([(1, None), (2, ""), (3, "BAD!! " * 60000), (None, "good words"), (3, "x")])
    got = {(r.doc_id, r.text and r.text[:3]): r.score for r in quality.score(frame, weights).collect()}
    assert got[1, None] == got[2, ""] and got[3, "BAD"] < 0.5 < got[None, "goo"]
    assert quality.score(frame.limit(0), weights).count() == 0
    labels = spark.createDataFrame([(1, None), (2, 5)], "doc_id long, quality int")
    assert quality.sample(frame, labels, "quality") == []
    assert quality.score(frame, quality.fit([])).first().score == 0.5

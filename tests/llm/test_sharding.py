"""Shards against a plain sort, with hot groups, ties and loose tolerances."""

import random
import zlib

import pytest

from tillcast.llm import sharding
from tillcast.llm.registry import ORACLE, QUERIES
from tools.check import compare, connect

SMALL = "/root/testdata/sf0.001"


def plain(texts, shards=8):
    """Shard and slot of every row, by the middle of its bytes in key order."""
    sized = [(zlib.crc32((t or "").encode()), i is not None, i, len((t or "").encode()) + 1)
             for i, t in texts]
    total, below, rows, slots = sum(r[3] for r in sized), 0, [], [0] * shards
    for crc, _, number, size in sorted(sized, key=lambda r: (r[0], r[1], r[2] or 0)):
        shard = (2 * below + size) * shards // (2 * total)
        rows.append((str(number), size, crc, shard, slots[shard]))
        slots[shard] += 1
        below += size
    return sorted(rows)


def as_rows(frame):
    return sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in frame.collect())


def mixed():
    pick = random.Random(5)
    texts = [(i, "w" * pick.randint(0, 200) + str(pick.randint(0, 400))) for i in range(500)]
    texts += [(pick.choice([-(1 << 62), 1 << 62]) + i, "the same text") for i in range(400)]
    texts += [(9, "the very same row")] * 300 + [(10, None), (11, ""), (None, "no id"), (None, "no id")]
    return texts


def test_query_equals_sql(spark):
    got = QUERIES["op13_sharding"](spark, SMALL).toArrow()
    assert compare(got, connect(SMALL).execute(ORACLE["op13_sharding"]).to_arrow_table()) is None


@pytest.mark.parametrize(("shards", "probes"), [(8, 256), (3, 2), (1, 256)])
def test_equals_plain_sort(docs, monkeypatch, shards, probes):
    monkeypatch.setattr(sharding, "PROBES", probes)
    texts = mixed()
    assert as_rows(sharding.shard_documents(docs(texts), shards)) == plain(texts, shards)


def test_one_row_heavier_than_all_others(docs):
    for texts in ([(1, "x" * 100_000), *[(i, "small") for i in range(2, 30)]], [(1, "alone")],
                  [(1, "same")] * 5, [(1, "a"), (2, "b")], [(3, None)]):
        assert as_rows(sharding.shard_documents(docs(texts))) == plain(texts)
    assert sharding.shard_documents(docs([(1, "x")]).limit(0)).count() == 0


def test_tolerance_bounds_every_cut(docs):
    texts = mixed()
    total = sum(len((t or "").encode()) + 1 for _, t in texts)
    rows = sharding.shard_documents(docs(texts), tolerance=0.2).collect()
    sizes, slots = [0] * 8, [[] for _ in range(8)]
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots)
    for i in range(1, 8):
        assert abs(sum(sizes[:i]) - i * total / 8) <= 0.2 * total / 8 / 2 + 220


def test_few_rounds_of_few_counts(docs, monkeypatch):
    """A round brings 256 parts at most per splitter, and each one narrows the range."""
    rounds = []
    real = sharding._facts
    monkeypatch.setattr(sharding, "_facts", lambda: rounds.append(1) or real())
    texts = [(i, f"text {i}") for i in range(3000)]
    assert as_rows(sharding.shard_documents(docs(texts))) == plain(texts)
    assert len(rounds) <= 5


def test_written_shards_hold_every_row(spark, docs, tmp_path):
    texts = mixed()
    frame = docs(texts)
    sharding.write_shards(frame, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == [f"shard={i}" for i in range(8)]
    assert back.select(frame.columns).exceptAll(frame).isEmpty() and back.count() == len(texts)
    named = frame.selectExpr("CAST(doc_id AS STRING) AS name", "text", "lang")
    shards = sharding.shard_documents(named, id_col="name", carry=["lang"]).groupBy("shard").agg(
        {"size": "sum", "lang": "max"}).collect()
    assert len(shards) == 8 and all(r["max(lang)"] == "x" for r in shards)
    sharding.write_shards(frame.selectExpr("*", "-1 AS slot", "'x' AS shard"), str(tmp_path / "other"))
    other = spark.read.parquet(str(tmp_path / "other"))
    assert other.where("slot = -1 AND shard = 'x'").select("_shard", "_slot").distinct().count() == len(texts)

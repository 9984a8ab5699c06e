"""SimHash groups against brute force."""

import random

import numpy as np
import xxhash

from text_help import SMALL
from tillcast.llm import simhash
from tillcast.llm.registry import QUERIES


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace(
        "\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace(
        "\x0c", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42)
              for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(ids, fps):
    """Smallest id reachable, by flooding."""
    fps, least, seen = np.array(fps, dtype=np.uint64), {}, set()
    for i in sorted(range(len(ids)), key=lambda i: ids[i]):
        if i in seen:
            continue
        todo, name = [i], ids[i]
        seen.add(i)
        while todo:
            at = todo.pop()
            least[ids[at]] = name
            for j in np.flatnonzero(np.bitwise_count(fps ^ fps[at]) <= 3):
                if int(j) not in seen:
                    seen.add(int(j))
                    todo.append(int(j))
    return least


def test_query_equals_brute_force(spark):
    got = QUERIES["op8_simhash"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    fps = {i: plain(t) for i, t in texts.items()}
    want = classes(list(fps), list(fps.values()))
    assert len(got) == len(texts)
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def _flip(rng, fp, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        fp ^= 1 << b
    return fp


def test_links_lose_nothing_even_in_crowded_buckets(spark, monkeypatch):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        near = [rng.getrandbits(64)]
        near += [_flip(rng, rng.choice(near), 3) for _ in range(12)]
        fps |= set(near)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "_fp long")
    want = classes(signed, fps)
    for crowd in (1500, 2):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        found = {r.node: r.component for r in simhash.components(simhash.links(nodes)).collect()}
        groups = {}
        for f in signed:
            groups.setdefault(found.get(f, f), set()).add(want[f])
        assert all(len(g) == 1 for g in groups.values())
        assert len(groups) == len(set(want.values()))


def test_null_empty_repeated_and_empty_table(spark, docs):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(
        docs([(5, None), (3, ""), (3, ""), (9, "one two"), (None, "ONE two"), (7, " \t")])).collect()}
    zero, pair = "0" * 16, f"{plain('one two'):016x}"
    assert got == {(5, zero, 3), (3, zero, 3), (7, zero, 3), (9, pair, 9), (None, pair, 9)}
    assert simhash.simhash_groups(docs([(1, "x")]).limit(0)).count() == 0


def test_components_of_stars_need_no_round_and_chains_end_settled(spark, monkeypatch):
    """A round over many partitions is thousands of tasks for the driver to keep."""
    tables, real = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda frame, label: tables.append(label) or real(frame, label))

    def found(pairs):
        tables.clear()
        rows = simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()
        got = {r.node: r.component for r in rows}
        assert len(got) == len(rows)
        return got

    star = [(-7, i) for i in range(1, 400)] + [(5, 5), (3, -7), (-7, 3)] + [(1000, 1001)]
    assert found(star) == {-7: -7, **{i: -7 for i in range(1, 400)}, 1000: 1000, 1001: 1000}
    assert tables == ["stars"]
    rng = random.Random(8)
    chain = rng.sample(range(-500, 500), 60)
    assert found(list(zip(chain, chain[1:], strict=False)) + [(900, 800)]) == {
        900: 800, 800: 800, **dict.fromkeys(chain, min(chain))}
    assert len(tables) <= 13
    assert found([]) == {} and tables == ["stars"]


def test_a_bucket_is_passed_on_as_stars():
    fps = np.array([0b111111111, 0b111111, 0b111, 0, 1 << 40 | 63 << 30, -1], dtype=np.int64)
    assert sorted(simhash.forest(fps)) == [(0, 0b111), (0, 0b111111), (0, 0b111111111)]

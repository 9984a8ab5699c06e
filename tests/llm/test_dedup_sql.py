"""Exact and line duplicates and contamination: SQL on the small tables, hard cases by hand."""

import hashlib
import time

import pytest
from text_help import SMALL

from tillcast.llm import decontaminate, exact_dedup
from tillcast.llm.line_dedup import line_dedup
from tillcast.llm.registry import ORACLE, QUERIES
from tools.check import compare, connect


@pytest.mark.parametrize("name", ["op2_line_dedup", "op3_decontamination", "op9_exact_dedup"])
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SMALL).toArrow()
    assert compare(got, connect(SMALL).execute(ORACLE[name]).to_arrow_table()) is None


def test_exact_dedup_cases(spark, docs, monkeypatch):
    texts = [(5, "a b"), (3, "ab"), (4, " a\tb\n"), (7, None), (6, ""), (8, " \r"), (9, "only"),
             (None, "ab"), (2, "dup"), (2, "dup")]
    want = {(5, 4, 4), (3, 4, 4), (4, 4, 4), (None, 4, 4), (7, 8, 3), (6, 8, 3), (8, 8, 3),
            (9, 9, 1), (2, 2, 2)}
    for bits in (1 << 20, 1 << 15):
        monkeypatch.setattr(exact_dedup, "filter_bits", lambda n, bits=bits: bits)
        rows = exact_dedup.exact_dedup(docs(texts)).collect()
        assert len(rows) == len(texts)
        assert {(r.doc_id, r.keep_id, r.group_size) for r in rows} == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)
        assert {r.text_sha256 for r in rows if r.doc_id == 6} == {hashlib.sha256(b"").hexdigest()}
    assert exact_dedup.exact_dedup(docs([(1, "x")]).limit(0)).count() == 0


def test_filter_never_misses_a_repeat(spark):
    """Also when nearly every bit is set: repeats pass, and the result is whole."""
    rows = spark.range(40000).selectExpr("xxhash64(id DIV 2) AS _h").union(
        spark.range(100000, 120000).selectExpr("xxhash64(id) AS _h"))
    for bits in (1 << 15, 1 << 20):
        flags = exact_dedup.maybe_repeated(rows, exact_dedup.repeated_filter(rows, bits), bits)
        found = flags.groupBy("_h").agg({"_h": "count", "maybe": "min"}).where("`count(_h)` > 1")
        assert found.where("NOT `min(maybe)`").count() == 0
    assert flags.where("NOT maybe").count() > 15000


def test_line_dedup_cases(docs):
    long = "A line of more than ten"
    texts = [(2, f"{long}\nshort\n{long} "), (1, f"\t{long.upper()}\nx"), (3, None), (4, ""),
             (None, f"short\n{long}\n\n"), (5, "own line, twice here\nown line, twice here"),
             (6, f"{long}\n{'é' * 12}"), (7, f"{'É' * 12}\n{'é' * 12}")]
    rows = {r.doc_id: r for r in line_dedup(docs(texts)).collect()}
    assert {k: (r.text, r.n_lines, r.n_dropped) for k, r in rows.items()} == {
        1: (f"\t{long.upper()}\nx", 2, 0), 2: ("short", 3, 2), 3: (None, 1, 0), 4: ("", 1, 0),
        5: ("own line, twice here\nown line, twice here", 2, 0), None: ("short\n\n", 4, 1),
        6: ("é" * 12, 2, 1), 7: ("É" * 12, 2, 1)}
    assert rows[1].lang == "x" and rows[1]._mine == "clash"
    assert line_dedup(docs([(1, "x")]).limit(0)).count() == 0


def plain_hits(text, items, span=10):
    said, hit, names = decontaminate.words(text), set(), set()
    for name, item in items:
        parts = decontaminate.words(item)
        size = min(span, len(parts))
        for s in range(len(parts) - size + 1 if parts else 0):
            for p in range(len(said) - size + 1):
                if said[p:p + size] == parts[s:s + size]:
                    hit |= set(range(p, p + size))
                    names.add(name or "")
    return len(said), len(hit), sorted(names)


@pytest.mark.parametrize("most", [500_000, 0])
def test_contamination_equals_plain_search(spark, docs, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_TERMS", most)
    run = "one two three four five six seven eight nine ten eleven twelve"
    items = [("7", run), ("7", "x y"), ("12", "Solo"), (None, "the the the the"), ("9", None),
             ("8", ""), ("10", "is " * 25), ("11", "never said anywhere in the texts at all, ever or so")]
    texts = [(1, run), (2, f"pre {run[:60]} post"), (3, None), (4, ""), (5, "X-y, solo é"), (5, run),
             (None, "is " * 40), (6, "the the the the the"), (7, "is " * 9), (8, "éx y"),
             (9, f"{run} {run} x x y"), (9, f"{run} {run} x x y"), (10, "a " * 30000 + run)]
    frame = spark.createDataFrame(items, "item_id string, text string").selectExpr(
        "*", "1 AS _item", "2 AS pos")
    rows = decontaminate.find_contamination(docs(texts), frame).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, list(r.items), r.contaminated) for r in rows)
    want = []
    for number, text in texts:
        n, hit, names = plain_hits(text, items)
        want.append((str(number), n, hit, names, hit > 0))
    assert got == sorted(want)
    assert decontaminate.find_contamination(docs([(1, "x")]).limit(0), frame).count() == 0
    none = decontaminate.find_contamination(docs(texts), frame.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(texts)


def test_proximity(spark, docs):
    listed = decontaminate.item_words(
        spark.createDataFrame([("1", "alpha beta gamma")], "item_id string, text string"), "item_id", "text")
    frame = docs([(1, "alpha beta gamma"), (2, "gamma x x alpha x beta x gamma"), (3, "alpha")]).selectExpr(
        "doc_id AS _id", "text AS _text")
    counts = decontaminate._counted(frame.select("_text"), None)
    index = decontaminate._index(frame, None, None)
    spots = decontaminate.windows(listed, counts)
    ids = index.where("term IS NULL").select("_row", "_id")
    near = {s: {r._id for r in decontaminate.near_matches(index, spots, s).join(ids, "_row").collect()}
            for s in (0, 1)}
    assert near == {0: {1}, 1: {1, 2}}


@pytest.mark.parametrize("most", [500_000, 0])
def test_proximity_of_the_operator(spark, docs, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_TERMS", most)
    items = spark.createDataFrame([("1", "alpha beta gamma"), ("2", "solo")], "item_id string, text string")
    texts = [(1, "alpha beta gamma"), (2, "alpha x gamma x x beta alpha"), (3, "alpha x beta"),
             (4, "alpha x x x beta gamma"), (5, "beta"), (6, None), (7, "beta alpha"), (8, "a solo"),
             (None, "alpha x beta"), (3, "alpha x beta")]
    counts = decontaminate._counted(docs(texts).selectExpr("text"), None)
    listed = decontaminate.item_words(items, "item_id", "text")
    pairs = [(r.t1, r.p2 - r.p1, r.t2) for r in decontaminate.windows(listed, counts).collect()]
    names = {"solo": "2"}
    want = {}
    for slop in (0, 2, 3):
        for number, text in texts:
            said = (text or "").split()
            want[slop, number] = sorted({names.get(a, "1") for a, d, b in pairs for p, w in enumerate(said)
                                         if w == a for q, v in enumerate(said) if v == b and abs(q - p - d) <= slop})
    exact = None
    for slop in (0, 2, 3):
        rows = decontaminate.find_contamination(docs(texts), items, slop=slop).collect()
        assert len(rows) == len(texts)
        hits = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r["items"]) for r in rows)
        exact = exact or hits
        assert hits == exact
        if slop:
            assert all(r.near_items == want[slop, r.doc_id] and r.n_near == len(r.near_items) for r in rows)
    assert want[3, 4] == ["1"] and want[2, 4] == [] and want[3, 1] == ["1"]


def test_long_texts_in_linear_time(docs):
    """Texts of 200,000 repeated lines lose them in seconds."""
    shared = "\n".join(f"repeated line number {i}" for i in range(200_000))
    start = time.time()
    rows = {r.doc_id: r for r in line_dedup(docs([(1, shared), (2, f"own\n{shared}\nown")])).collect()}
    assert time.time() - start < 60
    assert rows[1].text == shared and rows[2].text == "own\nown" and rows[2].n_dropped == 200_000


def test_rows_without_id_and_with_one_id(docs):
    """Rows without an id are one document for counting, but each keeps its own other lines."""
    long = "a line that repeats a lot"
    texts = [(None, f"{long}\nown {i}") for i in range(300)] + [(None, f"{long}\nown 0")] * 2
    assert {r.n_dropped for r in line_dedup(docs(texts)).collect()} == {0}
    rows = line_dedup(docs([*texts, (4, f"{long}\nx"), (4, f"y\n{long}"), (9, long)])).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows if r.doc_id) == [
        ("4", f"{long}\nx"), ("4", f"y\n{long}"), ("9", "")]
    assert sorted(r.text for r in rows if r.doc_id is None) == sorted(t.split("\n")[1] for _, t in texts)


def test_more_documents_than_two(docs):
    texts = [(i, f"found in all of them\nfound in some, {i % 2 and 'odd' or 'even'} ones") for i in range(5)]
    texts += [(0, "found in all of them"), (None, "found in some, odd ones")]
    got = {least: sorted((str(r.doc_id), r.n_dropped) for r in line_dedup(docs(texts), min_docs=least).collect())
           for least in (3, 4)}
    assert got[3] == [("0", 0), ("0", 0), ("1", 1), ("2", 2), ("3", 2), ("4", 2), ("None", 1)]
    assert got[4] == [("0", 0), ("0", 0), ("1", 1), ("2", 1), ("3", 1), ("4", 1), ("None", 0)]
    named = line_dedup(docs(texts).selectExpr("*", "-1 AS n_lines")).first()
    assert named.n_lines == -1 and named._n_lines in (1, 2)

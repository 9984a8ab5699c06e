"""Spelling variants against a plain search over all pairs, and the SQL."""

import random
import re
import zlib
from collections import Counter

import pytest

from tillcast.llm import spelling
from tillcast.llm.registry import ORACLE, QUERIES
from tools.check import compare, connect

SMALL = "/root/testdata/sf0.001"


def edits_once(a, b):
    """Whether the words differ by one inserted, deleted or replaced letter."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def plain(counts, ratio=2):
    found = {}
    for word, n in counts.items():
        near = sorted((-m, w) for w, m in counts.items() if edits_once(word, w))
        fits = near and -near[0][0] >= ratio * n
        found[word] = (near[0][1] if fits else None, n, len(near), -near[0][0] if fits else None)
    rows = {}
    for word, (form, n, k, form_n) in found.items():
        root = word
        while found[root][0]:
            root = found[root][0]
        rows[word] = (form, root, n, k, form_n)
    return rows


def plain_counts(texts, damage=97, shortest=5, least=3):
    counts = Counter()
    for number, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if number is None else number}:{run}".encode())
            if h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def as_rows(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_query_equals_sql(spark):
    got = QUERIES["op11_spelling"](spark, SMALL).toArrow()
    assert compare(got, connect(SMALL).execute(ORACLE["op11_spelling"]).to_arrow_table()) is None


def test_counts_of_odd_texts(docs):
    long = "Übermäßig " * 4000 + "naïve coöperate×÷ " * 50
    texts = [(1, long), (1, long), (2, None), (3, ""), (None, "HELLO hello Hello"), (4, "x" * 30000),
             (5, "x" * 30000 + " " + "x" * 30000), (6, "ﬁne straße ÉÉÉÉÉ ééééé"), (7, "ééééé ééééé ÉÉÉÉÉ")]
    for damage in (97, 2, 1):
        got = {r.word: r.n for r in spelling.word_counts(docs(texts), damage=damage).collect()}
        assert got == plain_counts(texts, damage)
    assert spelling.word_counts(docs([(1, "x")]).limit(0)).count() == 0


@pytest.mark.parametrize("block", [2048, 7])
def test_variants_equal_plain_search(spark, monkeypatch, block):
    """Also with words that are all near each other, anagrams, equal counts and very long words,
    and with lengths cut into many blocks."""
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    monkeypatch.setattr(spelling, "TILE", 50)
    pick = random.Random(7)
    words = {"".join(pick.choice("abcéÿ") for _ in range(pick.randint(5, 7))) for _ in range(350)}
    words |= {f"hous{c}" for c in "abcdefghijklmnop"} | {"stone", "tones", "onset", "notes"}
    words |= {"z" * 700, "z" * 701, "z" * 350 + "y" + "z" * 349, "houses", "ouses", "éÿéÿé", "ÿéÿéÿ"}
    counts = {w: pick.choice([3, 3, 4, 7, 15, 31, 64, 129]) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert as_rows(spelling.spelling_variants(frame)) == plain(counts)


def test_chain_of_forms_and_no_words(spark):
    """Every word leads to the next, twice as frequent one, far beyond one round's reach."""
    chain = ["a" * (30 - i) + "b" * i for i in range(25)]
    counts = {w: 3 << i for i, w in enumerate(chain)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = as_rows(spelling.spelling_variants(frame))
    assert rows == plain(counts) and {r[1] for r in rows.values()} == {chain[-1]}
    assert spelling.spelling_variants(frame.limit(0)).count() == 0
    alone = as_rows(spelling.spelling_variants(frame.limit(1)))
    assert alone == {chain[0]: (None, chain[0], 3, 0, None)}


def test_each_pair_of_blocks_once(spark):
    frame = spark.createDataFrame([(w, 3) for w in ("aaaaa", "aaaab", "aaaabb", "bbbbb")],
                                  "word string, n long")
    pairs = [tuple(sorted((tuple(r.words), tuple(r.words2)))) for r in spelling.block_pairs(
        spelling.blocks(frame)).collect()]
    assert len(pairs) == len(set(pairs))
    assert (("aaaaa",), ("aaaab",)) in pairs and (("aaaab",), ("aaaabb",)) in pairs
    assert (("aaaaa",), ("bbbbb",)) not in pairs

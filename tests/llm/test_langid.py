"""Language identification: tables against a direct context mixing, and held-out accuracy."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from text_help import SMALL
from tillcast.llm import langid
from tillcast.llm.registry import QUERIES

ROWS = [("en", "the cat sat on the mat and the dog"), ("en", "that is the way of the one"),
        ("fr", "le chat est sur la table et où là"), ("fr", "la vie est là même")]


def direct_bits(rows, lang, raw, states):
    """Code length by walking the context tree of one language, longest known context first."""
    tree = defaultdict(Counter)
    for name, text in rows:
        if name == lang:
            b = text.encode()
            for n in range(langid.ORDER + 1):
                for i in range(len(b) - n):
                    tree[b[i:i + n]][b[i + n]] += 1

    def dist(context):
        base = dist(context[1:]) if context else [1 / 256] * 256
        seen = tree.get(context)
        if not seen:
            return base
        total, kinds = sum(seen.values()), len(seen)
        left = sum(p for b, p in enumerate(base) if b not in seen)
        return [seen[b] / (total + kinds) if b in seen else base[b] * kinds / (total + kinds) / max(left, 1e-12)
                for b in range(256)]

    bits = 0.0
    for i, byte in enumerate(raw):
        context = next(raw[j:i] for j in range(max(0, i - langid.ORDER), i + 1) if raw[j:i] in states)
        bits -= math.log2(max(dist(context)[byte], 1e-12))
    return bits


def test_code_lengths_are_exact(monkeypatch):
    monkeypatch.setattr(langid, "LEAST_SEEN", 2)
    monkeypatch.setattr(langid, "STRETCH", 7)
    model = langid.Model(ROWS)
    known = {b""}
    for lang in model.langs:
        for n in range(1, langid.ORDER + 1):
            grams = Counter(t.encode()[i:i + n] for name, t in ROWS if name == lang
                            for i in range(len(t.encode()) - n))
            known |= {g for g, c in grams.items() if n == 1 or c >= 2}
    known |= {g[i:j] for g in known for i in range(len(g)) for j in range(i, len(g) + 1)}
    texts = [b"the cat", "où est le chat qui dort".encode(), b"zzz###!! 12345 \xff\xfe", b"t"]
    got = model.code_lengths(texts)
    for row, raw in zip(got, texts, strict=True):
        for lang, bits in zip(model.langs, row, strict=True):
            assert bits == pytest.approx(direct_bits(ROWS, lang, raw, known), rel=1e-4)


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op5_language_id"](spark, SMALL).collect()
    assert len(rows) == len(truth)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.95 * len(tested)
    assert all(0 <= r.score <= 1 for r in rows)


def test_null_no_letter_and_empty_table(spark, docs):
    model = langid.Model(ROWS)
    frame = docs([(1, None), (2, ""), (3, "12 -- ½"), (4, "the"), (None, "la vie"), (5, "the " * 50000)])
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(frame, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[4][0] == "en" and got[None][0] == "fr" and got[5][0] == "en"
    assert langid.identify(frame.limit(0), model).count() == 0
    untrained = langid.train(frame.limit(0))
    assert {r.lang_pred for r in langid.identify(frame, untrained).collect()} == {"und"}


def test_languages_of_long_texts_only(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 100)
    en, fr, de = "the cat and the dog ", "le chat est sur la table ", "der Hund und die Katze "
    rows = [(i, en, "en") for i in range(5)] + [(10 + i, fr * (10 + i), "fr") for i in range(5)]
    rows += [(20, de * 100, "de"), (None, de * 100, "de"), (30, en * 6, "en"), (31, en * 7, "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = langid.sample(frame, "lang", "text", "doc_id", 6)
    assert sorted(t for name, t in got if name == "en") == sorted([en] * 5 + [(en * 6)[:100]])
    assert [t for name, t in got if name == "fr"] == [fr * 10, fr * 11]
    assert [t for name, t in got if name == "de"] == [(de * 100)[:600]]
    model = langid.train(frame, rows=6)
    assert model.predict([en, fr, de])[0] == ["en", "fr", "de"]


def test_pipeline_stage_without_labels_keeps_texts_with_a_letter(spark):
    rows = [(1, "the cat", None), (2, None, None), (3, "12 34", None), (None, "\u00e9t\u00e9", None), (4, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_id(spark, frame, SMALL)
    assert kept.schema == frame.schema
    assert sorted((str(r.doc_id), r.text, r.lang) for r in kept.collect()) == [
        ("1", "the cat", None), ("None", "\u00e9t\u00e9", None)]


def test_training_holds_one_language_at_a_time():
    """The driver's memory while training stays near that of the finished tables."""
    rng = random.Random(2)
    rows = []
    for lang in range(24):
        said = ["".join(rng.choices("abcdefghijklmnop", k=4)) for _ in range(60)]
        rows += [(f"l{lang:02d}", " ".join(rng.choices(said, k=400))) for _ in range(2)]
    tracemalloc.start()
    try:
        model = langid.Model(rows)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.bits.nbytes > 4_000_000
    assert peak < 2.5 * (model.bits.nbytes + model.step.nbytes), peak / model.bits.nbytes

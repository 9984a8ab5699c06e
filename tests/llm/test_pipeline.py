"""The pipeline against a plain version of its stages, and its stages on hard cases."""

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import queries
from text_help import SMALL
from tillcast.llm import langid
from test_dedup_sql import plain_hits
from test_simhash import classes, plain

BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_lines(texts):
    first, many = {}, {}
    for number, text in sorted(texts.items()):
        for key in {lower(x.strip(BLANKS)) for x in (text or "").split("\n")}:
            if len(key) >= 10:
                first.setdefault(key, number)
                many[key] = many.get(key, 0) + 1
    return {n: "\n".join(x for x in (t or "").split("\n") if many.get(
        k := lower(x.strip(BLANKS)), 0) < 2 or first[k] == n) for n, t in texts.items()}


def test_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    items = [(r.item_id and str(r.item_id), r.text)
             for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs if r.text and langid.has_letter(r.text)}
    texts = plain_lines(texts)
    fps = {n: plain(t) for n, t in texts.items()}
    least = classes(list(fps), list(fps.values()))
    texts = {n: t for n, t in texts.items() if least[n] == n}
    texts = {n: t for n, t in texts.items() if not plain_hits(t, items)[1]}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in queries()["pipeline"](spark, SMALL).collect()}
    assert got.keys() == texts.keys() and 0 < len(got) < len(docs)
    for n, text in texts.items():
        assert list(got[n].ids) == library.encode(text, add_special_tokens=False).ids
        assert got[n].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_on_hard_rows(spark):
    rows = [(1, "The same words in a line here\nthe one", "en"), (1, "The same words in a line here\nthe one", "en"),
            (2, None, None), (3, "", "fr"), (4, "12 34", None), (None, "Other words entirely, yes", None),
            (5, "the same words in a line here\nanother end of it", None), (6, "ab " * 40000, "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "*", "CAST(NULL AS STRING) AS source", "1L AS n_chars", "'c' AS lang_pred", "'c' AS n_lines",
        "'c' AS _id", "'c' AS _kept", "'c' AS _hit", "'c' AS _rows")
    for some in (frame, frame.limit(0)):
        docs, counts = some, []
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.schema.simpleString() == docs.schema.simpleString(), name
            docs = spark.createDataFrame(out.collect(), out.schema)
            counts.append(docs.count())
        coded = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
        assert len(coded) == counts[-1]
        assert counts == ([5, 5, 4, 4] if some is frame else [0] * 4)
    assert np.all([r.n_tokens == len(r.ids) for r in coded])

"""Encoding against the tokenizers library."""

import random

import public_tokenizers
import pytest
from text_help import SMALL
from tokenizers import Tokenizer

from tillcast.llm import bpe
from tillcast.llm.registry import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.tables(PATH))


def same(coder, library, texts):
    want = library.encode_batch(texts, add_special_tokens=False)
    got = coder.encode(texts)
    for text, g, w in zip(texts, got, want, strict=True):
        assert g.tolist() == w.ids, repr(text[:80])
        assert coder.decode(g) == library.decode(w.ids, skip_special_tokens=False)


def test_every_token_and_character(coder, library):
    same(coder, library, [b.decode() for i, b in coder.t.bytes_of.items()
                          if b.decode("utf-8", "ignore").encode() == b])
    texts = [f"a{chr(c)}b 1{chr(c)}2 -{chr(c)}- {chr(c)} x" for c in range(0x110000)
             if not 0xD800 <= c < 0xE000 and (c < 0x600 or c % 97 == 0 or c in coder.t.odd and c % 13 == 0)]
    same(coder, library, texts)


def test_random_and_long(coder, library):
    rng = random.Random(1)
    signs = ["a", "aa", "the", " ", "\n", "  ", "'s", "1", "é", "ß", "😀", "<|endoftext|>", "=", "\t", "ing", "x"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 20000, "=" * 3001, " " * 5000, "ab" * 4000, "the " * 9000, ""]
    same(coder, library, texts)


def test_query_on_documents(spark, library):
    import hashlib
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op7_bpe"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_null_repeated_and_empty_table(spark, docs):
    rows = bpe.encode(docs([(1, None), (1, None), (None, "hi"), (2, "")]), PATH).collect()
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in rows)[:3] == [
        ("1", [], ""), ("1", [], ""), ("2", [], "")]
    assert bpe.encode(docs(["x"]).limit(0), PATH).count() == 0

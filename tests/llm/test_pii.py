"""Personal data: rules against plain regular expressions, CRF and gradient against brute force."""

import hashlib
import itertools
import re

import numpy as np
import pytest

from text_help import SMALL
from tillcast.llm import pii, tagger
from tillcast.llm.registry import QUERIES

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    def fits(kind, said):
        n = sum(c in "0123456789" for c in said)
        if kind == "ip":
            return all(int(p) <= 255 for p in said.split("."))
        if kind == "card":
            total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(
                int(c) for c in reversed(re.sub(r"[^0-9]", "", said))))
            return 13 <= n <= 19 and total % 10 == 0
        return kind == "email" or 9 <= n <= 15
    return [(k, *m.span()) for k, p in PLAIN.items() for m in re.finditer(p, text or "")
            if fits(k, m[0])]


CASES = [
    None, "", "a@b.co@c.de x@y", "..@a.b-.c.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255",
    "4111 1111-1111 1111, 4111111111111112 4111  1111", "+1 (555) 123-4567 +12 +1-23456789012345678",
    "😀 é me@x.org 😀", "a" * 30000 + "@" + "b" * 30000 + ".c", "7" * 20000, "+1" + "(" * 20000,
    "x@a.b@c.d y@@z.w", "@a.b", "10.0.0.1:80 ١٢٣.1.1.1 1.1.1.1"]


@pytest.mark.parametrize("text", CASES)
def test_rules_equal_plain_regular_expressions(text):
    if text and len(text) > 10000:  # the plain ones are quadratic there
        text = text[:1500] + text[-1500:]
    assert pii.base_spans(text or "") == plain(text)


def test_query_keeps_base_spans(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op1_pii"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = [f"{k}:{s}:{e}" for k, s, e in plain(texts[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans) and len(spans) == len(want) + r.n_added
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(w.startswith(k) for w in want) for k in PLAIN]


def test_gradient_and_likelihood_against_enumeration():
    rng = np.random.default_rng(1)
    model = {k: v * 0.7 + rng.normal(0, 0.1, v.shape) for k, v in tagger.initial(3, hidden=3, tags=3).items()}
    x, tags = rng.integers(1, 40, (4, 2)), rng.integers(0, 3, (4, 2))
    value, grads = tagger.loss(model, x, tags)
    scores, turn = tagger.emissions(model, x), model["turn"]

    def path(b, seq):
        return sum(scores[t, b, s] for t, s in enumerate(seq)) + sum(
            turn[p, q] for p, q in itertools.pairwise(seq))
    every = list(itertools.product(range(3), repeat=4))
    want = sum(np.logaddexp.reduce([path(b, s) for s in every]) - path(b, tags[:, b]) for b in (0, 1))
    assert value == pytest.approx(want)
    assert [tuple(c) for c in tagger.decode(model, x).T] == [
        max(every, key=lambda s, b=b: path(b, s)) for b in (0, 1)]
    for name, at in [("re_f", (1, 4)), ("re_b", (2, 7)), ("in_f", (x[1, 0], 2)), ("in_b", (x[2, 1], 5)),
                     ("bias_b", (4,)), ("out", (1, 1)), ("out_b", (2,)), ("turn", (0, 1))]:
        moved = []
        for step in (1e-5, -1e-5):
            other = {k: v.copy() for k, v in model.items()}
            other[name][at] += step
            moved.append(tagger.loss(other, x, tags)[0])
        assert grads[name][at] == pytest.approx((moved[0] - moved[1]) / 2e-5, rel=1e-3, abs=1e-6)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(2)
    texts = []
    for _ in range(700):
        number = "".join(map(str, rng.integers(0, 10, 15)))
        number += next(d for d in "0123456789" if pii.luhn(number + d))
        said = [f"jo.{number[:2]}@mail{number[3]}.example.com", number,
                ".".join(str(v) for v in rng.integers(0, 256, 4)), f"+1 ({number[:3]}) 555-{number[4:8]}"]
        texts.append(f"the words of a text {said[rng.integers(4)]} and then some more of it")
    x, y = pii.labelled_windows(texts)
    return tagger.train(x[:500], y[:500], passes=10), x[500:], y[500:]


def test_tagger_learns_and_adds_spans(model):
    net, x, y = model
    got = tagger.decode(net, x.T).T
    inside = y > 0
    assert (got[inside] == y[inside]).mean() > 0.9 and (got[~inside] == 0).mean() > 0.98
    text = "so call the words 4111.1111.1111.1111 and then some more of it"
    sure, added = pii.find_spans([text], net)[0]
    assert sure == [] and added == [("card", 18, 37)]
    assert pii.find_spans(["Plain words of the text with 12 of 14 parts."], net)[0] == ([], [])


def test_windows_cover_every_trigger():
    text = "a" * 500 + "7" + "b" * 130 + "@" + "c" * 33
    starts = pii.window_starts(text)
    for p in (500, 631):
        covering = [k for k in range(0, len(text), pii.STRIDE) if k <= p < k + pii.WINDOW]
        assert set(s for s in starts if s <= p < s + pii.WINDOW) >= {
            k for k in covering if k <= max(starts)} and any(s <= p < s + pii.WINDOW for s in starts)
    assert pii.window_starts("no trigger") == []


def test_written_out_address_without_digit_or_at_sign(model, spark, docs):
    text = "the words of a text jo.doe (at) mailx.example.com and then some more of it"
    far = "the words of a text " * 20 + text + " and some more of it" * 20
    for whole in (text, far):
        at = whole.index("jo.doe")
        assert pii.find_spans([whole], model[0]) == [([], [("email", at, at + len("jo.doe (at) mailx.example.com"))])]
    for sign in ("(at)", "[at]"):
        long = "w " * 200 + f"{'jo' * 60} {sign} {'a.' * 60}org" + " w" * 200
        read = {p for s in pii.window_starts(long) for p in range(s, s + pii.WINDOW)}
        assert read >= set(range(long.index("jo"), long.index("org") + 3))
    x, y = pii.labelled_windows([text])
    assert len(x) == 1 and (y[0] == 1).sum() == len("jo.doe (at) mailx.example.com")
    frame = docs([(1, text), (2, "to jo [at] site [dot] org"), (3, "no datum at all")])
    assert sorted(pii.sample(frame)) == sorted([text, "to jo [at] site [dot] org"])


def test_null_repeated_and_empty_table(spark, docs):
    frame = docs([(1, None), (2, ""), (3, "me@x.org"), (3, "me@x.org"), (None, "1.1.1.1")])
    rows = pii.detect(frame, None).collect()
    assert sorted((str(r.doc_id), len(r.base), len(r.added)) for r in rows) == [
        ("1", 0, 0), ("2", 0, 0), ("3", 1, 0), ("3", 1, 0), ("None", 1, 0)]
    assert pii.train(frame.limit(0)) is None and pii.detect(frame.limit(0), None).count() == 0


def test_settled_spans():
    """The tagger's own borders first, then wider ones; all that fit; long runs in pieces."""
    card = "4111.1111.1111.1111"
    assert pii.settled("card", f"card {card} 05/27", 5, 24) == [("card", 5, 24)]
    assert pii.settled("card", f"card {card} 05/27", 7, 23) == []  # no border holds a card
    assert pii.settled("card", f"card {card}, 05/27", 7, 22) == [("card", 5, 24)]
    two = f"{card} or {card}"
    assert pii.settled("card", two, 0, len(two)) == [("card", 0, 19), ("card", 23, 42)]
    assert pii.settled("ip", "at 10 . 0 . 0 . 1 and 10:0:0:2", 3, 30) == [("ip", 3, 17), ("ip", 22, 30)]
    many = ", ".join(f"name{i} (at) site{i}.org" for i in range(40))
    assert len(many) > 2 * pii.MOST
    found = pii.settled("email", many, 0, len(many))
    assert len(found) >= 38 and all(a[2] <= b[1] for a, b in itertools.pairwise(found))


def test_sample_windows_come_from_all_texts():
    texts = [f"{'word ' * 30}call +49 30 1234567{i % 10} now. " * 20 for i in range(12)]
    x, y = pii.labelled_windows(texts, most=50)
    assert x.shape == y.shape == (50, pii.WINDOW) and y.any()
    again, _ = pii.labelled_windows(texts, most=50)
    assert (x == again).all()
    whole, _ = pii.labelled_windows(texts, most=10_000)
    assert 200 < len(whole) < 10_000
    late = pii.labelled_windows(texts[:1], most=10_000)[0]
    assert len(late) > 12  # more than the first windows of a text


def test_very_long_text(model, docs):
    text = "plain words only " * 40_000 + "mail ann (at) example.org or 10.0.0.1"
    row = pii.detect(docs([text]), model[0]).first()
    assert [(s.kind, text[s.start:s.end]) for s in row.base] == [("ip", "10.0.0.1")]
    assert all(s.start > 680_000 for s in row.added)

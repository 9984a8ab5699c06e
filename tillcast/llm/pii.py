"""Personal data in texts: exact rules plus a trained character tagger.

Rules find e-mail addresses, IP addresses, card and phone numbers. A
bidirectional LSTM with CRF transitions, trained on spans that the rules label
in a bounded sample (some with their separators rewritten, which the rules do
not know), reads overlapping windows. A character takes its tag from the
window in which it lies most central, and spans run across windows. A span of
the tagger that touches no base span is added if it passes the check of its
kind: digits in number and check sum, address parts in range.

A span passes only with a digit, an ``@`` or an ``(at)`` or ``[at]`` in it, so
windows that overlap no such sign, nor the address around an at sign, are not
read. Training sample: at most ``SAMPLE_ROWS`` rows of at most ``SAMPLE_CHARS``
code points that hold such a sign, and of all their windows at most
``SAMPLE_WINDOWS``, picked by a hash; written-out addresses count as e-mails there.

Defined cases: a null text is the empty text and has no spans; texts of any length
are read whole; where two windows are equally central the earlier one's tag counts,
and of the tagger's spans that touch each other the first stays; without
training rows only base spans are found; repeated rows are read one by one; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm import tagger
from tillcast.llm.common import ship

KINDS = ["email", "ip", "card", "phone"]
WINDOW, STRIDE = 96, 64
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_WINDOWS = 1200, 6000, 2400
LANES = 2048

# What every match of WIDE holds; Java reads the pattern alike.
TRIGGER = re.compile(r"[0-9@]|\(at\)|\[at\]")
# The rules. Runs are entered at their start only, which finds the same
# matches in linear time.
LOCAL = re.compile("[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def is_card(text: str) -> bool:
    number = digits(text)
    return 13 <= len(number) <= 19 and luhn(number)


def is_ip(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
                                   for p in parts)


def is_phone(text: str) -> bool:
    return 9 <= len(digits(text)) <= 15


def base_spans(text: str) -> list[Span]:
    """Spans of the rules, by kind, then start."""
    if not TRIGGER.search(text):
        return []
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    found += [("ip", *m.span()) for m in IP.finditer(text) if is_ip(m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if is_card(m[0])]
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if is_phone(m[0])]
    return found


# Wider forms in which the tagger's spans are looked for.
WIDE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+"
                        r"(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?: ?[.,:] ?[0-9]+){3}"),
    "card": re.compile(r"[0-9](?:[ ./_-]{0,2}[0-9])+"),
    "phone": re.compile(r"(?:\+|00)[0-9 ()./-]+[0-9]"),
}
EDGE = 3  # characters by which a tagger's span may be short at either end
MOST = 320  # an e-mail address, the longest of the kinds, has no more characters


def settled(kind: str, text: str, start: int, end: int) -> list[Span]:
    """The spans of that kind that overlap the tagger's and pass the kind's check.

    The tagger's own borders are tried first, then borders widened to the next blank and by
    ``EDGE``; the first of them that hold a fitting match give all that they hold. A span of more
    than ``MOST`` characters is taken in pieces of that size."""
    if end - start > MOST:
        found: list[Span] = []
        for at in range(start, end, MOST):
            found += [s for s in settled(kind, text, at, min(end, at + MOST))
                      if not found or s[1] >= found[-1][2]]
        return found
    wide = start
    while wide > 0 and end - wide < MOST and not text[wide - 1].isspace():
        wide -= 1
    for low, high in ((start, end), (max(0, wide - EDGE), min(len(text), end + EDGE))):
        fits = [(kind, *m.span()) for m in WIDE[kind].finditer(text, low, high)
                if m.start() < end and m.end() > start and _passes(kind, m[0])]
        if fits:
            return fits
    return []


def _passes(kind: str, said: str) -> bool:
    if kind == "ip":
        return is_ip(re.findall("[0-9]+", said))
    return {"card": is_card, "phone": is_phone}.get(kind, bool)(said)


_SITE = re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+")


def _address(text: str, at: int, end: int) -> tuple[int, int, bool]:
    """Start and end of the address around an at sign, and whether both of its parts are there."""
    name = at - (at > 0 and text[at - 1] == " ")
    start = name
    while start > 0 and text[start - 1] in _LOCAL_SIGNS:
        start -= 1
    site = _SITE.match(text, end)
    return start if start < name else at, site.end() if site else end, start < name and bool(site)


def written_out(text: str) -> list[Span]:
    """E-mail addresses with ``(at)`` or ``[at]``, which the rules do not know."""
    found: list[Span] = []
    for m in TRIGGER.finditer(text):
        if m.end() - m.start() > 1:
            start, end, both = _address(text, *m.span())
            if both:
                found.append(("email", start, end))
    return found


def window_starts(text: str) -> list[int]:
    """Starts of the windows, on one grid over the whole text, that hold a trigger or
    a part of the address around one."""
    last, found = max(0, -(-(len(text) - WINDOW) // STRIDE)), set()
    for m in TRIGGER.finditer(text):
        start, end = m.span()
        if not "0" <= m[0] <= "9":
            start, end, _ = _address(text, start, end)
        first = max(0, -((WINDOW - 1 - start) // STRIDE))
        found.update(range(first, min((end - 1) // STRIDE, last) + 1))
    return [k * STRIDE for k in sorted(found)]


def labelled_windows(texts: list[str], most: int = SAMPLE_WINDOWS,
                     seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows of symbols and tags from texts that the rules and ``written_out`` label: of all
    windows of all texts, those ``most`` with the smallest crc32 of text number and start."""
    rng = np.random.default_rng(seed)
    kept: list[tuple[int, np.ndarray, np.ndarray]] = []
    for number, text in enumerate(texts):
        spans = sorted([*base_spans(text), *written_out(text)], key=lambda s: s[1])
        pieces, labels, at = [], [], 0
        for kind, start, end in spans:
            if start < at:
                continue
            said = _rewritten(kind, text[start:end], rng)
            for part, tag in ((text[at:start], 0), (said, 1 + KINDS.index(kind))):
                pieces.append(part)
                labels += [tag] * len(part)
            at = end
        pieces.append(text[at:])
        labels += [0] * len(pieces[-1])
        whole = "".join(pieces)
        signs, tags = tagger.symbols(whole), np.array(labels, dtype=np.int64)
        for start in window_starts(whole):
            x, y = np.zeros(WINDOW, np.int16), np.zeros(WINDOW, np.int16)
            part = signs[start:start + WINDOW]
            x[:len(part)], y[:len(part)] = part, tags[start:start + WINDOW]
            kept.append((zlib.crc32(f"{number}:{start}".encode()), x, y))
        if len(kept) > 4 * most:
            kept = sorted(kept, key=lambda k: k[0])[:most]
    kept = sorted(kept, key=lambda k: k[0])[:most]
    return tuple(np.array([k[i] for k in kept], np.int64).reshape(-1, WINDOW) for i in (1, 2))


def _rewritten(kind: str, said: str, rng: np.random.Generator) -> str:
    """The span as it is, or in one time of three with other separators."""
    if rng.random() > 0.33:
        return said
    if kind == "email":
        return said.replace("@", " (at) ", 1)
    if kind == "ip":
        return said.replace(".", " . ")
    if kind == "phone":
        return said.replace("+", "00").replace("-", "/")
    number = digits(said)
    return ".".join(number[i:i + 4] for i in range(0, len(number), 4))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """At most ``SAMPLE_ROWS`` texts, picked by a hash of the id; a count comes first, so
    that the tasks send about one and a half times as many, however many tasks there are."""
    usable = docs.where(F.col(text_col).rlike(TRIGGER.pattern)
                        & (F.char_length(text_col) <= SAMPLE_CHARS))
    share = min(1.0, 1.5 * SAMPLE_ROWS / max(1, usable.count()))
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) / (1 << 20)
    near = usable.select(place.alias("_p"), F.col(text_col).alias("_t")).where(F.col("_p") < share)
    ordered = sorted(near.collect(), key=lambda r: (r["_p"], r["_t"]))
    return [r["_t"] for r in ordered[:SAMPLE_ROWS]]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    x, y = labelled_windows(sample(docs, id_col, text_col))
    return tagger.train(x, y) if len(x) else None


def tagged(texts: list[str], model: dict) -> list[list[Span]]:
    """Spans of the tagger: windows of all texts are decoded together, then reconciled."""
    places = [(i, start) for i, text in enumerate(texts) for start in window_starts(text)]
    votes: dict[int, list[tuple[int, np.ndarray]]] = {}
    for at in range(0, len(places), LANES):
        lane = places[at:at + LANES]
        x = np.zeros((WINDOW, len(lane)), dtype=np.int64)
        for column, (i, start) in enumerate(lane):
            part = tagger.symbols(texts[i][start:start + WINDOW])
            x[:len(part), column] = part
        tags = tagger.decode(model, x)
        for column, (i, start) in enumerate(lane):
            votes.setdefault(i, []).append((start, tags[:, column]))
    found: list[list[Span]] = [[] for _ in texts]
    for i, windows in votes.items():
        if any(tags.any() for _, tags in windows):
            found[i] = _reconciled(len(texts[i]), windows)
    return found


def _reconciled(size: int, windows: list[tuple[int, np.ndarray]]) -> list[Span]:
    """One tag per character, from the window whose middle is nearest; then the spans."""
    spans: list[Span] = []
    tag_at: dict[int, tuple[float, int]] = {}
    for start, tags in windows:
        for offset in range(min(WINDOW, size - start)):
            away = abs(offset - (WINDOW - 1) / 2)
            old = tag_at.get(start + offset)
            if old is None or away < old[0]:
                tag_at[start + offset] = (away, int(tags[offset]))
    begin, kind, last = None, 0, -2
    for p in sorted(tag_at):
        tag = tag_at[p][1]
        if begin is not None and (tag != kind or p != last + 1):
            spans.append((KINDS[kind - 1], begin, last + 1))
            begin = None
        if tag and begin is None:
            begin, kind = p, tag
        last = p
    if begin is not None:
        spans.append((KINDS[kind - 1], begin, last + 1))
    return spans


def find_spans(texts: list[str], model: dict | None) -> list[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text, each by kind, then start."""
    base = [base_spans(t) for t in texts]
    hoped = tagged(texts, model) if model else [[] for _ in texts]
    out = []
    for text, sure, more in zip(texts, base, hoped, strict=True):
        added = []
        for kind, start, end in more:
            for span in settled(kind, text, start, end):
                if not any(s < span[2] and e > span[1] for _, s, e in [*sure, *added]):
                    added.append(span)
        out.append((sure, sorted(added, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


SPANS = "array<struct<kind:string,start:int,end:int>>"


def detect(docs: DataFrame, model: dict | None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``id, base, added``: spans as arrays of (kind, start, end) in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_spans([v.as_py() or "" for v in batch.column(1)], shared.value)
            both = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[k]]
                              for f in found], kind) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *both], ["_id", "base", "added"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col)).mapInArrow(
        run, f"_id long, base {SPANS}, added {SPANS}").withColumnRenamed("_id", id_col)


ship(__name__)
ship(tagger.__name__)

"""Byte-pair encoding by walking a trie of distinct words.

A text is cut into words as byte-level BPE does. The distinct words of a batch
form a trie of bytes, which is walked depth first. The state at a node is the
last token of the encoding of the prefix that ends there: the token whose
bytes end the prefix and that BPE keeps apart from the last token of what
precedes it. So the encoding of a prefix shared by many words is found once;
it is the encoding of the shorter prefix before its last token, plus that token.

Two neighbouring tokens stay apart unless, at some moment of the merging, the
piece at the right edge of one and the piece at the left edge of the other
have a merge that comes before each of them is merged further inside.

Memory is bounded: texts are read and output leaves in slices, the word cache is
emptied at ``CACHE`` entries, those of token pairs and states at ``PAIRS``, and prefixes
above ``LONG`` bytes keep their last token only.

Defined cases: a null text is the empty text; the special token's string in a
text is the special token; repeated rows are encoded alike; an empty table
gives an empty result; further columns are not read. Decoding puts the
replacement character for bytes that are not UTF-8.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.common import ship, text_slices

CACHE, PAIRS, LONG = 160_000, 320_000, 512

# Fixed value: how byte-level BPE cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts of Latin characters only, in classes that the faster module knows.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_S = r"\t-\r \x85\xa0"
LATIN_WORDS = (f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+"
               f"|[{_S}]+(?![^{_S}])|[{_S}]+")


def byte_letters() -> dict[str, int]:
    """The printable characters that stand for bytes in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tables:
    """Tokens and merges of a vocabulary file in flat arrays; a few MB whatever the data."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in stored["model"]["vocab"]}
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        by_bytes = {raw[t]: i for t, i in stored["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: b for b, i in by_bytes.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        count = max(self.bytes_of) + 1
        # The merge that makes a token: its two parts and its rank.
        self.parts = (array("i", [-1]) * count, array("i", [-1]) * count)
        self.rank = array("i", [-1]) * count
        self.merges: dict[int, int] = {}  # by left token << 20 | right token
        for rank, pair in enumerate(stored["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = by_bytes[raw[a]], by_bytes[raw[b]]
            self.merges[a << 20 | b] = rank
            whole = by_bytes[self.bytes_of[a] + self.bytes_of[b]]
            if self.rank[whole] < 0:
                self.parts[0][whole], self.parts[1][whole], self.rank[whole] = a, b, rank
        self._join_tokens(by_bytes)
        self.odd = _odd_characters()

    def _join_tokens(self, by_bytes: dict[bytes, int]) -> None:
        """One automaton over all tokens: after some bytes its state tells every token
        that ends there, longest first.

        States are numbered by length, then in byte order, so the children of a state follow
        each other: its bytes are ``labels[first[state]:first[state + 1]]``, and the child
        behind ``labels[i]`` is state ``i + 1``."""
        level, labels = [b""], bytearray()
        self.first, self.own, self.depth = array("i"), array("i"), array("i")
        tokens, size = sorted(by_bytes), 0
        while level:
            size += 1
            tokens = [t for t in tokens if len(t) >= size]
            below = sorted({t[:size] for t in tokens})
            at = 0
            for prefix in level:
                self.own.append(by_bytes.get(prefix, -1))
                self.depth.append(size - 1)
                self.first.append(len(labels))
                while at < len(below) and below[at].startswith(prefix):
                    labels.append(below[at][-1])
                    at += 1
            level = below
        self.first.append(len(labels))
        self.labels = bytes(labels)
        self.fail = array("i", [0]) * len(self.own)
        for state in range(len(self.own)):
            for i in range(self.first[state], self.first[state + 1]):
                if state:
                    self.fail[i + 1] = self.step(self.fail[state], self.labels[i])

    def step(self, state: int, byte: int) -> int:
        while True:
            at = self.labels.find(byte, self.first[state], self.first[state + 1])
            if at >= 0:
                return at + 1
            if not state:
                return 0
            state = self.fail[state]

    def ends(self, state: int) -> tuple[tuple[int, int], ...]:
        """Length and number of the tokens that end in a state, longest first."""
        found = []
        while state:
            if self.own[state] >= 0:
                found.append((self.depth[state], self.own[state]))
            state = self.fail[state]
        return tuple(found)

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Pieces at one edge of a token, each with the rank of the merge that ends it."""
        found, ends = [(token, float("inf"))], token
        while self.rank[ends] >= 0:
            rank, ends = self.rank[ends], self.parts[side][ends]
            found.append((ends, rank))
        return found


def _odd_characters() -> dict[int, str]:
    """Stand-ins for characters newer than Python's Unicode tables, which the word pattern
    and the tokenizers library may class differently: ``a`` if the library takes the
    character for a letter, ``1`` for a number, ``-`` for neither."""
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False)
    known = regex.compile(r"[\p{L}\p{N}]")
    odd = {}
    for code in range(0x250, 0x110000):
        c = chr(code)
        if unicodedata.category(c) == "Cn" and known.match(c):
            odd[code] = next((s for s in "a1" if len(cut.pre_tokenize_str(s + c)) == 1), "-")
    return odd


@lru_cache(maxsize=2)
def tables(path: str) -> Tables:
    return Tables(path)


class Coder:
    """Encodes words for one task."""

    def __init__(self, tables: Tables):
        self.t = tables
        self.apart: dict[int, bool] = {}  # by left token << 20 | right token
        self.steps: dict[int, int] = {}
        self.ends: dict[int, tuple] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.words: dict[str, bytes] = {}
        count = max(tables.bytes_of) + 1
        self.packed = [i.to_bytes(4, sys.byteorder) for i in range(count)]
        self.sizes = array("i", [len(tables.bytes_of.get(i, b"")) for i in range(count)])
        self.latin = re.compile(LATIN_WORDS)
        self.any = regex.compile(WORDS)
        self.beyond = re.compile("[^\x00-ɏ]")
        self.odd = re.compile("[" + "".join(map(chr, tables.odd)) + "]") if tables.odd else None
        self.specials = re.compile(
            "(" + "|".join(map(re.escape, tables.special)) + ")") if tables.special else None

    def forget(self) -> None:
        """Empties what has grown beyond its bound; all of it can be found again."""
        if len(self.words) > CACHE:
            self.words.clear()
        for kept in (self.apart, self.steps, self.ends, *self.edges):
            if len(kept) > PAIRS:
                kept.clear()

    def stay_apart(self, pair: int) -> bool:
        left, right = pair >> 20, pair & 0xFFFFF
        for token, side in ((left, 1), (right, 0)):
            if token not in self.edges[side]:
                self.edges[side][token] = self.t.edge(token, side)
        merges = self.t.merges.get
        found = self.apart[pair] = all(
            (q := merges(a << 20 | b)) is None or q >= ends_a or q > ends_b
            for a, ends_a in self.edges[1][left] for b, ends_b in self.edges[0][right])
        return found

    def learn(self, words: set[str]) -> None:
        """Encodes the words that are not cached, along one trie.

        In byte order words follow each other as a depth-first walk meets them,
        so the trie is never stored: what is kept is the path to the current
        node, with the last token and the encoding of each prefix on it. A word
        starts where its path leaves that of the word before.
        """
        packed, apart, ends, steps = self.packed, self.apart, self.ends, self.steps
        last, codes, states, before = [-1], [b""], [0], b""
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared = 0
            for x, y in zip(raw, before):  # noqa: B905  the shorter one ends it
                if x != y:
                    break
                shared += 1
            del last[shared + 1:], codes[shared + 1:], states[shared + 1:]
            state = states[-1]
            for n in range(shared + 1, len(raw) + 1):
                key = state << 8 | raw[n - 1]
                state = steps.get(key)
                if state is None:
                    state = steps[key] = self.t.step(key >> 8, key & 255)
                known = ends.get(state)
                if known is None:
                    known = ends[state] = self.t.ends(state)
                for size, token in known:
                    if size == n:
                        break
                    pair = last[n - size] << 20 | token
                    found = apart.get(pair)
                    if found or (found is None and self.stay_apart(pair)):
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                states.append(state)
                last.append(token)
                codes.append(b"" if n > LONG else codes[n - size] + packed[token])
            if len(raw) > LONG:
                self.words[word] = self.read_back(len(raw), last)
                del last[LONG + 1:], codes[LONG + 1:], states[LONG + 1:]
                raw = raw[:LONG]
            else:
                self.words[word] = codes[-1]
            before = raw

    def read_back(self, n: int, last: list[int]) -> bytes:
        """The encoding from the last tokens alone, for words too long to keep all prefixes'."""
        ids = array("i")
        while n:
            ids.append(last[n])
            n -= self.sizes[last[n]]
        ids.reverse()
        return ids.tobytes()

    def cut(self, text: str) -> list[str]:
        if not self.beyond.search(text):
            return self.latin.findall(text)
        if self.odd and self.odd.search(text):
            ends = [m.span() for m in self.any.finditer(text.translate(self.t.odd))]
            return [text[s:e] for s, e in ends]
        return self.any.findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cuts, new = [], set()
        self.forget()
        for text in texts:
            parts = self.specials.split(text) if self.specials else [text]
            words = []
            for i, part in enumerate(parts):
                words += [part] if i % 2 else self.cut(part)
            cuts.append(words)
            new.update(words)
        for name in new & self.t.special.keys():
            self.words[name] = self.packed[self.t.special[name]]
        self.learn(new - self.words.keys())
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), dtype=np.int32) for words in cuts]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.t.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``id, ids, decoded``: token ids of the whole text, and the text decoded from them."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(tables(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                found = coder.encode(texts)
                ends = np.cumsum([0, *map(len, found)])
                ids = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()),
                    pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), ids,
                     pa.array([coder.decode(x) for x in found], pa.string())],
                    ["_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col)).mapInArrow(
        run, "_id long, ids array<int>, decoded string").withColumnRenamed("_id", id_col)


ship(__name__)

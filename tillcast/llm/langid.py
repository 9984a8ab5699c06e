"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``ORDER`` bytes with the counts
of the bytes that followed. Frozen after training, it gives every next byte a
probability: the longest known context predicts what it has seen and leaves
the rest, by escape method C with exclusion, to the context one byte shorter,
down to a uniform choice over all 256 bytes. The code length of a text is the
exact sum of -log2 of those probabilities over all of its bytes.

A context can only be the last ``ORDER`` bytes, so the trees of all languages
become one table: a state per context that any of them knows, and per state
and byte the next state and each language's bits. A context of two or more bytes
is a state if some language's sample has it at least ``LEAST_SEEN`` times; rarer
ones leave their bytes to the shorter context. Texts are scored many
stretches at a time, each after ``ORDER`` bytes of run-up, whatever their length.

Training sample: per language at most ``SAMPLE_ROWS`` whole texts, those of at
most ``SAMPLE_CHARS`` code points by a hash of the id. Where a language has too
few of these, its shortest longer texts follow while the language's code points
are at most rows times ``SAMPLE_CHARS``; if not even the first of them fits, its
beginning does, so no language with a labelled text goes unlearnt.

Defined cases: a null text and a text without a letter are ``und`` with score
0; equal code lengths go to the first language in sort order; without any
training row every text is ``und``; repeated rows are scored one by one; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.common import fresh, ship, text_slices

UNKNOWN = "und"
ORDER = 4
LEAST_SEEN = 16  # occurrences that make a context of two or more bytes a state
# Bound of the training sample: rows per language, and their mean number of code points.
SAMPLE_ROWS, SAMPLE_CHARS = 250, 4000
STRETCH, LANES = 256, 4096
EVIDENCE = 48.0  # bytes at the mean rate that the score weighs at most


def sample(labelled: DataFrame, lang: str, text: str, id_col: str, rows: int) -> list:
    """At most ``rows`` texts per language: short ones by a hash of the id, then the shortest."""
    named = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    short = F.char_length(text) <= SAMPLE_CHARS
    seen = named.groupBy(lang).agg(F.count_if(short), F.count("*")).collect()
    few = [r[0] for r in seen if r[1] < min(rows, r[2])]
    return _short(named.where(short), {r[0]: r[1] for r in seen if r[1]}, lang, text, id_col, rows) + (
        _longer(named.where(~short & F.col(lang).isin(few)), {r[0]: r[1] for r in seen}, lang, text,
                id_col, rows) if few else [])


def _short(usable: DataFrame, counts: dict[str, int], lang: str, text: str, id_col: str,
           rows: int) -> list:
    part = F.create_map(*[x for name, n in counts.items() for x in (
        F.lit(name), F.lit(min(1.0, 2.0 * rows / n)))]) if counts else None
    if part is None:
        return []
    place = (F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) / (1 << 20)).alias("_place")
    near = usable.select(F.col(lang).alias("l"), F.col(text).alias("t"), place).where(
        F.col("_place") < F.get(F.array(part), F.lit(0))[F.col("l")])
    found, taken = [], Counter()
    for row in sorted(near.collect(), key=lambda r: (r["_place"], r["t"])):
        if taken[row["l"]] < rows:
            taken[row["l"]] += 1
            found.append((row["l"], row["t"]))
    return found


def _longer(usable: DataFrame, short: dict[str, int], lang: str, text: str, id_col: str,
            rows: int) -> list:
    """The shortest of the longer texts, as many as rows and code points are left for. Their
    lengths come first, so that only texts that enter are sent; a task passes on no more than
    ``rows`` of a language."""
    sized = usable.select(F.col(lang).alias("l"), F.char_length(text).alias("n"),
                          F.xxhash64(id_col).alias("h"), F.col(text).alias("t"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("n", "h"))
    lengths = sized.select("l", "n", "h").withColumn("k", rank).where(F.col("k") <= rows)
    room = {name: (rows - n, (rows - n) * SAMPLE_CHARS) for name, n in short.items()}
    last: dict[str, tuple[int, int, int]] = {}  # texts, length and hash of the last one
    for row in sorted(lengths.collect(), key=lambda r: (r["l"], r["k"])):
        left, chars = room[row["l"]]
        if left and (row["n"] <= chars or row["k"] == 1):
            last[row["l"]] = (row["k"], row["n"], row["h"])
            room[row["l"]] = (left - 1, max(0, chars - row["n"]))
        else:
            room[row["l"]] = (0, 0)
    facts = usable.sparkSession.createDataFrame(
        [(name, *x, (rows - short[name]) * SAMPLE_CHARS) for name, x in last.items()],
        "_l string, _k int, _n int, _h long, _c int")
    near = sized.join(F.broadcast(facts), F.col("l") == F.col("_l")).where(
        (F.col("n") < F.col("_n")) | ((F.col("n") == F.col("_n")) & (F.col("h") <= F.col("_h"))))
    near = near.select("l", "n", "h", "_k", F.substring("t", F.lit(1), F.col("_c")).alias("t"))
    by_text = F.row_number().over(Window.partitionBy("l").orderBy("n", "h", "t"))
    taken = near.withColumn("k", by_text).where((F.col("k") <= F.col("_k")) & (F.col("k") <= rows))
    return [(r["l"], r["t"]) for r in sorted(taken.collect(), key=lambda r: (r["l"], r["k"]))]


def _contexts(texts: list[bytes]) -> Iterator[bytes]:
    """The contexts of a language that make states, from its texts."""
    for n in range(1, ORDER + 1):
        seen: Counter[bytes] = Counter()
        for raw in texts:
            seen.update(raw[i:i + n] for i in range(len(raw) - n))
        yield from (c for c, times in seen.items() if n == 1 or times >= LEAST_SEEN)


def _tree(texts: list[bytes], known: set[bytes]) -> dict[bytes, dict[int, int]]:
    """How often which byte followed the known contexts in a language's texts."""
    tree: dict[bytes, dict[int, int]] = {}
    for raw in texts:
        for n in range(ORDER + 1):
            for gram, count in Counter(raw[i:i + n + 1] for i in range(len(raw) - n)).items():
                if gram[:-1] in known:
                    seen = tree.setdefault(gram[:-1], {})
                    seen[gram[-1]] = seen.get(gram[-1], 0) + count
    return tree


class Model:
    """The languages' frozen trees as one state table. Its size follows from the sample's."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in rows})
        raws = {name: [text.encode("utf-8", "surrogatepass") for lang, text in rows if lang == name]
                for name in self.langs}
        # Counts and probabilities are held for one language at a time.
        known = {b""}
        for texts in raws.values():
            known.update(_contexts(texts))
        for context in list(known):  # every suffix and prefix of a state is a state
            for i in range(len(context)):
                for j in range(i, len(context) + 1):
                    known.add(context[i:j])
        states = sorted(known, key=lambda c: (len(c), c))
        number = {c: i for i, c in enumerate(states)}
        # Bytes never seen in training share one column.
        used = sorted(set().union(*[raw for texts in raws.values() for raw in texts]))
        self.column = np.full(256, len(used), dtype=np.int32)
        self.column[used] = np.arange(len(used))
        self.width = len(used) + 1
        unseen = max(1, 256 - len(used))
        bits = np.empty((len(states), self.width, len(self.langs)), dtype=np.float32)
        for li, lang in enumerate(self.langs):
            tree = _tree(raws[lang], known)
            prob = np.full((len(states), self.width), 1 / 256)
            for si, context in enumerate(states):
                if context:
                    prob[si] = prob[number[context[1:]]]
                seen = tree.get(context)
                if not seen:
                    continue
                at = self.column[list(seen)]
                counts = np.array(list(seen.values()), dtype=np.float64)
                total, kinds = counts.sum(), len(counts)
                base = prob[si]
                # The mass of the shorter context that exclusion leaves, all unseen bytes counted.
                left = base.sum() - base[at].sum() + base[-1] * (unseen - 1)
                p = base * (kinds / (total + kinds)) / max(left, 1e-12)
                p[at] = counts / (total + kinds)
                prob[si] = p
            np.maximum(prob, 1e-12, out=prob)
            bits[:, :, li] = np.negative(np.log2(prob, out=prob), out=prob)
        self.bits = bits.reshape(len(states) * self.width, len(self.langs))
        self.step = np.zeros((len(states), self.width), dtype=np.int32)
        longer = defaultdict(list)
        for context in states[1:]:
            longer[context[:-1]].append(context)
        for si, context in enumerate(states):
            if context:
                self.step[si] = self.step[number[context[1:]]]
            for grown in longer[context]:
                self.step[si, self.column[grown[-1]]] = number[grown]
        self.step = self.step.reshape(-1)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text under every language; stretches of all texts run side by side."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        total = np.zeros((len(texts), len(self.langs)))
        joined = self.column[np.frombuffer(b"".join(texts), dtype=np.uint8)].astype(np.int32)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        inside = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
        for lane in range(0, len(owner), LANES):
            own, off = owner[lane:lane + LANES], inside[lane:lane + LANES]
            first, end = starts[own] + off, starts[own] + np.minimum(off + STRETCH, sizes[own])
            begin = np.maximum(first - ORDER, starts[own])
            order = np.argsort(begin - end, kind="stable")  # longest first: lanes end one by one
            own, first, end, begin = own[order], first[order], end[order], begin[order]
            state = np.zeros(len(own), dtype=np.int64)
            sums = np.zeros((len(own), len(self.langs)), dtype=np.float64)
            lengths = end - begin
            for t in range(int(lengths[0])):
                n = int(np.searchsorted(-lengths, -t, side="left"))
                at = begin[:n] + t
                cell = state[:n] * self.width + joined[at]
                if t < ORDER:
                    cost = np.where((at >= first[:n])[:, None], self.bits[cell], 0.0)
                    sums[:n] += cost
                else:
                    sums[:n] += self.bits[cell]
                state[:n] = self.step[cell]
            np.add.at(total, own, sums)
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        picked = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.langs else []
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if picked:
            raw = [texts[i].encode("utf-8", "surrogatepass") for i in picked]
            bits = self.code_lengths(raw)
            sizes = np.array([len(t) for t in raw], dtype=np.float64)
            ahead = (bits - bits.min(axis=1, keepdims=True)) / sizes[:, None]
            weight = np.exp2(-ahead * np.minimum(sizes, EVIDENCE)[:, None])
            best = bits.argmin(axis=1)
            scores[picked] = 1 / weight.sum(axis=1)
            for i, b in zip(picked, best, strict=True):
                names[i] = self.langs[b]
        return names, scores


_QUICK = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_QUICK.search(text)) or any(map(str.isalpha, text))


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text",
          id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    return Model(sample(labelled, lang_col, text_col, id_col, rows))


def identify(docs: DataFrame, model: Model, text_col: str = "text",
             lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """All columns of ``docs`` plus the predicted language and its score; a name that is taken
    gets underscores in front."""
    lang_name, score_name = fresh(docs, lang_name), fresh(docs, score_name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()),
                           T.StructField(score_name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch.column(where)):
                names, scores = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, len(texts)).columns, pa.array(names, pa.string()),
                     pa.array(scores)], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text has a letter."""
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([has_letter(t) for _, texts in text_slices(
                batch.column(where)) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: Column | str, parts: int, part: int) -> Column:
    """Whether crc32 of the id's text has this remainder; a null id counts as the empty text."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % parts == part


ship(__name__)

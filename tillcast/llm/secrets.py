"""Secret scan in plain column expressions.

Three fixed rules give the base spans. On top, candidate strings (unbroken
runs of key-like characters) are searched with a sliding window: the window's
character counts are updated by the character that enters and the one that
leaves, and with them the sum of c*log2(c) from which the Shannon entropy of
the window follows. Each character class has its own threshold: hexadecimal,
letters alone, letters and digits, and the wider base64 alphabet. A candidate whose best
window reaches the threshold becomes a span unless the allow-list knows it or
a base span covers part of it.

Positions count code points. A private-use character marks the ends of
matches while a text is being cut; if the text has it already, it is first
exchanged for another one, which no rule can match either.

Defined cases: a null text is the empty text; texts of any length are scanned
whole; of windows with equal entropy any will do, as only the value counts;
spans that start together are ordered by kind; an empty table gives an empty
result; repeated rows are scanned one by one; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import whole

# The base rules, and the least length of the whole match or its value.
RULES = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
               r"[A-Za-z0-9+/_.=-]+"),
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}
VALUE = (r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
         r"([A-Za-z0-9+/_.=-]+)$")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# Bits per character that a window of 20 must reach, by class of the candidate.
LIMITS = {"hexdigits": 3.0, "letters": 4.0, "alphanumeric": 3.6, "base64": 3.8}
# Known harmless strings: documentation keys, UUIDs, dates and number groups, words and
# numbers of at most four digits joined by signs (so any string of letters and signs that has a
# sign), one piece repeated. Letters alone are no exception: they have a limit of their own.
ALLOWED = (r"EXAMPLE|example|^[0-9_=/+-]*$"
           r"|^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
           r"|^(?=.*[/_=+-])[/_=+-]*(?:[A-Za-z]+|[0-9]{1,4})(?:[/_=+-]+(?:[A-Za-z]+|[0-9]{1,4}))*[/_=+-]*$"
           r"|^(.{1,8})\1+.?$")

MARK, OTHER = "\ue000", "\ue001"  # private use
SPAN = "struct<k:int,s:int,e:int>"


def _long_enough(kind: str) -> str:
    """A rule without captures, narrowed where that cannot change its matches: runs are
    taken whole, so a run that is too short holds no longer one."""
    return {"access": f"AKIA[A-Z0-9]{{{ACCESS_CHARS - 4},}}",
            "hex": f"[0-9a-f]{{{HEX_CHARS},}}"}.get(kind, RULES[kind])


def pieces(text: Column, pattern: str) -> Column:
    """The text cut before and after each match: every second piece is a match."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK)


def located(parts: Column, rank: int) -> Column:
    """``[(k, s, e, m)]``: the matches among the pieces with their code point offsets."""
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"),
                     F.array().cast("array<struct<k:int,s:int,e:int,m:string>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.char_length(part)
        span = F.struct(F.lit(rank).alias("k"), acc["at"].alias("s"), end.alias("e"),
                        part.alias("m"))
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"),
                        F.when(acc["hit"], F.concat(acc["out"], F.array(span)))
                        .otherwise(acc["out"]).alias("out"))

    return F.when(F.size(parts) > 1, F.aggregate(parts, start, step, lambda a: a["out"])).otherwise(
        start["out"])


def _plogp(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(F.greatest(count, F.lit(1)).cast("double"))).otherwise(0.0)


def best_entropy(word: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits per character, of the ``window``-wide windows.

    One pass: ``counts`` holds the window's characters by code, ``sum`` its
    total of c*log2(c). A step touches the count of one entering and one
    leaving character."""
    codes = F.transform(F.split(word, ""), lambda c: F.ascii(c) % 128)
    state = F.struct(
        F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"),
        F.lit(0.0).alias("best"), F.lit(0).alias("i"))

    def step(acc: Column, code: Column) -> Column:
        leaves = F.when(acc["i"] >= window, F.get(codes, acc["i"] - window)).otherwise(F.lit(-1))
        enter_n = F.get(acc["counts"], code)
        leave_n = F.coalesce(F.get(acc["counts"], leaves), F.lit(0))
        change = F.when(leaves == code, F.lit(0.0)).otherwise(
            _plogp(enter_n + 1) - _plogp(enter_n)
            + F.when(leaves >= 0, _plogp(leave_n - 1) - _plogp(leave_n)).otherwise(0.0))
        total = acc["sum"] + change
        bits = F.when(acc["i"] >= window - 1,
                      F.log2(F.lit(float(window))) - total / window).otherwise(0.0)
        counts = F.transform(acc["counts"], lambda n, j: n + F.when(j == code, 1).otherwise(0)
                             - F.when(j == leaves, 1).otherwise(0))
        return F.struct(counts.alias("counts"), total.alias("sum"),
                        F.greatest(acc["best"], bits).alias("best"), (acc["i"] + 1).alias("i"))

    return F.aggregate(codes, state, step, lambda a: a["best"])


def suspicious(word: Column) -> Column:
    """Whether a candidate's entropy says secret and no allow-list entry says otherwise."""
    limit = (F.when(word.rlike("^[0-9a-fA-F]+$"), LIMITS["hexdigits"])
             .when(word.rlike("^[A-Za-z]+$"), LIMITS["letters"])
             .when(word.rlike("^[0-9A-Za-z]+$"), LIMITS["alphanumeric"])
             .otherwise(LIMITS["base64"]))
    return F.when(~word.rlike(ALLOWED), best_entropy(word) >= limit).otherwise(F.lit(False))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"),
                                                 x["e"].alias("e"))).cast(f"array<{SPAN}>")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, base, extra``: arrays of (kind, start, end), kinds numbered assign 0,
    access 1, hex 2, entropy 3; each array in order of start, then kind."""
    text = F.replace(whole(text_col), F.lit(MARK), F.lit(OTHER))
    cut = docs.select(
        F.col(id_col).alias("_id"),
        *[pieces(text, _long_enough(kind)).alias(kind) for kind in RULES],
        pieces(text, CANDIDATE).alias("entropy"))
    found = cut.select("_id", *[located(F.col(kind), rank).alias(kind)
                                for rank, kind in enumerate([*RULES, "entropy"])])
    kept = found.select(
        "_id", "entropy", F.array_sort(F.concat(
            _plain(F.filter("assign", lambda x: F.char_length(
                F.regexp_extract(x["m"], VALUE, 1)) >= ASSIGN_CHARS)),
            _plain(F.col("access")), _plain(F.col("hex"))), _by_start).alias("base"))
    extra = F.filter("entropy", lambda x: ~F.exists(
        "base", lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])) & suspicious(x["m"]))
    return kept.select(F.col("_id").alias(id_col), "base", _plain(extra).alias("extra"))


def _by_start(a: Column, b: Column) -> Column:
    return (F.when(a["s"] != b["s"], F.when(a["s"] < b["s"], -1).otherwise(1))
            .when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` items, comma-joined."""
    names = F.array(*[F.lit(k) for k in [*RULES, "entropy"]])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per rule, digest of the base spans, and all spans as text."""
    spans = secret_spans(docs, id_col, text_col)
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(RULES)]
    return spans.select(
        id_col, *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", "extra"), _by_start)).alias("spans"),
        F.size("extra").cast("long").alias("n_entropy"))

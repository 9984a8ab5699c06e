"""Conversations from reply trees.

Messages name their parent. Self-joins that double their reach (parent,
grandparent, then four, eight ... generations up) list every leaf's path to
its root in as many rounds as the depth has binary digits. Paths are ranked by
the mean score of their messages, the best ones of each tree are chosen, and
each is formatted as one conversation with a loss mask over the assistant's
texts.

Template: ``<s>[INST]role[/INST]text</s>`` per turn. In roles and texts ``&``,
``<`` and ``[`` are written ``&amp;``, ``&lt;`` and ``&lsqb;``, so no control
string can occur inside them and reading back is exact.

Defined cases: a null text or role is the empty one; null scores count 0; a
message whose parent is missing from its tree is a root; messages that name
each other in a circle lie on no path from a root and give no conversation;
equal scores go to the smaller leaf id; rows with the same turn are ordered by
role, then text; a null conversation id is a conversation of its own; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.common import ship, whole, with_key_facts, written

ROLE, TEXT, END = "<s>[INST]", "[/INST]", "</s>"
_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;")]
RANGE = 1024  # turns that are numbered, or become one string, together
_TURN = re.compile(r"<s>\[INST\]([^<\[]*)\[/INST\]([^<\[]*)</s>")


def escape(text: str) -> str:
    for sign, name in _ESCAPES:
        text = text.replace(sign, name)
    return text


def escaped(text: str) -> Column:
    """``escape`` of a column."""
    out = F.col(text)
    for sign, name in _ESCAPES:
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def joined(pieces: Column) -> Column:
    """The strings ``s`` of ordered structs as one."""
    return F.array_join(F.transform(pieces, lambda p: p["s"]), "")


def unescape(text: str) -> str:
    for sign, name in reversed(_ESCAPES):
        text = text.replace(name, sign)
    return text


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """One string for (role, text) turns, and the ranges of it that count for the loss."""
    parts, mask, size = [], [], 0
    for role, text in turns:
        head, body = f"{ROLE}{escape(role)}{TEXT}", escape(text)
        if role == "assistant":
            mask.append((size + len(head), size + len(head) + len(body)))
        parts += [head, body, END]
        size += len(head) + len(body) + len(END)
    return "".join(parts), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; anything else in it is an error."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not a formatted conversation")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def masked_text(formatted: str, mask: list[tuple[int, int]]) -> str:
    return "".join(unescape(formatted[s:e]) for s, e in mask)


def linear(turns: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """Messages of unbranched conversations: each turn replies to the one before it.

    Turns are numbered inside ranges of turn values, and the ranges' counts add up, so that no
    task sorts the whole of a long conversation."""
    rows = turns.select(F.col(tree).cast("long").alias("_tree"), F.col(turn).alias("_turn"),
                        whole(role).alias("role"), whole(text).alias("text"))
    whole_number = isinstance(rows.schema["_turn"].dataType, T.IntegralType)
    rows = rows.withColumn("_range", F.floor(F.col("_turn") / RANGE) if whole_number
                           else F.lit(0).cast("long"))
    order = Window.partitionBy("_tree", "_range").orderBy("_turn", "role", "text")
    before = Window.partitionBy("_tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_tree", "_range").count().select(
        F.col("_tree").alias("_t"), F.col("_range").alias("_r"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    numbered = rows.withColumn("_place", F.row_number().over(order)).join(
        starts, F.col("_tree").eqNullSafe(F.col("_t")) & F.col("_range").eqNullSafe(F.col("_r")))
    numbered = numbered.withColumn("_id", F.col("_start") + F.col("_place"))
    return numbered.select("_tree", "_id", F.when(F.col("_id") > 1, F.col("_id") - 1).alias("_parent"),
                           "role", "text", F.lit(0.0).alias("_score"))


def messages(rows: DataFrame, tree: str, number: str, parent: str, role: str, text: str,
             score: str) -> DataFrame:
    """Messages of reply trees in the form the other functions take."""
    return rows.select(
        F.col(tree).cast("long").alias("_tree"), F.col(number).cast("long").alias("_id"),
        F.col(parent).cast("long").alias("_parent"), whole(role).alias("role"),
        whole(text).alias("text"),
        F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("_score"))


def paths(said: DataFrame) -> DataFrame:
    """``(_tree, _leaf, _id, _up)``: the messages of every root-to-leaf path, with their
    distance from the leaf.

    A round's one join takes both the paths found so far and the replies themselves further up,
    and is written once."""
    nodes = said.select("_tree", "_id", "_parent").dropDuplicates(["_tree", "_id"])
    known = nodes.select("_tree", F.col("_id").alias("_parent"))
    same = [F.col("a._tree").eqNullSafe(F.col("b._tree"))]
    up = written(nodes.alias("a").join(known.alias("b"), [*same, F.col("a._parent") == F.col("b._parent")])
                 .select("a._tree", "a._id", F.col("a._parent").alias("_to")), "replies")
    leaves = nodes.alias("a").join(up.alias("b"), [*same, F.col("a._id") == F.col("b._to")],
                                   "left_anti")
    steps = written(leaves.select("_tree", F.col("_id").alias("_leaf"), "_id",
                                  F.lit(0).cast("long").alias("_up")), "paths")
    roots = nodes.alias("a").join(up.alias("b"), [*same, F.col("a._id") == F.col("b._id")],
                                  "left_anti")
    most = nodes.groupBy("_tree").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach <= most and not up.isEmpty():
        ahead = steps.select("_tree", "_leaf", "_up", F.col("_id").alias("_at")).unionByName(
            up.select("_tree", F.col("_id").alias("_leaf"), F.lit(-1).cast("long").alias("_up"),
                      F.col("_to").alias("_at")))
        moved = written(ahead.alias("a").join(up.alias("b"), [*same, F.col("a._at") == F.col("b._id")])
                        .select("a._tree", "a._leaf", F.col("b._to").alias("_id"), "a._up"), "moved")
        steps = steps.unionByName(moved.where("_up >= 0").withColumn("_up", F.col("_up") + reach))
        up = moved.where("_up < 0").select("_tree", F.col("_leaf").alias("_id"),
                                           F.col("_id").alias("_to"))
        reach *= 2
    if not up.isEmpty():  # only a circle is longer than its tree has messages
        rooted = steps.alias("a").join(roots.alias("b"), [
            *same, F.col("a._id") == F.col("b._id")]).select("a._tree", "a._leaf")
        steps = steps.alias("a").join(rooted.alias("b"), [
            *same, F.col("a._leaf") == F.col("b._leaf")], "left_semi")
    return steps


def ranked(said: DataFrame, found: DataFrame, best: int | None = 1) -> DataFrame:
    """``(_tree, _leaf, rank)``: the ``best`` paths of each tree (None: all), by mean score."""
    scores = said.select("_tree", "_id", "_score").dropDuplicates(["_tree", "_id"])
    rated = found.alias("a").join(scores.alias("b"), [
        F.col("a._tree").eqNullSafe(F.col("b._tree")), F.col("a._id") == F.col("b._id")]).groupBy(
        "a._tree", "a._leaf").agg(F.avg("b._score").alias("_mean"))
    if best == 1:  # no task sees all leaves of a tree
        top = rated.groupBy("_tree").agg(F.max(F.struct("_mean", -F.col("_leaf"))).alias("_top"))
        return top.select("_tree", (-F.col("_top").getField("col2")).alias("_leaf"),
                          F.lit(1).alias("rank"))
    order = Window.partitionBy("_tree").orderBy(F.desc("_mean"), "_leaf")
    placed = rated.withColumn("rank", F.row_number().over(order))
    return (placed if best is None else placed.where(F.col("rank") <= best)).select(
        "_tree", "_leaf", "rank")


def conversations(said: DataFrame, best: int | None = 1) -> DataFrame:
    """``conv_id, leaf, rank, formatted, mask``: each chosen path as one conversation.

    Turns are escaped while they are rows. Stretches of ``RANGE`` turns become a string each,
    with the mask inside them, and only those strings meet in the conversation's row."""
    said = written(said, "messages")
    found = written(paths(said), "found").withColumn("_path", F.struct("_tree", "_leaf"))
    chosen = ranked(said, found.drop("_path"), best).select(
        F.struct("_tree", "_leaf").alias("_path"), "rank")
    texts = said.dropDuplicates(["_tree", "_id"]).select(
        "_tree", "_id", F.concat(F.lit(ROLE), escaped("role"), F.lit(TEXT)).alias("head"),
        escaped("text").alias("body"), (F.col("role") == "assistant").alias("learnt"))
    turns = (with_key_facts(found, "_path", "_id", chosen).alias("c")
             .join(texts.alias("d"), [F.col("c._tree").eqNullSafe(F.col("d._tree")),
                                      F.col("c._id") == F.col("d._id")])
             .select("c._tree", "c._leaf", "c.rank", (-F.col("c._up")).alias("at"),
                     (-F.floor(F.col("c._up") / RANGE)).alias("part"), "d.head", "d.body", "d.learnt"))
    size, tail = F.char_length("head") + F.char_length("body") + len(END), len(END)
    so_far = Window.partitionBy("_tree", "_leaf", "part").orderBy("at").rowsBetween(
        Window.unboundedPreceding, 0)
    placed = turns.withColumn("stop", F.sum(size).over(so_far))
    parts = placed.groupBy("_tree", "_leaf", "part", "rank").agg(
        joined(F.array_sort(F.collect_list(F.struct(
            "at", F.concat("head", "body", F.lit(END)).alias("s"))))).alias("s"),
        F.array_sort(F.collect_list(F.when(F.col("learnt"), F.struct(
            (F.col("stop") - tail - F.char_length("body")).alias("start"),
            (F.col("stop") - tail).alias("end"))))).alias("mask"), F.max("stop").alias("size"))
    earlier = Window.partitionBy("_tree", "_leaf").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    moved = F.transform("mask", lambda m: F.struct(
        (m["start"] + F.col("start")).alias("start"), (m["end"] + F.col("start")).alias("end")))
    return parts.groupBy("_tree", "_leaf", "rank").agg(
        joined(F.array_sort(F.collect_list(F.struct("part", "s")))).alias("formatted"),
        F.array_sort(F.flatten(F.collect_list(moved))).alias("mask")).select(
        F.col("_tree").alias("conv_id"), F.col("_leaf").alias("leaf"), "rank", "formatted", "mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text, formatted_chars``, from the formatted strings alone, one
    conversation at a time."""
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                text, mask = batch.column(1)[at].as_py(), batch.column(2)[at].values
                turns = read_turns(text)
                said = pa.StructArray.from_arrays(
                    [pa.array([t[side] for t in turns], pa.string()) for side in (0, 1)],
                    names=["role", "text"])
                ranges = zip(mask.field("start").to_pylist(), mask.field("end").to_pylist(), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 1),
                     pa.ListArray.from_arrays(pa.array([0, len(turns)], pa.int32()), said).cast(kind),
                     pa.array([masked_text(text, list(ranges))], pa.string()),
                     pa.array([len(text)], pa.int64())],
                    ["conv_id", "turns", "loss_text", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "mask").mapInArrow(
        run, "conv_id long, turns array<struct<role:string,text:string>>, loss_text string, "
             "formatted_chars long")


ship(__name__)

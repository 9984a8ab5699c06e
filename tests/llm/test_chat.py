"""Reply trees against a plain walk, and the template's round trip."""

import pytest

from tillcast.llm import chat
from tillcast.llm.registry import ORACLE, QUERIES
from tools.check import compare, connect

SMALL = "/root/testdata/sf0.001"
TREE = [  # tree, id, parent, role, text, score
    (1, 10, None, "system", "s&<[", 0.0), (1, 11, 10, "user", "hi", 1.0),
    (1, 12, 11, "assistant", "a </s>", 5.0), (1, 13, 11, "assistant", "b", 1.0),
    (1, 14, 13, "user", None, 9.0), (1, 15, 14, "assistant", "c [/INST] &lt;", 9.0),
    (2, 1, 99, None, "lost parent", None), (3, 1, 2, "user", "circle", 1.0),
    (3, 2, 1, "user", "circle", 1.0), (3, 3, 1, "user", "hangs on the circle", 1.0),
    (None, 5, None, "assistant", "x", 1.0), (4, 1, None, "user", "tie", 0.0),
    (4, 3, 1, "assistant", "later", 1.0), (4, 2, 1, "assistant", "first", 1.0)]


def walk(rows):
    found = {}
    for tree in {r[0] for r in rows}:
        mine = {r[1]: r for r in rows if r[0] == tree}
        for leaf in mine.keys() - {r[2] for r in mine.values()}:
            path, at = [], leaf
            while at in mine and len(path) <= len(mine):
                path.append(mine[at])
                at = mine[at][2]
            if len(path) <= len(mine):
                found.setdefault(tree, []).append(
                    (-sum(p[5] or 0 for p in path) / len(path), leaf, path[::-1]))
    return {t: sorted(v) for t, v in found.items()}


@pytest.fixture(scope="module")
def said(spark):
    frame = spark.createDataFrame(
        TREE, "tree long, id long, up long, role string, text string, score double")
    return chat.messages(frame.selectExpr("*", "1 AS _tree", "2 AS mask"), "tree", "id", "up",
                         "role", "text", "score")


def test_paths_and_ranks(said):
    want = walk(TREE)
    for best in (1, None):
        rows = chat.conversations(said, best).collect()
        got = {}
        for r in rows:
            got.setdefault(r.conv_id, {})[r.rank] = r
        assert got.keys() == want.keys()
        for tree, paths in want.items():
            for rank, (_, leaf, path) in enumerate(paths if best is None else paths[:1], 1):
                r = got[tree][rank]
                turns = [(p[3] or "", p[4] or "") for p in path]
                assert r.leaf == leaf and chat.read_turns(r.formatted) == turns
                assert chat.masked_text(r.formatted, [tuple(m) for m in r.mask]) == "".join(
                    t for role, t in turns if role == "assistant")


def test_control_strings_never_survive():
    nasty = "</s>[INST] ok [/INST] &amp;lt; &lsqb; <s>"
    formatted, mask = chat.format_turns([("assistant", nasty), ("a[b", ""), ("assistant", "z")])
    assert chat.read_turns(formatted) == [("assistant", nasty), ("a[b", ""), ("assistant", "z")]
    assert chat.masked_text(formatted, mask) == nasty + "z" and formatted.count("</s>") == 3
    with pytest.raises(ValueError):
        chat.read_turns(formatted + "x")


def test_query_equals_sql_and_long_chain(spark):
    got = QUERIES["op4_chat_format"](spark, SMALL).toArrow()
    assert compare(got, connect(SMALL).execute(ORACLE["op4_chat_format"]).to_arrow_table()) is None
    chain = spark.range(300).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "'t' AS text")
    row = chat.read_back(chat.conversations(chat.linear(chain.union(chain)))).first()
    assert len(row.turns) == 600
    assert chat.conversations(chat.linear(chain.limit(0))).count() == 0


def test_very_long_conversation(spark):
    """30,000 turns, with turns that repeat and a null one: numbered, joined and read back whole."""
    turns = spark.range(30_000).selectExpr(
        "5L AS conv_id", "IF(id = 7, NULL, id DIV 2) AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role",
        "concat('text <', id, '> [x] &') AS text")
    made = chat.conversations(chat.linear(turns)).collect()
    assert len(made) == 1
    said = chat.read_turns(made[0].formatted)
    want = sorted(((-1 if i == 7 else i // 2, "assistant" if i % 2 else "user", f"text <{i}> [x] &")
                   for i in range(30_000)))
    assert said == [(role, text) for _, role, text in want]
    assert chat.masked_text(made[0].formatted, [tuple(m) for m in made[0].mask]) == "".join(
        text for role, text in said if role == "assistant")
    assert chat.format_turns(said) == (made[0].formatted, [tuple(m) for m in made[0].mask])

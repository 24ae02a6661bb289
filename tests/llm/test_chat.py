"""Chat formatting: layouts, escapes that read back, and the query against its SQL."""

import hashlib
import json

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citespan.llm import chat

TEXTS = st.text(alphabet="ab\\<>/turn#: \n=é\U0001d11eh", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool"]), TEXTS), TEXTS), max_size=5))
def test_render_reads_back(turns):
    out = chat.render(turns)
    assert [(r, t) for r, t, _, _ in chat.parse(out)] == turns
    assert all(chat.unescape(out[s:e]) == t for _, t, s, e in chat.parse(out))


@pytest.mark.parametrize(
    "record,layout,turns",
    [
        ({"messages": [{"role": "human", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 1}, "messages", [("user", "a"), ("assistant", "b")]),
        ({"system": "s", "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "conversations", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "input": None, "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"prompt": "p", "completion": "c", "score": 3}, "prompt completion", [("user", "p"), ("assistant", "c")]),
        ({"data": {"prompt": "p", "response": "r"}}, "nested", [("user", "p"), ("assistant", "r")]),
        ({"question": "q", "answer": "a", "context": "c"}, "question answer", [("user", "c\n\nq"), ("assistant", "a")]),
        ({"foo": 1}, "", []), ({}, "", []),
        ({"messages": [{"role": "user", "content": "a"}, None, "b", 3]}, "messages", [("user", "a")]),
        ({"messages": [{"role": "user", "content": "a"}], "prompt": "p"}, "messages", [("user", "a")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image_url", "image_url": {"url": "u"}}, "b"]}]}, "messages", [("user", "a\n\nb")]),
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": [{"type": "text", "text": "b"}]}]}, "messages", [("user", "a"), ("assistant", "b")]),
        ({"prompt": "\ud800p", "completion": "\udc00", "system": "é"}, "prompt completion", [("system", "é"), ("user", "\ufffdp"), ("assistant", "\ufffd")]),
        ({"prompt": "p", "completion": "c", "response": "r"}, "prompt completion", [("user", "p"), ("assistant", "c")]),
        ({"conv_id": 1, "turn": 0, "role": "gpt", "text": "t", "prompt": "x"}, "rows", [("assistant", "t")]),
    ],
)
def test_layouts(record, layout, turns):
    assert chat.record_turns(json.dumps(record))[1:] == (layout, turns)


LEAVES = st.one_of(st.none(), st.booleans(), st.integers(), st.floats(), st.text(max_size=5), st.sampled_from(["\ud800", "</turn>", "user"]))
KEYS = st.sampled_from(["messages", "role", "content", "conversations", "from", "value", "prompt", "completion", "response", "data", "system", "text", "type", "conv_id", "turn", "x"])
VALUES = st.recursive(LEAVES, lambda kids: st.lists(kids, max_size=3) | st.dictionaries(KEYS, kids, max_size=4), max_leaves=12)


@given(VALUES)
def test_no_record_breaks_the_reading(value):
    mark, layout, turns = chat.record_turns(json.dumps(value))
    assert all(isinstance(x, str) for t in turns for x in t) and (layout or not turns)
    for role, text in turns:
        (role + text).encode()
    assert [(r, t) for r, t, _, _ in chat.parse(chat.render(turns))] == turns


def test_deep_records():
    assert chat.record_turns('{"prompt":' + "[" * 50_000 + "]" * 50_000 + ',"completion":"c"}')[2] in ([], [("assistant", "c")])
    assert chat.record_turns("[" * 5000)[1:] == ("", [])


def test_a_table_with_clashing_columns(frame):
    df = frame([(1, 0, "user", "t", "p", "s")], "conv_id long, turn long, role string, text string, prompt string, system string")
    assert [tuple(r) for r in chat.rows_of_table(df).collect()] == [(1, 0, "user", "t")]
    with pytest.raises(ValueError):
        chat.rows_of_table(frame([(1, "p")], "conv_id long, prompt string"))


def test_records_and_bad_input(frame):
    rows = [(1, '{"prompt":"p","completion":"c"}', "x"), (2, None, "y"), (3, "{", "z"), (4, "[1]", "z"), (1, '{"prompt":"p","completion":"c"}', "x")]
    got = chat.turns_of_records(frame(rows, "id int, record string, turns string").withColumnRenamed("turns", "other")).collect()
    assert len(got) == 5 and sorted((r.id, r.layout, len(r.turns)) for r in got) == [(1, "prompt completion", 2), (1, "prompt completion", 2), (2, "", 0), (3, "", 0), (4, "", 0)]


def test_digests_of_edge_cases(frame):
    rows = [(1, 0, "user", None), (1, 1, "assistant", chat.PLANTED), (1, 1, "assistant", chat.PLANTED), (2, 0, None, ""), (None, 0, "assistant", "x" * 50000), (3, None, "odd: role", "t")]
    df = frame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_rows(chat.rows_of_table(df))).collect()}
    want = hashlib.sha256(f"user\n\nassistant\n{chat.PLANTED}\nassistant\n{chat.PLANTED}\n".encode()).hexdigest()
    assert got[1].turns_sha256 == want and got[1].loss_chars == 2 * len(chat.PLANTED) and got[1].n_turns == 3
    assert got[2].loss_sha256 == hashlib.sha256(b"").hexdigest() and got[None].loss_chars == 50000 and got[3].turns_sha256 == hashlib.sha256(b"odd: role\nt\n").hexdigest()
    assert chat.digests(chat.format_rows(chat.rows_of_table(df.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        chat.rows_of_table(df.drop("role"))


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    names = "conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars"
    want = db.sql(f"SELECT {names} FROM ({chat.OP1_SQL})").fetchall()
    assert sorted(tuple(r) for r in chat.op1_chat(spark, sf).select(*names.split(", ")).collect()) == sorted(want)

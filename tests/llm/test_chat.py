import json

from quern.llm.chat import call_levels, conversations, format_chat

SCHEMAS = {"weather": {"properties": {"city": {"type": "string"}, "days": {"type": "number"}, "flags": {"type": "array"}}, "required": ["city"], "additionalProperties": False}, "now": {}}


def calls(*items, content=None):
    return json.dumps({"content": content, "tool_calls": [dict(zip(("id", "name", "arguments", "depends_on"), i)) for i in items]})


def answer(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


ROWS = [
    (1, 0, "system", "Be brief."),
    (1, 1, "user", 'Say "ä" \n{'),
    (1, 2, "assistant", calls(("a", "weather", {"days": 2, "city": "Bärn"}, ["b"]), ("b", "now", {}), ("z", "weather", {"city": 3, "x": 1}), content="Looking.")),
    (1, 3, "tool", answer("a", "rain")),
    (1, 4, "tool", answer("b", "noon")),
    (1, 5, "tool", answer("b", "again")),
    (1, 6, "tool", answer("q", "what")),
    (1, 7, "tool", "plain"),
    (2, 0, "tool", answer("a", "early")),
    (2, 1, "assistant", calls(("a", "none", {}, ["c"]), ("c", "now", [1], ["a"]), ("d", "now", {}, ["gone"]))),
    (None, 0, "assistant", calls(("a", "now", {}))),
    (None, 1, "tool", answer("a", "x")),
    (3, None, None, None),
    (3, None, None, None),
    (4, 1, "assistant", "{not json"),
    (5, 1, "user", "long " * 50000),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_links_orders_and_validates(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA + ", status string").repartition(4)
    got = format_chat(df, SCHEMAS).collect()
    assert len(got) == len(ROWS)
    by = {(r.conv_id, r.turn): r for r in got}
    assert [by[1, t].status for t in range(3, 8)] == ["linked", "linked", "duplicate", "orphan", "unmarked"]
    assert (by[1, 2].n_calls, by[1, 2].n_answered, by[1, 2].n_errors) == (3, 2, 2)  # city is not a string, x is unknown
    assert by[2, 0].status == "early" and (by[2, 1].n_answered, by[2, 1].n_errors) == (0, 1 + 1 + 2)
    assert by[None, 1].status == "orphan"
    one = json.loads(next(r.messages for r in conversations(format_chat(df, SCHEMAS)).collect() if r.conv_id == 1))
    # what b says comes before what waits for it
    assert [m.get("content") for m in one] == ["Be brief.", 'Say "ä" \n{', "Looking.", "noon", "again", "rain", "what", "plain"]
    assert by[1, 2].message == '{"content":"Looking.","role":"assistant","tool_calls":[{"arguments":{"city":"Bärn","days":2},"id":"a","name":"weather"},{"arguments":{},"id":"b","name":"now"},{"arguments":{"city":3,"x":1},"id":"z","name":"weather"}]}'
    assert by[1, 3].message == '{"content":"rain","role":"tool","tool_call_id":"a"}'
    assert by[4, 1].message == '{"content":"{not json","role":"assistant"}'
    assert by[3, None].message == '{"content":"","role":"unknown"}'


def test_empty_table(spark):
    assert format_chat(spark.createDataFrame([], SCHEMA)).count() == 0


def test_levels_follow_chains_and_mark_cycles(spark):
    rows = [(1, "a", []), (1, "b", ["a", "a"]), (1, "c", ["b", "a"]), (1, "d", ["e"]), (1, "e", ["d"]), (1, "f", ["e"]), (2, "a", None), (2, "b", ["zz"])]
    got = {(r.conv_id, r.id): r.level for r in call_levels(spark.createDataFrame(rows, "conv_id long, id string, depends_on array<string>")).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): None, (1, "e"): None, (1, "f"): None, (2, "a"): 0, (2, "b"): 0}


def test_levels_equal_those_of_a_walk(spark):
    import random

    rng = random.Random(6)
    rows = []
    for conv in range(12):
        n = 40
        names = [f"k{i}" for i in range(n)]
        for i, name in enumerate(names):
            kind = rng.random()
            waits = [] if kind < 0.1 else [names[i - 1]] if kind < 0.75 and i else rng.sample(names[:i], min(i, 3))
            rows.append((conv, name, waits + (["nowhere"] if kind > 0.9 else []) + ([names[rng.randrange(n)]] if conv > 8 and kind > 0.95 else [])))
    rows += [(99, f"c{i}", [f"c{i - 1}"]) for i in range(100)]
    graph = {(c, i): [(c, w) for w in ws if (c, w) in {(a, b) for a, b, _ in rows}] for c, i, ws in rows}
    want, left = {}, dict(graph)
    while ready := [k for k, ws in left.items() if all(w in want for w in ws)]:
        for k in ready:
            want[k] = max((want[w] + 1 for w in left.pop(k)), default=0)
    got = {(r.conv_id, r.id): r.level for r in call_levels(spark.createDataFrame(rows, "conv_id long, id string, depends_on array<string>")).collect()}
    assert got == {k: want.get(k) for k in graph} and got[99, "c99"] == 99


def test_a_level_takes_one_write(spark, monkeypatch):
    from quern.llm import chat

    written, real = [], chat.materialise
    monkeypatch.setattr(chat, "materialise", lambda df, label: written.append(label) or real(df, label))
    monkeypatch.setattr(chat, "UNITED", 4, raising=False)
    # Each waits for the two before it; x and y wait for each other, z for y and an answered one.
    rows = [(1, f"k{i}", [f"k{j}" for j in (i - 1, i - 2) if j >= 0]) for i in range(8)] + [(1, "x", ["y", "k0"]), (1, "y", ["x", "k1"]), (1, "z", ["y", "k2"])]
    got = {r.id: r.level for r in call_levels(spark.createDataFrame(rows, "conv_id long, id string, depends_on array<string>")).collect()}
    assert got == {f"k{i}": i for i in range(8)} | {"x": None, "y": None, "z": None}
    assert sum(x == "call-several" for x in written) == 6 and len(written) <= 6 + 2 + 4  # six levels, folded twice; the graph and the chains


def test_messages_are_linked_in_few_writes(spark, monkeypatch):
    from quern.llm import chat

    written, real = [], chat.materialise
    monkeypatch.setattr(chat, "materialise", lambda df, label: written.append(label) or real(df, label))
    got = format_chat(spark.createDataFrame(ROWS, SCHEMA), SCHEMAS).collect()
    assert len(got) == len(ROWS) and len([x for x in written if x != "call-chains"]) == 4  # messages, calls, graph, answers


def test_values_are_checked_at_any_depth(spark):
    from pyspark.sql import functions as F

    from quern.llm.chat import argument_errors

    schemas = {"t": {"properties": {
        "n": {"type": "integer", "minimum": 2, "maximum": 9}, "s": {"type": ["string", "null"], "minLength": 2, "maxLength": 3}, "e": {"enum": ["a", 1, {"k": []}]},
        "o": {"type": "object", "properties": {"x": {"type": "boolean"}}, "required": ["y"], "additionalProperties": False}, "l": {"type": "array", "items": {"type": "number"}},
    }}}
    cases = [
        ({"n": 5, "s": "ab", "e": {"k": []}, "o": {"y": 1, "x": True}, "l": [1, 2.5]}, ["unknown o.y"]),
        ({"n": 1, "s": None, "e": "b", "o": {"x": 1}, "l": ["a", 1, []]}, ["e is not in the list", "l[] is not number", "l[] is not number", "n is beyond its minimum", "missing o.y", "o.x is not boolean"]),
        ({"n": "9", "s": "a", "e": 1, "o": [], "l": {}}, ["l is not array", "n is not integer", "o is not object", "s is beyond its minLength"]),
        ({"n": 10, "s": "abcd"}, ["n is beyond its maximum", "s is beyond its maxLength"]),
        ([], ["arguments are not an object"]),
    ]
    df = spark.createDataFrame([(i, json.dumps(a)) for i, (a, _) in enumerate(cases)], "i int, a string")
    got = {r.i: r.e for r in df.select("i", argument_errors(F.lit("t"), F.col("a"), schemas).alias("e")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)}


def test_the_query_meets_every_status(spark):
    import os

    import pytest

    from quern.llm.queries import op8_chat

    sf = os.environ.get("QUERN_TEST_DATA", "/root/testdata") + "/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    rows = op8_chat(spark, sf).collect()
    assert {r.status for r in rows} == {"linked", "duplicate", "early", "orphan", "unmarked", None}
    assert any(r.n_errors for r in rows) and max(r.level for r in rows if r.level < 1 << 30) > 0

"""References between calls: long chains, cycles, several references, and ids that JSON has to escape."""

import json

import numpy as np

from phonolith.llm import chat, queries

CALLS = "conv_id long, turn long, call_id string, name string, arguments string"
FORMS = "name string, parameter string, type string, required boolean"


def levels(spark, calls):
    made = spark.createDataFrame([(1, i, c, "f", a) for i, (c, a) in enumerate(calls)], CALLS)
    forms = spark.createDataFrame([("f", "x", "array", False)], FORMS)
    none = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    return {r.call_id: (r.level, r.status) for r in chat.link(made, none, forms).collect()}


def refers(*ids):
    return json.dumps({"x": [{"deep": {"$ref": i}} for i in ids]})


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(chat, "written", lambda df, name, w=chat.written: (rounds.append(name), w(df, name))[1])
    found = levels(spark, [("c0", "{}"), *((f"c{i}", refers(f"c{i - 1}")) for i in range(1, 300)), ("loop", refers("pool")), ("pool", refers("loop")), ("on", refers("loop"))])
    assert all(found[f"c{i}"][0] == i for i in range(300))
    assert all(found[c] == (None, "cycle") for c in ("loop", "pool", "on"))
    assert rounds.count("chains") <= 11


def test_levels_are_a_walk(spark):
    rng = np.random.default_rng(5)
    parents = {i: sorted({int(x) for x in rng.integers(0, 60, rng.choice([0, 1, 1, 1, 2, 3]))} - {i}) for i in range(60)}
    for i in range(0, 60, 2):
        parents[i] = [p for p in parents[i] if p < i]
    want = {}
    while new := {i: 1 + max((want[p] for p in ps), default=-1) for i, ps in parents.items() if i not in want and all(p in want for p in ps)}:
        want |= new
    found = levels(spark, [(str(i), refers(*map(str, ps))) for i, ps in parents.items()])
    assert {i: found[str(i)][0] for i in parents} == {i: want.get(i) for i in parents} and len(want) < 60


def test_references_to_escaped_ids(spark):
    odd = ['a"b', "back\\", "é\n", '","$ref":"', "tab\t", "{", " "]
    calls = [(c, "{}") for c in odd] + [(f"to {i}", refers(c)) for i, c in enumerate(odd)]
    calls += [("escaped", '{"x":[{"\\u0024ref":"\\u0061\\"b"}]}'), ("blanks", '{ "x" : [ { "$ref" :\n"a\\"b" } ] }')]
    calls += [("text", json.dumps({"x": ['{"$ref":"a\\"b"}', '{"$ref":"{"}']})), ("key", json.dumps({"x": [{'y"$ref': "{"}]})), ("number", '{"x":[{"$ref":1}]}'), ("1", "{}")]
    found = levels(spark, calls)
    assert all(found[f"to {i}"][0] == 1 for i in range(len(odd)))
    assert [found[c][0] for c in ("escaped", "blanks", "text", "key", "number")] == [1, 1, 0, 0, 0]


def test_turns_without_numbers_or_below_zero(spark):
    rows = [(1, -2, "user", "below 0"), (1, -1, "assistant", "answers"), (1, None, "user", "no turn"), (None, 0, "user", "no conversation"), (1, 0, "user", None), (1, 2, "user", "half 1."), (1, 4, "user", "half 2."), (1, 4, "user", "half 2."), (2, 7, "assistant", "lost"), (1, 9, "tool", "x")]
    calls, results = chat.calls_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    forms = spark.createDataFrame(queries.REPLY_SCHEMA, FORMS)
    out = sorted(chat.link_all(calls, results, forms).select("turn", "n", "call_id", "level", "status").collect())
    assert [tuple(r) for r in out] == [(-2, 1, '1:"-2"\\', 0, "ok"), (0, 1, "1:0", 0, "no result"), (2, 1, '1:"2"\\', 0, "no result"), (4, 1, "1:4", 1, "no result"), (4, 2, "1:4", None, "repeated id"), (7, 1, '2:"6"\\', None, "no call")]
    empty = chat.link_all(calls.limit(0), results.limit(0), forms)
    assert empty.count() == 0


def test_query_has_every_status_and_fault(spark):
    rows = queries.op2_chat_formatting(spark, "/root/testdata/sf0.01").collect()
    assert {r.status for r in rows} >= {"ok", "invalid", "cycle", "no result", "no call", "repeated id"}
    faults = {e for r in rows for e in r.errors.split(", ")}
    assert faults == {"", "no schema", "not integer number", "missing text", "unknown note"}
    assert all(json.loads(r.canonical)["id"] == r.call_id for r in rows)

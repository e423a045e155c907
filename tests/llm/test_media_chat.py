"""Matroska bytes and tool calls."""

import json
import struct

import pytest

from phonolith.llm import chat
from phonolith.llm import matroska as M


def test_round_trip_of_all_lengths(spark):
    for n in [*range(1, 40), 192, 193, 192 * 8, 192 * 9 + 5, 192 * 24 + 1, 192 * 300]:
        payload = bytes((i * 7 + n) % 256 for i in range(n))
        found = M.parse(M.mux(payload))
        assert found.error is None and found.codecs == {1: "A_PCM/INT/LIT"}
        data = M.mux(payload)
        assert b"".join(data[p.offset : p.offset + p.length] for p in found.packets) == payload
        assert [p.timestamp for p in found.packets] == [24.0 * i for i in range(len(found.packets))]
        assert {c for _, _, c in found.cues} == {p.cluster for p in found.packets}
    assert M.parse(M.mux(b"")).packets == []


def test_unknown_sizes_groups_and_other_tracks():
    block = lambda track, at, frames, lace=0: M.vint(track) + struct.pack(">hB", at, lace << 1) + frames
    cluster = M.element(M.TIMESTAMP, b"\x64") + M.element(M.SIMPLE_BLOCK, block(2, -4, b"abc")) + M.element(M.BLOCK_GROUP, M.element(M.BLOCK, block(300, 6, b"\x01" + b"\x02" + b"xyzzy", 1)))
    unknown = lambda name, body: name.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    found = M.parse(unknown(M.SEGMENT, unknown(M.CLUSTER, cluster) + unknown(M.CLUSTER, cluster)))
    assert found.error is None and [(p.track, p.timestamp, p.length) for p in found.packets] == [(2, 96.0, 3), (300, 106.0, 2), (300, 106.0, 3)] * 2


def test_broken_media_keep_what_came_before(spark):
    data = M.mux(bytes(192 * 20))
    for cut in range(0, len(data), 97):
        found = M.parse(data[:cut])
        assert len(found.packets) <= 20
    assert M.parse(b"\x00\x00").error and M.parse(b"") == M.Media([], {}, [], None)
    rows = spark.createDataFrame([(1, bytearray(data), "x"), (2, None, "x"), (3, bytearray(b"\x00"), "x")], "doc_id int, media binary, payload string")
    out = {r.doc_id: r for r in M.read_media(rows).collect()}
    assert len(out[1].packets) == 20 and out[1].error is None and out[2].error == "no media" and out[3].error


def test_vints():
    for n in [0, 1, 126, 127, 128, 16382, 16383, 2**21 - 2, 2**28]:
        assert M._read_vint(M.vint(n) + b"x", 0, False)[:2] == (n, len(M.vint(n)))
    with pytest.raises(ValueError):
        M._read_vint(b"\x00", 0, False)


SCHEMAS = [("f", "a", "integer", True), ("f", "b", "string", False), ("g", "x", "object", False)]


def link(spark, calls, results):
    made = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, level string")
    back = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string, status string")
    forms = spark.createDataFrame(SCHEMAS, "name string, parameter string, type string, required boolean")
    return {(r.conv_id, r.call_id): r for r in chat.link(made, back, forms).collect()}


def test_links_orders_checks_and_writes(spark):
    ref = lambda i: json.dumps({"a": 1, "b": "é\n", "z": 0} if i is None else {"x": {"$ref": i}})
    calls = [
        (1, 0, "p", "f", '{"b":"é\\n", "a": 1}', "-"), (1, 1, "q", "g", ref("p"), "-"), (1, 2, "r", "g", ref("q"), "-"), (1, 3, "s", "g", ref("elsewhere"), "-"),
        (1, 4, "u", "g", ref("v"), "-"), (1, 5, "v", "g", ref("u"), "-"), (1, 6, "w", "g", ref("v"), "-"), (1, 7, "bad", "f", '{"a":"1","c":2}', "-"), (1, 8, "none", "f", "{}", "-"),
        (1, 9, "json", "f", "not json", "-"), (1, 9, "null", "f", None, "-"), (1, 9, "what", "h", "{}", "-"), (2, 0, "p", "f", '{"a":2}', "-"), (2, 9, "p", "f", '{"a":9}', "-"), (None, 0, "p", "f", "{}", "-"), (3, 0, None, "f", "{}", "-"),
    ]
    results = [(1, 5, "p", "later", "-"), (1, 2, "p", "first", "-"), (1, 3, "q", None, "-"), (1, 4, "r", "", "-"), (4, 0, "lost", "x", "-"), (None, 0, "p", "x", "-")]
    out = link(spark, calls, results)
    assert [out[1, c].level for c in "pqrs"] == [0, 1, 2, 0]
    assert [out[1, c].status for c in "uvw"] == ["cycle"] * 3 and out[1, "u"].level is None
    assert out[1, "p"].canonical == '{"arguments":{"a":1,"b":"é\\n"},"id":"p","level":0,"name":"f","result":"first"}'
    assert out[1, "p"].status == out[1, "q"].status == out[1, "r"].status == "ok" and out[1, "s"].status == "no result"
    assert out[1, "bad"].errors == ["not integer a", "unknown c"] and out[1, "none"].errors == ["missing a"] and out[1, "bad"].status == "invalid"
    assert out[1, "json"].errors == out[1, "null"].errors == ["no JSON object"] and out[1, "what"].errors == ["no schema"]
    assert json.loads(out[2, "p"].canonical)["arguments"] == {"a": 2} and out[4, "lost"].status == "no call"
    assert (None, "p") not in out and len(out) == 14
    assert link(spark, [], []) == {}


def test_parses_messages(spark):
    rows = [
        (1, 0, "assistant", '{"tool_calls":[{"id":"a","name":"f","arguments":{"b":1,"a":[2]}}]}'), (1, 1, "tool", '{"tool_call_id":"a","content":"done"}'),
        (1, 2, "assistant", "plain"), (1, 3, "tool", None), (1, 4, "user", '{"tool_calls":[]}'),
    ]
    calls, results = chat.parse_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [tuple(r) for r in calls.collect()] == [(1, 0, "a", "f", '{"a":[2],"b":1}')] and [tuple(r) for r in results.collect()] == [(1, 1, "a", "done")]


def test_native_plan_has_no_python(spark):
    from phonolith.llm import queries

    plan = queries.op2_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

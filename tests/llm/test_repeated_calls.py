"""Call ids that a conversation uses again."""

from phonolith.llm import chat


def test_repeated_ids_have_rows_of_their_own(spark):
    calls = spark.createDataFrame([(1, t, "p", "f", f'{{"a":{t}}}') for t in (4, 0, 2)], "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, t, "p", f"r{t}") for t in (3, 1)], "conv_id long, turn long, call_id string, content string")
    forms = spark.createDataFrame([("f", "a", "integer", True)], "name string, parameter string, type string, required boolean")
    out = sorted(chat.link_all(calls, results, forms).select("n", "turn", "status", "canonical").collect())
    assert [tuple(r)[:3] for r in out] == [(1, 0, "ok"), (2, 2, "repeated id"), (3, 4, "repeated id")]
    assert '"result":"r1"' in out[0].canonical and '"result":"r3"' in out[1].canonical and "result" not in out[2].canonical
    assert chat.link(calls, results, forms).count() == 1

"""Spans of several kinds in one place."""

from tests.llm.test_documents import frame

from phonolith.llm import pii


def test_overlapping_spans_leave_nothing(spark):
    texts = ["to +12025550143@sms.example.com now", "10.0.0.1.jane@corp.example", "a@b.c +12025550143"]
    out = {r.doc_id: r.text for r in pii.redact(pii.find(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]))).collect()}
    assert out == {0: "to <EMAIL> now", 1: "<EMAIL>", 2: "<EMAIL> <PHONE>"}
    made = "array(struct('ip' kind, 2 start, 5 end, true by_pattern), struct('card' kind, 3 start, 4 end, true by_pattern), struct('phone' kind, 4 start, 8 end, true by_pattern)) pii"
    assert spark.range(1).selectExpr("'ab345678yz' text", made).transform(pii.redact).first().text == "ab<IP>yz"

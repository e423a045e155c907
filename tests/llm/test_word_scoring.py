"""Word bigram scores against naive models."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.test_documents import WORD, frame, random_rows

from phonolith.llm import queries, word_scoring


@pytest.mark.parametrize("fan", [word_scoring._FAN, 3])
def test_word_scores_are_naive(spark, monkeypatch, fan):
    monkeypatch.setattr(word_scoring, "_SLICE", 500)  # several slices a task
    monkeypatch.setattr(word_scoring, "_FAN", fan)  # with 3, slices ask in two steps
    monkeypatch.setattr(word_scoring, "_PART", 300)
    rows = [(i, t, "good" if i % 2 else "bad") for i, t, _ in random_rows(9, n=30)] + [(None, "a b", "good")]
    docs = frame(spark, rows).withColumn("target", F.col("source") == "good")
    vocabulary = {w for _, t, _ in rows for w in WORD.findall(t or "")}

    def model(texts):
        n2, n1, c = Counter(), Counter(), Counter()
        for t in texts:
            words = WORD.findall(t or "")
            n1.update(words)
            n2.update(zip([None, *words], words, strict=False))
            c.update([None, *words][: len(words)])
        s = word_scoring.SMOOTHING
        return lambda a, b: (n2[a, b] + s * (n1[b] + s / len(vocabulary)) / (sum(n1.values()) + s)) / (c[a] + s)

    for where in ("good", "nothing"):
        docs = docs.withColumn("target", F.col("source") == where)
        out = {r.doc_id: r for r in word_scoring.word_cross_entropy_difference(docs, "target").collect()}
        assert len(out) == len(rows)
        good, every = model([t for _, t, q in rows if q == where]), model([t for _, t, _ in rows])
        for i, t, _ in rows:
            words = WORD.findall(t or "")
            loss = lambda m: -sum(np.log(m(a, b)) for a, b in zip([None, *words], words, strict=False)) / max(1, len(words))  # noqa: E731, B023
            assert out[i].n_tokens == len(words)
            assert (out[i].target_loss, out[i].background_loss, out[i].score) == pytest.approx((loss(good), loss(every), loss(good) - loss(every)), rel=1e-9, abs=1e-12)
    assert word_scoring.word_cross_entropy_difference(docs.limit(0), "target").count() == 0


def test_query_scores_words(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = queries.op10_lm_scoring(spark, d).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {i: len(WORD.findall(t or "")) for i, t in texts.items()}


def test_messages_keep_their_size_with_the_number_of_parts():
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in rng.zipf(1.3, 150_000) % 50_000]
    table = pa.table({"text": [" ".join(words[k : k + 500]) for k in range(0, len(words), 500)], "target": [False] * 300})
    size = lambda parts: sum(sum(map(len, r[1:])) for r in word_scoring._requests(table, parts))
    assert size(512) < 1.35 * size(32)  # a tenth of a slice's words: as many items in a message as a whole slice has with _FAN parts


def test_empty_table_with_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, target boolean, score string, slice int")
    assert word_scoring.word_cross_entropy_difference(docs, "target").collect() == []

"""Rows without an id and rows that share one, in the pipeline's second and fourth stage."""

from collections import Counter

import corpus_pipeline
from phonolith.llm import mixing
from tests.llm.test_near_copies import table


def text(k, n=30):
    return " ".join(f"w{k}x{j}" for j in range(n))


def test_near_duplicates_keep_texts_that_share_an_id(spark):
    rows = [(1, text(1)), (1, text(2)), (1, text(2)), (2, text(1)), (3, text(3)), (None, text(1)), (None, text(1)), (None, text(4))]
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()]
    assert Counter(out) == Counter([(1, text(1)), (1, text(2)), (3, text(3)), (None, text(1)), (None, text(1)), (None, text(4))])


def test_source_mix_uses_rows_without_or_with_shared_ids(spark):
    rows = [(None if k % 3 == 0 else k // 2, text(k, 20 + k % 7), "en", f"s{k % 3}", 9) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    target = {r.source: r.target for r in mixing.mix(docs).collect()}
    out = corpus_pipeline.source_mix(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    out, words = out.collect(), Counter()
    for r in out:
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - n) <= 26 for s, n in target.items())
    held = {r[1]: r for r in rows}
    assert all(tuple(r) == held[r.text] for r in out) and max(Counter(r.text for r in out).values()) <= 2

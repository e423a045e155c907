"""Words and passages that hashes could take for others."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from phonolith.llm import quality, substring_dedup
from phonolith.llm import words as W


def complementary(n=10):
    """Two words of 2 ** n letters whose polynomial hashes modulo 2 ** 64 agree in every odd base."""
    a = "a"
    for _ in range(n):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_complementary_words_are_not_repeats(spark):
    a, b = complementary()
    rest = " ".join(f"w{i}" for i in range(12))
    rows = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{b} {rest} more")], "doc_id long, text string")
    out = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeated_spans(rows).collect()}
    assert out == {1: 0, 2: 0, 3: 13}
    assert quality.measures_of(pa.array([f"{a} {rest} {b} {rest}"]))["n_repeat_words"].tolist() == [24]


def test_runs_are_compared_whatever_their_hashes():
    words = W.split(pa.array(["a b a b", "a b c d", "é x é x é x"]))
    same = np.zeros(len(words.starts), np.uint64)
    assert W.numbered(words, np.arange(4), same).tolist() == [0, 1, 0, 1]
    assert quality.repeated(words, same, 2).tolist() == [True] * 4 + [False] * 4 + [True] * 6


def test_word_hashes_tell_lengths_and_lanes_apart():
    texts = ["a", "a\0", "a\0\0", "x" * 8, "x" * 9, "x" * 64, "x" * 65, "x" * 64 + "y", "é" * 40, "\0", "\0\0"]
    words = W.split(pa.array([" ".join(texts)]))
    found = [W.word_hashes(words, salt) for salt in (0, 1)]
    assert len(set(np.concatenate(found).tolist())) == 2 * len(texts)
    again = W.word_hashes(W.split(pa.array(["in front " + " ".join(reversed(texts))])))
    assert again[2:][::-1].tolist() == found[0].tolist()


def test_paths_end_where_their_sources_do_in_blocks_of_64(spark):
    """Runs of coordinates over several blocks, against a walk."""
    rng = np.random.default_rng(3)
    held = {s: sorted({*rng.integers(0, 700, 40).tolist(), *range(60 * s, 60 * s + 50 * s), *(range(128) if s == 2 else ())}) for s in range(1, 6)}
    rows = spark.createDataFrame([(s, p) for s, own in held.items() for p in own], "source long, source_start int")
    got = {(r.source, r.source_start): r.head for r in substring_dedup._heads(rows).collect()}
    for s, own in held.items():
        for i, p in enumerate(own):
            head = got[s, own[i - 1]] if i and own[i - 1] == p - 1 else p
            assert got[s, p] == head
    assert len(got) == sum(map(len, held.values()))


def test_unproved_spans_stay(spark):
    """Without equal words at the source nothing is cut, whatever the graph says."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(1, "x " + text), (2, "y " + text)], "doc_id long, text string").withColumn("other", F.lit(1))
    out = {r.doc_id: r for r in substring_dedup.remove_repeated_spans(rows).collect()}
    assert out[2].n_removed == 30 and [tuple(s) for s in out[2].spans] == [(1, 13, 1, 1), (2, 29, 1, 2)] and out[2].kept_text == "y"
    part = pa.record_batch([pa.array([2]), pa.array(["y " + text]), pa.array([[{"start": 1, "n": 30, "source": 1, "source_start": 1, "digest": b"0" * 16}]], pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32()), ("digest", pa.binary())]))), pa.array([None], pa.int64())], ["doc_id", "text", "spans", "copy_of"])
    assert [b.column("n_removed").to_pylist() for b in substring_dedup._cut_rows(13)(iter([part]))] == [[0]]

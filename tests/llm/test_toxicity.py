"""Toxicity: the batched kernels against plain ones, labels that are held out, and odd tables."""

import zlib

import numpy as np
import pytest

from phonolith.llm import queries, toxicity
from phonolith.llm import words as W

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TEXTS = ["You IDIOT.", "", None, "  \n\t ", "a", "...", "st*pid -- (moron)! x", "ÄÖ ñandú, día", "a b c d e f g", "word " * 40, "#\n#", "a... b", "😀 ok"]


def plain_words(text):
    """Separators part words; ASCII punctuation at a word's ends isn't part of it."""
    out = []
    for w in "".join(" " if ord(c) in (9, 10, 11, 12, 13, 32) else c for c in (text or "").lower()).split(" "):
        if w.strip(PUNCTUATION):
            out.append(w.strip(PUNCTUATION))
    return out


def plain_hash(codes):
    total = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in codes:
            total = total * np.uint64(0x9E3779B97F4A7C15) + c
        return W.mix(np.array([total]))[0]


def plain_buckets(word):
    codes = [toxicity._START, *W.mix(np.array([ord(c) + 1 for c in word], np.uint64)), toxicity._END]
    return sorted(int(plain_hash(codes[i : i + n]) % np.uint64(toxicity.BUCKETS)) for n in toxicity.GRAMS for i in range(len(codes) - n + 1))


def test_words_and_subwords_are_those_of_a_plain_version():
    t = toxicity.tokens(TEXTS)
    own = [plain_words(x) for x in TEXTS]
    assert np.diff(t.first).tolist() == [len(w) for w in own]
    flat = [w for ws in own for w in ws]
    by_form = {}
    for word, form in zip(flat, t.word.tolist(), strict=True):
        assert by_form.setdefault(form, word) == word
    assert len(by_form) == t.n_forms == len(set(flat))
    for form, word in by_form.items():
        # the first subword of a form is the whole word, the others are its runs of characters
        assert sorted(t.buckets[t.form == form][1:].tolist()) == plain_buckets(word)


def test_passages_are_the_best_means_of_a_plain_version():
    t = toxicity.tokens(TEXTS)
    weights = np.random.default_rng(1).normal(size=toxicity.BUCKETS)
    scores = t.scores(weights)
    best, at = toxicity._passages(t, scores)
    for k in range(len(TEXTS)):
        own = scores[t.word[t.first[k] : t.first[k + 1]]]
        size = min(toxicity.PASSAGE, len(own))
        means = [own[i : i + size].mean() for i in range(len(own) - size + 1)] if size else []
        assert best[k] == pytest.approx(max(means, default=0))
        assert at[k] == (t.first[k] + int(np.argmax(np.round(means, 12))) if means else -1)


def test_training_learns_words_and_their_misspellings():
    rng = np.random.default_rng(3)
    syllables = ["an", "the", "re", "tion", "ou", "bel", "kar", "mi"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    bad = ["worthless", "disgusting", "pathetic"]
    texts, labels = [], []
    for k in range(400):
        text = [word() for _ in range(rng.integers(5, 200))]
        if k % 4 == 0:
            text[rng.integers(len(text))] = bad[k // 4 % 3] + ("." if k % 8 else "")
        texts.append(" ".join(text))
        labels.append(int(k % 4 == 0))
    model = toxicity.train(texts[:300], labels[:300])
    t = toxicity.tokens(texts[300:])
    assert ((toxicity._passages(t, t.scores(model.weights))[0] + model.lead >= 0) == np.array(labels[300:], bool)).mean() > 0.97
    t = toxicity.tokens(["worthlesss", "disgustingg", "patheticc", "therebel"])
    best = toxicity._passages(t, t.scores(model.weights))[0]
    assert min(best[:3]) > max(0, best[3])


def test_one_class_or_no_labels():
    for labels, want in (([], 0), ([0, 0], 0), ([1, 1], 1)):
        model = toxicity.train(["a b"] * len(labels), labels)
        assert model.lead * (1 if want else -1) > 20 and not model.weights.any()


def test_held_out_labels_and_every_row(spark):
    got = queries.op11_toxicity(spark, "/root/testdata/sf0.1").collect()
    ids = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id").collect()}
    assert len(got) == len(ids) and {r.doc_id for r in got} == ids
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    own = [(r.predicted, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    right = sum(p and t for p, t in own)
    assert right / sum(t for _, t in own) > 0.85 and right / sum(p for p, _ in own) > 0.8


def test_odd_rows_and_clashing_names(spark):
    rows = [(1, "bad words", "x", 7), (None, None, None, None), (2, "", "y", 1), (2, "", "y", 1), (3, "bad words", None, 2), (4, "w " * 200_000, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string, toxicity int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (2, 0), (2, 1)], "doc_id bigint, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    assert out.columns == ["doc_id", "text", "score", "toxicity"]
    got = out.collect()
    assert sorted(map(str, [(r.doc_id, r.text, r.score) for r in got])) == sorted(map(str, [r[:3] for r in rows]))
    by = {r.doc_id: r.toxicity for r in got}
    assert by[1] == by[3] and by[None].word is None and by[2].word is None and by[None].score == by[2].score
    none = toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0)))
    assert none.collect() == []


def test_lists_of_texts_are_joined_as_one():
    one, two = toxicity.tokens(TEXTS), toxicity.joined([toxicity.tokens(TEXTS[:3]), toxicity.tokens(TEXTS[3:3]), toxicity.tokens(TEXTS[3:])])
    assert one.word.tolist() == two.word.tolist() and one.first.tolist() == two.first.tolist() and one.doc.tolist() == two.doc.tolist()
    assert sorted(zip(one.form.tolist(), one.buckets.tolist(), strict=True)) == sorted(zip(two.form.tolist(), two.buckets.tolist(), strict=True))
    docs = np.zeros(toxicity.BUCKETS, int)
    for text in TEXTS:
        docs[list({b for w in plain_words(text) for b in plain_buckets(w)})] += 1
    whole = np.isin(np.arange(toxicity.BUCKETS), one.forms % np.uint64(toxicity.BUCKETS))
    assert (toxicity._documents_of(one) >= docs).all() and (toxicity._documents_of(one) == docs)[~whole].all()

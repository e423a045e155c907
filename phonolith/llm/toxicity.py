"""Toxicity of texts: bags of subword embeddings under a linear softmax, trained jointly.

A word is a run of characters between separators (the six ASCII ones), lower-cased and without ASCII punctuation at its
ends. Its subwords are the whole word and all its runs of 3 to 5 characters, ends marked; each lies in one of ``BUCKETS``
rows of embeddings by its hash, so a misspelt word shares most of its vectors with the right one. The vectors of a word
are averaged, then those of the words of a passage of ``PASSAGE`` words, and a softmax of two classes scores the average.
A document is as toxic as its most toxic passage, which doesn't fade in a long text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolith.llm import words as W

BUCKETS, DIMENSIONS, PASSAGE, GRAMS = 1 << 18, 16, 2, (3, 4, 5)
#: The model is fitted on at most SAMPLE labelled documents of either class, those with the smallest hashes of their ids
#: among the documents of 1 to SAMPLE_CHARS characters. Every document is scored whole.
SAMPLE, SAMPLE_CHARS = 1500, 8_000
#: Steps over the sample: first on averages of whole documents, then on their most toxic passages.
WARM, STEPS, RATE, DECAY = 10, 50, 0.1, 1e-5
#: Subwords of fewer documents of the sample keep a zero vector.
MIN_DOCS = 3

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_KIND = np.zeros(129, np.uint8)  # 1: separator, 2: punctuation, 0: part of a word, as are all characters beyond ASCII
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2
_START, _END = np.uint64(1 << 40), np.uint64(1 << 41)


@dataclass
class Tokens:
    """Words of several texts: doc and first (of each doc, and their number) count as in ``words.Words``; word: number of each
    word's form; forms: hashes of the forms, ascending; buckets, form: the subwords of all forms, and the form of each."""

    doc: np.ndarray
    first: np.ndarray
    word: np.ndarray
    buckets: np.ndarray
    form: np.ndarray
    forms: np.ndarray

    @property
    def n_forms(self) -> int:
        return len(self.forms)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The mean of the subwords' weights for each form."""
        return np.bincount(self.form, weights[self.buckets], self.n_forms) / np.maximum(np.bincount(self.form, minlength=self.n_forms), 1)


def _edges(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: whatever lies between runs that hold a separator; other runs of punctuation are inside."""
    kind = _KIND[np.minimum(codes, 128)]
    outer = kind > 0
    turn = np.flatnonzero(np.diff(outer, prepend=not outer[0] if len(outer) else False))
    if not len(turn):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    parts = outer[turn] & (np.maximum.reduceat((kind == 1).view(np.uint8), turn) > 0)
    inside = np.repeat(~parts, np.diff(np.append(turn, len(codes))))
    step = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def tokens(texts: list[str | None]) -> Tokens:
    """Cut texts into words and those into hashed subwords; null counts as empty."""
    lower = [(t or "").lower() for t in texts]
    # a line feed before and after each text keeps its words apart from its neighbours'
    codes = np.frombuffer(("\n" + "\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    starts, ends = _edges(codes)
    offsets = np.cumsum([1, *(len(t) + 1 for t in lower)])
    doc = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    if not len(starts):
        none = np.empty(0, np.int64)
        return Tokens(none, first, none, none, none, np.empty(0, np.uint64))
    # the same word has the same hash wherever it stands: powers of an odd number have inverses modulo 2^64
    mixed = W.mix(codes.astype(np.uint64) + np.uint64(1))
    sums = np.append(np.uint64(0), np.cumsum(mixed * np.multiply.accumulate(np.full(len(codes), _BASE))))
    back = np.append(np.uint64(1), np.multiply.accumulate(np.full(len(codes), _INVERSE)))
    whole = W.mix((sums[ends] - sums[starts]) * back[starts])
    forms, at, word = np.unique(whole, return_index=True, return_inverse=True)
    # each form with a mark before and after it, all in a row
    size = ends[at] - starts[at] + 2
    to = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(to, size)
    marked = mixed[np.clip(np.repeat(starts[at], size) + place - 1, 0, len(codes) - 1)]
    marked[to], marked[to + size - 1] = _START, _END
    owner = np.repeat(np.arange(len(forms)), size)
    grams, owners = [forms], [np.arange(len(forms))]
    for n in GRAMS:
        grams.append(W.gram_hashes(marked, n))
        inside = W.gram_inside(owner, n)
        grams[-1], own = grams[-1][inside], owner[: len(inside)][inside]
        owners.append(own)
    return Tokens(doc, first, word, (np.concatenate(grams) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owners), forms)


def joined(parts: list[Tokens]) -> Tokens:
    """The tokens of several lists of texts as if they were one list; subwords of a form are kept once."""
    forms, at, number = np.unique(np.concatenate([p.forms for p in parts]), return_index=True, return_inverse=True)
    n_forms, n_words, n_docs = (np.append(0, np.cumsum(x)) for x in ([p.n_forms for p in parts], [len(p.word) for p in parts], [len(p.first) - 1 for p in parts]))
    new = np.zeros(len(number), bool)
    new[at] = True
    word, doc, first, buckets, form = [], [], [], [], []
    for k, p in enumerate(parts):
        own = number[n_forms[k] : n_forms[k + 1]]
        kept = new[n_forms[k] : n_forms[k + 1]][p.form]
        word.append(own[p.word])
        doc.append(p.doc + n_docs[k])
        first.append(p.first[:-1] + n_words[k])
        buckets.append(p.buckets[kept])
        form.append(own[p.form[kept]])
    return Tokens(np.concatenate(doc), np.append(np.concatenate(first), n_words[-1]), np.concatenate(word), np.concatenate(buckets), np.concatenate(form), forms)


def _documents_of(t: Tokens) -> np.ndarray:
    """The number of texts that each bucket's subwords are in, one text after the other."""
    order = np.argsort(t.form, kind="stable")
    starts, buckets, out = np.searchsorted(t.form[order], np.arange(t.n_forms + 1)), t.buckets[order], np.zeros(BUCKETS, np.int64)
    for a, b in zip(t.first, t.first[1:], strict=False):
        own = np.unique(t.word[a:b])
        size = starts[own + 1] - starts[own]
        out[np.unique(buckets[np.repeat(starts[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())])] += 1
    return out


def _passages(t: Tokens, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the largest mean score of a passage and the passage's first word (-1, score 0 without words). A text of fewer
    words is one passage."""
    n = np.diff(t.first)
    best, at = np.zeros(len(n)), np.full(len(n), -1)
    own = scores[t.word]
    short = np.flatnonzero((n > 0) & (n < PASSAGE))
    best[short] = (np.bincount(t.doc, own, len(n)) / np.maximum(n, 1))[short]
    at[short] = t.first[short]
    if not (n >= PASSAGE).any():
        return best, at
    means = own[: len(own) - PASSAGE + 1].copy()
    for k in range(1, PASSAGE):
        means += own[k : k + len(means)]
    means = np.append(means / PASSAGE, np.full(PASSAGE - 1, -np.inf))
    means[~np.append(W.gram_inside(t.doc, PASSAGE), np.zeros(PASSAGE - 1, bool))] = -np.inf
    long = np.flatnonzero(n >= PASSAGE)
    # runs of reduceat start at a text's first word, so texts without words, which have none, are left out
    filled = np.flatnonzero(n > 0)
    top = np.full(len(n), -np.inf)
    top[filled] = np.maximum.reduceat(means, t.first[filled])
    best[long] = top[long]
    hit = np.flatnonzero(means == top[t.doc])[::-1]
    leader = np.full(len(n), -1)
    leader[t.doc[hit]] = hit
    at[long] = leader[long]
    return best, at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


@dataclass
class Model:
    """embeddings: a vector for each bucket; softmax, bias: of the classes clean and toxic."""

    embeddings: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        """What a subword adds to the lead of the toxic class; averages of vectors and of these agree, as the softmax is linear."""
        return self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])

    @property
    def lead(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(texts: list[str], toxic: list[int], seed: int = 7) -> Model:
    """Embeddings and softmax of labelled texts by full-batch Adagrad; both classes weigh the same.

    Texts without labels of both classes give a model that always answers with the one class there is (clean, if none).
    """
    y = np.array(toxic, np.float64)
    rng = np.random.default_rng(seed)
    model = Model(np.zeros((BUCKETS, DIMENSIONS)), rng.normal(0, 0.1, (DIMENSIONS, 2)), np.zeros(2))
    if not (0 < y.sum() < len(y)):
        model.bias[1] = 30.0 if y.sum() else -30.0
        return model
    t = joined([tokens(texts[k : k + 200]) for k in range(0, len(texts), 200)])
    n, share = np.diff(t.first), np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    live = _documents_of(t) >= MIN_DOCS
    # only the live rows are trained; the others stay zero but count in their words' averages
    row = np.cumsum(live) - 1
    used = live[t.buckets]
    rows, form = row[t.buckets[used]], t.form[used]
    per_form = np.maximum(np.bincount(t.form, minlength=t.n_forms), 1)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (int(live.sum()), DIMENSIONS))
    squares = [np.full_like(x, 1e-8) for x in (vectors, model.softmax, model.bias)]
    for k in range(STEPS):
        toxic_way = model.softmax[:, 1] - model.softmax[:, 0]
        scores = np.bincount(form, (vectors @ toxic_way)[rows], t.n_forms) / per_form
        if k < WARM:
            at, doc, part = np.arange(len(t.word)), t.doc, 1 / n[t.doc]
        else:
            if k == WARM or k % 2 == 0:
                lead = _passages(t, scores)[1]
            own = np.flatnonzero(lead >= 0)
            long = np.minimum(n[own], PASSAGE)
            doc = np.repeat(own, long)
            at = np.repeat(lead[own] - (np.cumsum(long) - long), long) + np.arange(long.sum())
            part = np.repeat(1 / long, long)
        p = _sigmoid(np.bincount(doc, scores[t.word[at]] * part, len(y)) + model.lead)
        rest = (p - y) * share
        by_word = np.bincount(t.word[at], rest[doc] * part, t.n_forms) / per_form
        pull = np.bincount(rows, by_word[form], len(vectors))
        toward = pull @ vectors
        slopes = (np.outer(pull, toxic_way) + DECAY * vectors, np.stack([-toward, toward], 1), np.array([-rest.sum(), rest.sum()]))
        for value, square, slope in zip((vectors, model.softmax, model.bias), squares, slopes, strict=True):
            square += slope**2
            value -= RATE * slope / np.sqrt(square)
    model.embeddings[live] = vectors
    return model


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """A model of ``labels`` (doc_id, toxic) on a bounded, repeatable sample of the documents.

    A document with several labels is toxic if one says so; labels or documents without an id, and null labels, teach
    nothing. Candidates are thinned by a hash of their ids before they are ordered, so no task orders all labels.
    """
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    counts = {r["_toxic"]: r["n"] for r in own.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    texts, toxic = [], []
    h = F.xxhash64("doc_id")
    for label in (0, 1):
        share = max(1, counts.get(label, 0) // (8 * sample))
        # at most 8 * sample ids, which bounds what is broadcast
        ids = own.where((F.col("_toxic") == label) & (F.pmod(h, F.lit(share)) == 0)).select("doc_id").orderBy(h, "doc_id").limit(8 * sample)
        held = documents.select("doc_id", "text").where(F.length("text").between(1, chars)).join(F.broadcast(ids), "doc_id")
        rows = held.select("text", h.alias("_h"), F.xxhash64("text").alias("_t")).orderBy("_h", "_t").limit(sample).select("text").collect()
        texts += [r.text for r in rows]
        toxic += [label] * len(rows)
    return train(texts, toxic)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Documents with ``toxicity``: score (0 to 1, 0.5 or more counts as toxic) and the place (from 0) of the first word of the
    passage that decided it.

    Null and empty texts and those of separators alone have the model's score of no words and a null place. Equal texts score
    alike in any batch. Other columns stay; one named ``toxicity`` gives way.
    """
    weights, lead = model.weights, model.lead
    shipped = documents.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers, whatever the input
    documents = documents.drop("toxicity")
    kept = documents.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        for batch in batches:
            for run in W.slices(batch, "text"):
                t = tokens(run.column("text").to_pylist())
                best, at = _passages(t, t.scores(shipped.value))
                place = pa.array(at - t.first[:-1], pa.int64(), mask=at < 0)
                found = pa.StructArray.from_arrays([pa.array(_sigmoid(best + lead)), place], ["score", "word"])
                yield pa.RecordBatch.from_arrays([*(run.column(c) for c in range(run.num_columns)), found], [*kept, "toxicity"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema), "toxicity struct<score:double,word:bigint>"])
    return documents.mapInArrow(rows, schema)

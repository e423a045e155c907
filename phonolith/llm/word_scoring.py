"""Cross-entropy difference scores (Moore and Lewis, 2010) with word bigram models over one open vocabulary.

Words, contexts and bigrams of all documents are counted by 64-bit hashes, without a cap. Texts are handled in slices of
about 4 MB. A slice asks for the counts of its distinct items: their sorted hashes go, with the slice's own counts, to
parts of the hash range; a part adds up and answers each slice in the order of its hashes, so no hash goes back. Then each
slice meets its answers and is scored. A common word is one item of each slice, so it makes no part large, and nothing that
grows with the corpus is broadcast or comes to the driver.

A slice has at most ``_FAN`` parts to ask, so that its messages never shrink to a few items. Where the hash range needs more parts,
slices ask coarse parts of it: those of a bundle of slices meet there, are merged, and ask the parts together; the answers go back
the same way. The number of tasks of a step follows the size of the texts, up to ``_MOST_TASKS``; beyond, a task takes more slices or
parts, one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolith.llm import words as W
from phonolith.llm.store import written

SMOOTHING = 5.0
#: Bytes of text in a slice and, on average, behind a part of the hash range.
_SLICE, _PART, _LEAST_PARTS = 1 << 22, 1 << 24, 8
#: Parts that one asks at most, bytes of text for each task, and the fewest and most tasks of a step.
_FAN, _TASK, _LEAST_TASKS, _MOST_TASKS = 2048, 1 << 24, 8, 1 << 16
# the two lowest bits of a hash tell what it is of
_BIGRAM, _WORD, _CONTEXT = (np.uint64(i) for i in range(3))
_START, _ASIDE = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A35)


def items_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every word its text and the hashes of its bigram, of itself and of its context (the word before, or the start)."""
    words = W.split(texts)
    if not len(words.starts):
        return np.empty(0, np.int64), *(np.empty(0, np.uint64),) * 3
    own = W.word_hashes(words)
    before = np.append(_START, own[:-1])
    before[1:][words.doc[1:] != words.doc[:-1]] = _START
    before[0] = _START
    clear = ~np.uint64(3)
    return words.doc, W.mix(before * np.uint64(W._BASE) + own) & clear | _BIGRAM, own & clear | _WORD, W.mix(before ^ _ASIDE) & clear | _CONTEXT


def _packed(x: np.ndarray) -> bytes:
    """64-bit values, compressed by planes of bytes."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(x: bytes) -> np.ndarray:
    planes = pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd")
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _stream(part: pa.RecordBatch) -> bytes:
    """The rows of a slice as one compressed Arrow stream."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(part)
    return out.getvalue().to_pybytes()


def _table(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all().combine_chunks()


def _parted(hashes: np.ndarray, own: np.ndarray, every: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Number of each part of the hash range with the differences of its sorted hashes, and their counts: in the target and in all."""
    number = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(number.astype(np.int64), prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(hashes)], strict=True):
        yield int(number[a]), _packed(np.diff(hashes[a:b], prepend=np.uint64(0))), _packed(own[a:b]), _packed(every[a:b])


def _requests(part: pa.Table, parts: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """What a slice asks of each part, with its own counts."""
    doc, *items = items_of(part.column("text"))
    if not len(doc):
        return
    target = np.array([bool(x) for x in part.column("target").to_pylist()])[doc]
    hashes, place = np.unique(np.concatenate(items), return_inverse=True)
    yield from _parted(hashes, np.bincount(place[np.tile(target, 3)], minlength=len(hashes)), np.bincount(place, minlength=len(hashes)), parts)


def _added(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray]]:
    """The hashes of each message, all of them (ascending), the place of each message's hashes there one after the other, and the sums
    of both counts."""
    asked = [np.cumsum(_unpacked(x), dtype=np.uint64) for x in table.column("hashes").to_pylist()]
    hashes, place = np.unique(np.concatenate(asked), return_inverse=True)
    totals = []
    for name in ("in_target", "in_all"):
        counts = np.concatenate([_unpacked(x) for x in table.column(name).to_pylist()])
        totals.append(np.rint(np.bincount(place, counts, len(hashes))).astype(np.int64))
    return asked, hashes, place, totals


_REQUEST = [("part", pa.int64()), ("hashes", pa.binary()), ("in_target", pa.binary()), ("in_all", pa.binary())]


def _merged(parts: int) -> Callable[[pa.Table], pa.Table]:
    """Messages of a bundle of slices to one coarse part as one sender's messages to the parts."""

    def merge(table: pa.Table) -> pa.Table:
        W.lean()
        _, hashes, _, totals = _added(table)
        rows = list(_parted(hashes, *totals, parts))
        columns = [pa.array(x, kind) for (_, kind), x in zip(_REQUEST, zip(*rows, strict=True), strict=True)]
        sender = pa.array([table.column("bundle")[0].as_py()] * len(rows), pa.int64())
        return pa.table([sender, *columns], ["slice", *(name for name, _ in _REQUEST)])

    return merge


def _handed_on(table: pa.Table, answers: pa.Table) -> pa.Table:
    """The answers to a bundle at one coarse part as answers to each of its slices."""
    W.lean()
    asked, _, place, _ = _added(table)
    order = np.argsort(answers.column("part").to_numpy())
    ends = np.cumsum([len(x) for x in asked])[:-1]
    held = []
    for name in ("in_target", "in_all"):
        packed = answers.column(name).to_pylist()
        count = np.concatenate([_unpacked(packed[i]) for i in order])
        held.append(pa.array([_packed(x) for x in np.split(count[place], ends)], pa.binary()))
    return pa.table({"slice": table.column("slice"), "part": table.column("part"), "in_target": held[0], "in_all": held[1]})


def _answers(table: pa.Table) -> pa.Table:
    """The counts in all slices of what each slice asked for; a row without a slice holds the words and their number."""
    W.lean()
    asked, hashes, place, totals = _added(table)
    word = hashes & np.uint64(3) == _WORD
    ends = np.cumsum([len(x) for x in asked])[:-1]
    held = [[_packed(x) for x in np.split(t[place], ends)] for t in totals]
    n = len(asked)
    return pa.table(
        {
            "slice": pa.array([*table.column("slice").to_pylist(), None], pa.int64()),
            "part": pa.array([*table.column("part").to_pylist(), None], pa.int64()),
            "in_target": pa.array([*held[0], None], pa.binary()),
            "in_all": pa.array([*held[1], None], pa.binary()),
            "n_words": pa.array([None] * n + [int(word.sum())], pa.int64()),
            "target_tokens": pa.array([None] * n + [int(totals[0][word].sum())], pa.int64()),
            "all_tokens": pa.array([None] * n + [int(totals[1][word].sum())], pa.int64()),
        }
    )


def word_cross_entropy_difference(documents: DataFrame, target: str, smoothing: float = SMOOTHING, text_bytes: int | None = None) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` of every row; losses are means per token (word).

    A bigram's probability is smoothed with its second word's, and that with the uniform one over all words of all
    documents. ``target`` names a boolean column (null: not in the target). Null and blank texts have no tokens, losses
    and score 0. Without any target row the target model is uniform. Repeated rows count and score each. Other columns
    are not read. text_bytes: size of all texts, where it is known.
    """
    if text_bytes is None:
        text_bytes = documents.agg(F.sum(F.octet_length("text"))).first()[0]
    parts = max(_LEAST_PARTS, -(-(text_bytes or 0) // _PART))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in W.slices(batch, "text", _SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([_stream(part)])], ["slice", "held"])
                number += 1

    coarse = min(parts, _FAN)
    parts = coarse * -(-parts // coarse)
    # as many slices in a bundle as make a coarse part's share of them the size of a part
    bundles = max(1, -(-(text_bytes or 0) // (_PART * coarse)))
    tasks = min(_MOST_TASKS, max(_LEAST_TASKS, -(-(text_bytes or 0) // _TASK)))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        for batch in batches:
            for number, held in zip(batch.column("slice").to_pylist(), batch.column("held"), strict=True):
                if rows := [*_requests(_table(held.as_py()), coarse)]:
                    columns = [pa.array(x, kind) for (_, kind), x in zip(_REQUEST, zip(*rows, strict=True), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), *columns], ["slice", *(name for name, _ in _REQUEST)])

    # repartition() to a size that follows the texts; grouping by the same column then needs no other shuffle
    dealt = lambda df, key: df.repartition(tasks, key).groupBy(key)
    # more tasks than parts, as hashing puts some parts together
    by_part = lambda df: df.repartition(min(_MOST_TASKS, 3 * parts), "part").groupBy("part")
    rows = written(documents.select("doc_id", "text", F.col(target).cast("boolean").alias("target")).mapInArrow(sliced, "slice bigint, held binary"), "slices")
    request = "slice bigint, part bigint, hashes binary, in_target binary, in_all binary"
    requests = rows.mapInArrow(asked, request)
    found = "slice bigint, part bigint, in_target binary, in_all binary, n_words bigint, target_tokens bigint, all_tokens bigint"
    if parts == coarse:
        answers = written(by_part(requests).applyInArrow(_answers, found), "answers")
    else:
        bundled = requests.withColumn("bundle", F.col("part") * bundles + F.pmod(F.xxhash64("slice"), F.lit(bundles)))
        answers = written(by_part(dealt(bundled, "bundle").applyInArrow(_merged(parts), request)).applyInArrow(_answers, found), "answers")
    n_words, *sums = (x or 0 for x in answers.where("slice is null").agg(F.sum("n_words"), F.sum("target_tokens"), F.sum("all_tokens")).first())

    def scored(slices: pa.Table, answers: pa.Table) -> pa.Table:
        W.lean()
        texts = _table(slices.column("held")[0].as_py())
        doc, *items = items_of(texts.column("text"))
        n = np.bincount(doc, minlength=texts.num_rows)
        _, place = np.unique(np.concatenate(items), return_inverse=True)
        bigram, word, context = np.split(place, 3)
        order = np.argsort(answers.column("part").to_numpy())
        losses = []
        for name, total in zip(("in_target", "in_all"), sums, strict=True):
            held = answers.column(name).to_pylist()
            count = np.concatenate([_unpacked(held[i]) for i in order] or [np.empty(0)]).astype(np.float64)
            p = (count[word] + smoothing / max(n_words, 1)) / (total + smoothing)
            p = (count[bigram] + smoothing * p) / (count[context] + smoothing)
            losses.append(np.bincount(doc, -np.log(p), texts.num_rows) / np.maximum(n, 1))
        return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": n, "target_loss": losses[0], "background_loss": losses[1], "score": losses[0] - losses[1]})

    held = answers.where("slice is not null").select("slice", "part", "in_target", "in_all")
    if parts > coarse:
        held = dealt(bundled, "bundle").cogroup(dealt(held.withColumnRenamed("slice", "bundle"), "bundle")).applyInArrow(_handed_on, "slice bigint, part bigint, in_target binary, in_all binary")
    return dealt(rows, "slice").cogroup(dealt(held, "slice")).applyInArrow(scored, "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double")

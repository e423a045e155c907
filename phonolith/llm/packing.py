"""Bounded-space packing of documents into token sequences of fixed length.

Every partition keeps a fixed number of open windows. A document's full windows are cut off first; what is left goes
whole into the open window that it fills best, into a new one while there is room for one, and else the fullest window
is emitted. The open windows that remain at the ends of the partitions are merged: their pieces are dealt to groups of
bounded size and packed again by best fit, longest first.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolith.llm import words as W
from phonolith.llm.store import written
from phonolith.llm.tokens import encoder, with_end

OPEN_WINDOWS, MERGE_PIECES = 256, 8_000
_COLUMNS = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class Open:
    """Open windows by free room: ``rooms`` is sorted, ``held[i]`` is the window with ``rooms[i]`` free tokens."""

    def __init__(self, length: int, most: int) -> None:
        self.length, self.most, self.rooms, self.held = length, most, [], []

    def place(self, size: int, piece) -> list | None:
        """Put a piece (shorter than a window) in the tightest window; the window that had to go to make room, if any."""
        at, gone = bisect.bisect_left(self.rooms, size), None
        if at < len(self.rooms):
            room, window = self.rooms.pop(at), self.held.pop(at)
        else:
            if len(self.rooms) >= self.most:
                self.rooms.pop(0)
                gone = self.held.pop(0)
            room, window = self.length, []
        window.append(piece)
        room -= size
        if room == 0:
            return [x for x in (gone, window) if x] if gone else [window]
        at = bisect.bisect_left(self.rooms, room)
        self.rooms.insert(at, room)
        self.held.insert(at, window)
        return [gone] if gone else []


def pack(documents: DataFrame, tokenizer: str, end_id: int, length: int = 1024, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` tokens.

    Returns ``doc_id, start, length, ids`` (little-endian uint32)``, doc_tokens, sequence_id, offset``. A document is its
    ids and ``end_id``; null and empty texts are ``end_id`` alone, repeated rows and rows without an id are packed like
    others. Other columns are not read. The first pass is written in the shared folder, so sequence ids hold.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        part, number = TaskContext.get().partitionId() << 40, 0
        open_ = Open(length, open_windows)
        out: list[tuple] = []

        def emit(window: list, closed: bool = True) -> None:
            nonlocal number
            offset = 0
            for doc_id, start, ids, total in window:
                out.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, part + number, offset, closed))
                offset += len(ids)
            number += 1

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "closed"])

        for whole in batches:
            for run in W.slices(whole, "text", 2 << 20):
                ids, offsets = with_end(*encoder(tokenizer).encode(run.column("text")), end_id)
                for k, doc_id in enumerate(run.column("doc_id").to_pylist()):
                    own = ids[offsets[k] : offsets[k + 1]]
                    cut = len(own) - len(own) % length
                    for at in range(0, cut, length):
                        emit([(doc_id, at, own[at : at + length], len(own))])
                    if cut < len(own):
                        for window in open_.place(len(own) - cut, (doc_id, cut, own[cut:].copy(), len(own))):
                            emit(window)
                    if len(out) >= 4000:
                        yield batch()
                        out.clear()
        for window in open_.held:
            emit(window, False)
        if out:
            yield batch()

    first = written(documents.select("doc_id", "text").mapInArrow(rows, f"{_COLUMNS}, closed boolean"), "pieces")
    return first.where("closed").drop("closed").unionByName(merge(first.where("not closed").drop("closed"), length))


def merge(pieces: DataFrame, length: int, most: int = MERGE_PIECES) -> DataFrame:
    """Pack pieces anew in groups of about ``most``; sequence ids are negative here, so they can't meet the others."""
    groups = max(1, -(-pieces.count() // most))

    def rows(table: pa.Table) -> pa.Table:
        group = table.column("piece_group")[0].as_py()
        sizes = table.column("length").to_numpy()
        order = np.lexsort((table.column("start").to_numpy(), table.column("doc_id").to_numpy(zero_copy_only=False), table.column("sequence_id").to_numpy(), -sizes))
        open_, closed = Open(length, len(order) + 1), []
        for i in order.tolist():
            closed += open_.place(int(sizes[i]), i)
        sequence, offset = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for n, window in enumerate([*closed, *open_.held]):
            sequence[window] = -1 - (group << 40) - n
            offset[window] = np.cumsum(sizes[window]) - sizes[window]
        out = table.drop_columns(["piece_group", "sequence_id", "offset"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        return out.select(["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    dealt = pieces.withColumn("piece_group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
    return dealt.groupBy("piece_group").applyInArrow(rows, _COLUMNS)

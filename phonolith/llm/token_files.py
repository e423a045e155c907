"""Token ids on disk: documents compressed one by one with a shared zstandard dictionary.

A file is ``PHTK``, version (uint16), bytes per id (uint16), number of documents (uint32), SHA-256 of the dictionary
(32 bytes), then an index entry per document (id, whether it has one, tokens, place and length of its frame) and the
frames. Any document is read by one look into the index and one short frame. Files lie as binary rows in a Parquet
table ``files`` (part, number in the part, documents, tokens before it in the part, own tokens, file), the dictionary in ``dictionary`` beside it, so
Spark writes and reads them wherever the store is.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.llm import words as W
from phonolith.llm.tokens import encoder, with_end

_HEAD = struct.Struct("<4sHHI32s")
_INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("tokens", "<u4"), ("place", "<u8"), ("length", "<u4")])
#: Documents that the dictionary is trained on: those with the smallest hash of their id, up to SAMPLE_CHARS long.
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 20_000, 64 << 10
FILE_BYTES = 4 << 20


def train_dictionary(documents: DataFrame, tokenizer: str, end_id: int, sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from serialized id arrays of a bounded, repeatable sample; empty if there is too little."""
    # about twice the sample passes the filter, so that only so many texts are put in order
    share = max(1, documents.count() // (2 * sample))
    texts = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).where(F.length("text").between(1, SAMPLE_CHARS)).select("text", F.xxhash64("doc_id", "text").alias("h")).orderBy("h", "text").limit(sample)
    rows = pa.array([r.text for r in texts.select("text").collect()], pa.string())
    ids, offsets = with_end(*encoder(tokenizer).encode(rows), end_id)
    samples = [ids[a:b].astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4").tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


@lru_cache(2)
def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def pack_file(ids: list[tuple[int | None, np.ndarray]], dictionary: bytes, width: int, level: int = 3) -> bytes:
    """A file of documents' ids, in the given order."""
    press = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_checksum=False)
    frames = [press.compress(x.astype(f"<u{width}").tobytes()) for _, x in ids]
    index = np.zeros(len(ids), _INDEX)
    index["doc_id"] = [0 if d is None else d for d, _ in ids]
    index["has_id"] = [d is not None for d, _ in ids]
    index["tokens"] = [len(x) for _, x in ids]
    index["length"] = [len(x) for x in frames]
    index["place"] = _HEAD.size + index.nbytes + np.cumsum(index["length"], dtype=np.int64) - index["length"]
    return b"".join([_HEAD.pack(b"PHTK", 1, width, len(ids), hashlib.sha256(dictionary).digest()), index.tobytes(), *frames])


def read_index(file: bytes, dictionary: bytes) -> tuple[np.ndarray, int]:
    """The index of a file and its bytes per id. Raises ValueError if the file needs another dictionary."""
    magic, version, width, n, digest = _HEAD.unpack_from(file)
    if (magic, version) != (b"PHTK", 1) or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a token file of this dictionary")
    return np.frombuffer(file, _INDEX, n, _HEAD.size), width


def read_document(file: bytes, entry: np.void, width: int, dictionary: bytes) -> np.ndarray:
    """The ids of one document, by its index entry."""
    frame = file[int(entry["place"]) : int(entry["place"]) + int(entry["length"])]
    plain = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress(frame, max_output_size=int(entry["tokens"]) * width or 1)
    return np.frombuffer(plain, f"<u{width}").astype(np.uint32)


def write_token_files(documents: DataFrame, path: str, tokenizer: str, end_id: int, width: int = 2, file_bytes: int = FILE_BYTES) -> None:
    """Write all documents' ids, each with ``end_id`` after it, in ascending order of doc_id (null first).

    Null and empty texts are ``end_id`` alone. Rows of one id are ordered by a hash of their text; repeated rows are
    all written. Other columns are not read. ``width``: bytes per id; an id that doesn't fit raises OverflowError.
    """
    spark = documents.sparkSession
    dictionary = train_dictionary(documents, tokenizer, end_id)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size, before = TaskContext.get().partitionId(), 0, [], 0, 0

        def file() -> pa.RecordBatch:
            nonlocal before
            blob, own = pack_file(held, dictionary, width), sum(len(i) for _, i in held)
            before += own
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, seq, len(held), before - own, own)] + [pa.array([blob], pa.binary())], ["part", "seq", "n_docs", "n_before", "n_tokens", "file"])

        for batch in batches:
            for run in W.slices(batch, "text", 2 << 20):
                ids, offsets = with_end(*encoder(tokenizer).encode(run.column("text")), end_id)
                if ids.max(initial=0) >> 8 * width:
                    raise OverflowError(f"an id needs more than {width} bytes")
                for k, doc_id in enumerate(run.column("doc_id").to_pylist()):
                    held.append((doc_id, ids[offsets[k] : offsets[k + 1]]))
                    size += int(offsets[k + 1] - offsets[k]) * width
                    if size >= file_bytes:
                        yield file()
                        seq, held, size = seq + 1, [], 0
        if held:
            yield file()

    ordered = documents.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    files = ordered.mapInArrow(rows, "part bigint, seq bigint, n_docs bigint, n_before bigint, n_tokens bigint, file binary")
    files.write.option("compression", "none").parquet(f"{path}/files")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` of every document in the files; start counts the ids before it, ids are little-endian uint32.

    A file knows the tokens before it in its part, so one number for each part (a task of the write) goes through the
    driver, however many files there are.
    """
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
    files = spark.read.parquet(f"{path}/files")
    base, total = {}, 0
    for part, n in sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        base[part], total = total, total + n

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, file in zip(*(batch.column(c).to_pylist() for c in ("part", "n_before", "file")), strict=True):
                index, width = read_index(file, dictionary)
                starts = base[part] + before + np.cumsum(index["tokens"], dtype=np.int64) - index["tokens"]
                for at in range(0, len(index), 2000):
                    run = index[at : at + 2000]
                    ids = [read_document(file, x, width, dictionary).astype("<u4").tobytes() for x in run]
                    yield pa.RecordBatch.from_arrays([pa.array(run["doc_id"], mask=run["has_id"] == 0), pa.array(starts[at : at + 2000]), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    return files.select("part", "n_before", "file").mapInArrow(rows, "doc_id bigint, start bigint, ids binary")

"""Annotated sentences of a release: zips, or zips of speakers inside a zip, read member by member.

Only central directories are read to find the members; the sentences' members are then read by their byte ranges, so one release
is spread over many tasks and a stopped job goes on with the members it lacks. Files are opened by their URIs through Arrow.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compressed bytes that a task reads on average.
TASK_BYTES = 64 << 20
_PLACE = "struct<offset:bigint,packed:bigint,method:int>"
INDEX = f"path string, outer {_PLACE}, speaker string, utterance string, wave {_PLACE}, textgrid {_PLACE}, transcript {_PLACE}"
FILES = "speaker string, utterance string, wave binary, textgrid binary, transcript binary"
_KIND = pa.struct([("offset", pa.int64()), ("packed", pa.int64()), ("method", pa.int32())])
_SCHEMA = pa.schema([("path", pa.string()), ("outer", _KIND), ("speaker", pa.string()), ("utterance", pa.string()), ("wave", _KIND), ("textgrid", _KIND), ("transcript", _KIND)])


def _opened(path: str):
    """A file that can be sought, by its URI."""
    scheme, _, rest = path.partition(":")
    files, name = fs.FileSystem.from_uri(f"file://{'/' + rest.lstrip('/')}" if scheme == "file" else path)
    return files.open_input_file(name)


class _Window(io.RawIOBase):
    """Some bytes of a file as a file."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.at = file, start, size, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, buffer) -> int:
        self.file.seek(self.start + self.at)
        data = self.file.read(max(0, min(len(buffer), self.size - self.at)))
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


def _place(file, info: zipfile.ZipInfo, start: int) -> dict:
    """Where a member's bytes are: behind its own header, whose length is only known from there."""
    file.seek(start + info.header_offset)
    name, extra = struct.unpack("<26xHH", file.read(30))
    return {"offset": start + info.header_offset + 30 + name + extra, "packed": info.compress_size, "method": info.compress_type}


def _sentences(file, start: int, size: int, outer: dict | None = None) -> Iterator[dict]:
    """The sentences of a zip that has ``size`` bytes from ``start`` on."""
    with zipfile.ZipFile(_Window(file, start, size)) as z:
        infos = {i.filename: i for i in z.infolist()}
    for name in sorted(infos):
        if name.endswith(".zip"):
            own = _place(file, infos[name], start)
            if own["method"] == zipfile.ZIP_STORED:
                yield from _sentences(file, own["offset"], own["packed"], outer)
            elif outer is None:
                # a packed zip has no members with ranges of their own: it is unpacked where it is read
                held = io.BytesIO(_content(file, own))
                yield from _sentences(held, 0, len(held.getbuffer()), own)
            else:
                raise ValueError(f"{name} is packed in a packed zip")
        elif "/annotation/" in name and name.endswith(".TextGrid"):
            top, utterance = name.split("/annotation/")[0], name.rsplit("/", 1)[-1].removesuffix(".TextGrid")
            members = {"textgrid": name, "wave": f"{top}/wav/{utterance}.wav", "transcript": f"{top}/transcript/{utterance}.txt"}
            yield {"outer": outer, "speaker": top.split("/")[-1], "utterance": utterance, **{k: _place(file, infos[n], start) if n in infos else None for k, n in members.items()}}


def _content(file, place: dict) -> bytes:
    file.seek(place["offset"])
    data = file.read(place["packed"])
    if place["method"] == zipfile.ZIP_STORED:
        return data
    if place["method"] == zipfile.ZIP_DEFLATED:
        return zlib.decompress(data, -zlib.MAX_WBITS)
    raise ValueError(f"unknown compression {place['method']}")


def release_index(spark: SparkSession, path: str) -> DataFrame:
    """A row of ``INDEX`` for each annotated sentence in the zips at a path: where its members are. A missing wave or transcript is
    null. Archives are files of their own, one task each; only their directories are read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                with _opened(name) as file:
                    yield pa.RecordBatch.from_pylist([{"path": name, **s} for s in _sentences(file, 0, size)], _SCHEMA)

    archives = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("path like '%.zip'").select("path", "length")
    return archives.repartition(F.col("path")).mapInArrow(rows, INDEX)


def read_sentences(index: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``speaker, utterance, wave, textgrid, transcript`` of the sentences of an index, or of those that are still to do
    (``store.not_done(index, done, ["speaker", "utterance"])``).

    Sentences are dealt to as many tasks as they have ``task_bytes``; those inside a packed zip stay together, so it is unpacked once.
    """
    packed = sum((F.coalesce(F.col(f"{c}.packed"), F.lit(0)) for c in ("wave", "textgrid", "transcript")), F.lit(0))
    tasks = (index.agg(F.sum(packed)).first()[0] or 0) // task_bytes + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, file, inner = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                at = (row["path"], (row["outer"] or {}).get("offset"))
                if known is None or known[0] != at[0]:
                    if file is not None:
                        file.close()
                    file = _opened(row["path"])
                if known != at:
                    inner = io.BytesIO(_content(file, row["outer"])) if row["outer"] else file
                known = at
                content = [None if row[c] is None else _content(inner, row[c]) for c in ("wave", "textgrid", "transcript")]
                yield pa.RecordBatch.from_arrays([pa.array([row["speaker"]]), pa.array([row["utterance"]]), *(pa.array([c], pa.binary()) for c in content)], ["speaker", "utterance", "wave", "textgrid", "transcript"])
        if file is not None:
            file.close()

    together = F.when(F.col("outer").isNull(), F.xxhash64("speaker", "utterance")).otherwise(F.col("outer.offset"))
    return index.repartition(tasks, "path", together).sortWithinPartitions("path", "outer.offset").mapInArrow(rows, FILES)

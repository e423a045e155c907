"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 3 of 64 bits have a common variant about halfway. Every distinct fingerprint
emits itself and its 64 one-bit variants; those of even parity also emit two-bit variants whose two bits have the same
index parity. That is enough: fingerprints 1 or 2 bits apart meet in a variant one bit from each at most; of those 3
bits apart one is even, two of the three bits have the same index parity, and the variant that flips those two is one
bit from the other fingerprint. In a variant, owners within one bit are linked to all others by the triangle
inequality, so a star around one of them has all links; two owners that are both two bits away are no proof and are
skipped (they meet elsewhere if they are linked). Pairs that meet more than once are deduplicated, and every pair is verified by
the bits in which its fingerprints differ.

Variants are shuffled by their leading bits: a fingerprint goes to each bucket that one of its variants lies in, and
the bucket's task makes, sorts and matches the variants there, in runs of bounded size. So no variant crosses the
network. The number of leading bits grows with the number of distinct fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolith.llm import words as W
from phonolith.llm.components import components
from phonolith.llm.store import written

SEED = 42
#: Bits in which linked fingerprints differ at most; the variants above are made for this number.
MOST_BITS = 3
#: Variants that a task holds at once, and those that a bucket should have on average.
_RUN, _BUCKET, _MEAN_BALL = 1 << 21, 1 << 22, 561
# bit i of byte value v, in byte i of the entry, most significant first
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()


def fingerprints_of(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """SimHash of each text: lower-cased A-Z, shingles of words with repeats, XXH64 with seed 42, majority of each bit."""
    words = W.split(texts)
    n_docs = len(words.offsets) - 1
    if not len(words.starts):
        return np.zeros(n_docs, np.uint64)
    upper = (words.data >= 65) & (words.data <= 90)
    data = words.data + (upper.astype(np.uint8) << np.uint8(5))
    lengths = words.ends - words.starts + 1
    to = np.cumsum(lengths) - lengths
    blob = data[np.minimum(np.repeat(words.starts - to, lengths) + np.arange(lengths.sum()), len(data) - 1)]
    blob[to + lengths - 1] = 32
    ends = to + lengths - 1
    first = words.first
    n = np.diff(first)
    # a shingle starts at each word but the last ones; a shorter text is one shingle
    last = np.minimum(np.arange(len(to)) + shingle - 1, first[words.doc + 1] - 1)
    own = (np.arange(len(to)) + shingle <= first[words.doc + 1]) | ((n[words.doc] < shingle) & (np.arange(len(to)) == first[words.doc]))
    view, digest = memoryview(blob), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(to[own].tolist(), ends[last[own]].tolist(), strict=True)), np.uint64, int(own.sum()))
    doc = words.doc[own]
    # counts of up to 255 shingles fit in byte lanes, eight bits at a time
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    starts = np.flatnonzero((place % 255 == 0))
    counts = np.zeros((n_docs, 64), np.int64)
    parts = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        sums = np.add.reduceat(_LANES[parts[:, byte]], starts).view(np.uint8).reshape(-1, 8)
        np.add.at(counts[:, byte * 8 : byte * 8 + 8], doc[starts], sums)
    total = np.bincount(doc, minlength=n_docs)
    bits = (counts * 2 > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (a signed 64-bit integer) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints_of(part.column("text"), shingle).view(np.int64))], ["doc_id", "fp"])

    return documents.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, fp bigint")


@lru_cache
def _masks(free: int, even: bool) -> tuple[np.ndarray, np.ndarray]:
    """Flips of up to one bit, for even fingerprints up to two bits of equal index parity, among the lowest ``free``."""
    out = [(0, 0)] + [(1 << i, 1) for i in range(free)]
    if even:
        out += [(1 << i | 1 << j, 2) for i in range(free) for j in range(i + 2, free, 2)]
    return np.array([m for m, _ in out], np.uint64), np.array([d for _, d in out], np.int8)


def _variants(fp: np.ndarray, prefix: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All variants with the given leading bits: values, index of the fingerprint, bits flipped."""
    free = 64 - bits
    off = (fp >> np.uint64(free)) ^ np.uint64(prefix) if bits else np.zeros_like(fp)
    odd = (np.bitwise_count(fp) & 1).astype(bool)
    flips = np.bitwise_count(off)
    out = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int8))]

    def add(index: np.ndarray, base: np.ndarray, masks: np.ndarray, distance: np.ndarray) -> None:
        if len(index):
            out.append(((base[:, None] ^ masks[None, :]).ravel(), np.repeat(index, len(masks)), np.tile(distance, len(index)).astype(np.int8)))

    for even in (True, False):
        own = odd != even
        index = np.flatnonzero(own & (flips == 0))
        add(index, fp[index], *_masks(free, even))
        for b in range(bits):
            index = np.flatnonzero(own & (off == np.uint64(1 << b)))
            base = fp[index] ^ np.uint64(1 << (free + b))
            add(index, base, np.zeros(1, np.uint64), np.ones(1, np.int8))
            if even:
                low = [1 << i for i in range(free) if (i - free - b) % 2 == 0]
                add(index, base, np.array(low, np.uint64), np.full(len(low), 2, np.int8))
    for b in range(bits):
        for c in range(b + 2, bits, 2):
            index = np.flatnonzero(~odd & (off == np.uint64(1 << b | 1 << c)))
            add(index, fp[index] ^ np.uint64((1 << b | 1 << c) << free), np.zeros(1, np.uint64), np.full(1, 2, np.int8))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _meet(fp: np.ndarray, node: np.ndarray, prefix: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (node, node) of owners of a common variant with these leading bits, verified; halves the range while it has too many.
    Nodes are ascending."""
    free = 64 - bits
    near = np.bitwise_count((fp >> np.uint64(free)) ^ np.uint64(prefix)) <= 2 if bits else np.ones(len(fp), bool)
    fp, node = fp[near], node[near]
    if len(fp) < 2:
        return
    inside = int((fp >> np.uint64(free) == np.uint64(prefix)).sum()) if bits else len(fp)
    if (inside * _MEAN_BALL + (len(fp) - inside) * 16 > _RUN) and bits < 48:
        for low in (0, 1):
            yield from _meet(fp, node, prefix << 1 | low, bits + 1)
        return
    value, owner, distance = _variants(fp, prefix, bits)
    order = np.argsort(value)
    value = value[order]
    same = value[1:] == value[:-1]
    shared = np.zeros(len(value), bool)
    shared[1:], shared[:-1] = same, same | shared[:-1]
    shared[1:] |= same
    if not shared.any():
        return
    value, order = value[shared], order[shared]
    owner, core = owner[order], distance[order] <= 1
    starts = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    # the star is around the smallest node within a bit
    centre = np.minimum.reduceat(np.where(core, owner, len(node)), starts)
    centre = np.repeat(centre, np.diff(np.append(starts, len(value))))
    use = (centre != len(node)) & (centre != owner)
    u, v = np.unique(np.stack([owner[use], centre[use]], 1), axis=0).T
    close = np.bitwise_count(fp[u] ^ fp[v]) <= MOST_BITS
    yield node[u[close]], node[v[close]]


def links(nodes: DataFrame, n: int | None = None) -> DataFrame:
    """Links u, v that connect all of ``fp, node`` (distinct fingerprints) that differ in at most 3 bits."""
    n = nodes.count() if n is None else n
    bits = min(20, max(0, math.ceil(math.log2(max(n, 1) * _MEAN_BALL / _BUCKET))))
    masks = [0] + [1 << i for i in range(bits)] + [1 << i | 1 << j for i in range(bits) for j in range(i + 2, bits, 2)]
    prefix = F.shiftrightunsigned("fp", 64 - bits) if bits else F.lit(0).cast("bigint")
    buckets = F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: prefix.bitwiseXOR(m))
    dealt = nodes.select("fp", "node", F.explode(buckets).alias("bucket"))

    def rows(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("node").to_numpy())
        fp, node = table.column("fp").to_numpy().view(np.uint64)[order], table.column("node").to_numpy()[order]
        found = [*_meet(fp, node, int(table.column("bucket")[0].as_py()), bits)]
        u, v = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        return pa.table({"u": u, "v": v})

    return dealt.groupBy("bucket").applyInArrow(rows, "u bigint, v bigint").distinct()


def near_duplicates(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; component_id is the smallest id that links of at most 3 bits reach.

    Null and empty texts have fingerprint zero and are linked like others. A row without an id has a component, but
    gives it no id (null, if no row of it has one). Repeated rows are returned each. Other columns are not read.
    """
    docs = written(fingerprints(documents, shingle), "fingerprints")
    nodes = written(docs.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = components(links(nodes))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return docs.join(classes, "fp", "left").select("doc_id", "fp", "component_id")

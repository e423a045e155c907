"""Near copies by the Jaccard similarity of their sets of 5-word shingles.

Candidates are named twice. Ball hashing links texts whose SimHash fingerprints (``simhash``) differ in 3 bits at most; near copies
of this kind often differ in more, so MinHash bands add the rest: texts that agree in a band are linked to the smallest of the band.
The components of all these links are the groups in which near copies can lie. Inside a group pairs are compared by their whole sets, and
only pairs of ``LEAST`` or more are linked. A pair of similarity s has no common band with probability
(1 - s ** ROWS) ** BANDS: 5e-7 at 0.8, less above.

A large group is dealt in parts. First every text is compared with the group's representative (its smallest node), which each part
has a copy of: linear in the group. Texts of ``LEAST`` or more to it are linked to it and need no comparison with each other. One
minus the Jaccard similarity is a metric, so two texts can only be similar if their distances to the representative differ
by 1 - ``LEAST`` at most: texts are put in bands of that width, and only those beyond the first band are compared with their own and
the neighbouring bands, in pairs of parts. So a template with any number of near copies costs its number, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolith.llm import simhash
from phonolith.llm import words as W
from phonolith.llm.components import components
from phonolith.llm.store import written

SHINGLE, LEAST, ROWS, BANDS = 5, 0.8, 6, 48
#: Texts and bytes of text that a part of a group holds on average.
_PART, _PART_BYTES, _SALTS = 1024, 8 << 20, 16
_FACTORS = W.mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles of k words, ascending, and where each text's begin.

    A-Z are lower-cased. A text of fewer than k words is one shingle; a null or blank one has none.
    """
    words = W.split(texts)
    n_docs = len(words.offsets) - 1
    upper = (words.data >= 65) & (words.data <= 90)
    words = W.Words(words.data + (upper.astype(np.uint8) << np.uint8(5)), words.offsets, words.starts, words.ends, words.doc)
    if not len(words.starts):
        return np.empty(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    hashes, first = W.word_hashes(words), words.first
    first = np.append(first, len(hashes))[: n_docs + 1]
    grams, inside = W.gram_hashes(hashes, k), W.gram_inside(words.doc, k)
    found, doc = [grams[inside]], [words.doc[: len(inside)][inside]]
    for n in range(1, k):
        short = np.flatnonzero(np.diff(first) == n)
        if len(short):
            found.append(W.gram_hashes(hashes, n)[first[short]])
            doc.append(short)
    value, doc = np.concatenate(found), np.concatenate(doc)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(n_docs + 1))


def _nodes(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """128 bits for each set: equal sets have the same."""
    blob = memoryview(values.astype("<u8").tobytes())
    return pa.array([xxhash.xxh3_128_digest(blob[8 * a : 8 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())


def band_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``BANDS`` keys for each text that has shingles."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    keys = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band, np.uint64)
        for factor in _FACTORS[band * ROWS : (band + 1) * ROWS]:
            key = W.mix(key ^ np.minimum.reduceat(values * factor, starts))
        keys[:, band] = key
    return keys.view(np.int64)


def _signed(documents: DataFrame) -> DataFrame:
    """``doc_id, text_hash, rest, node, bytes, fp, bands`` of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        for batch in batches:
            for part in W.slices(batch, "text"):
                values, offsets = shingle_sets(part.column("text"))
                full = np.diff(offsets) > 0
                keys = band_keys(values, offsets) if full.any() else np.empty((0, BANDS), np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(full * BANDS)).astype(np.int32)), pa.array(keys.ravel()))
                fp = pa.array(simhash.fingerprints_of(part.column("text")).view(np.int64))
                size = pa.array(np.diff(W.raw(part.column("text"))[1]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), part.column("rest"), _nodes(values, offsets), size, fp, bands], ["doc_id", "text_hash", "rest", "node", "bytes", "fp", "bands"])

    return documents.select("doc_id", "text_hash", "rest", "text").mapInArrow(rows, "doc_id bigint, text_hash bigint, rest bigint, node binary, bytes bigint, fp bigint, bands array<bigint>")


def _texts(documents: DataFrame) -> DataFrame:
    """``node, text``, one row for each node."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        for batch in batches:
            for part in W.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([_nodes(*shingle_sets(part.column("text"))), part.column("text")], ["node", "text"])

    return documents.select("text").mapInArrow(rows, "node binary, text string").dropDuplicates(["node"])


def similar(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of ``LEAST`` or more: a square of booleans."""
    sizes = np.diff(offsets)
    m = len(sizes)
    doc = np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    value, doc = values[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    # a shingle of one text alone is in no intersection
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    number, doc = np.cumsum(new & shared)[shared] - 1, doc[shared]
    common, width = np.zeros((m, m), np.float32), 4096
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(number, [low, low + width])
        held = np.zeros((m, width), np.float32)
        held[doc[a:b], number[a:b] - low] = 1
        common += held @ held.T
    np.fill_diagonal(common, sizes)
    # whole numbers, so that exactly LEAST counts
    return np.rint(common).astype(np.int64) * round(100 + 100 * LEAST) >= round(100 * LEAST) * (sizes[:, None] + sizes[None, :])


def _linked(node: list[bytes], near: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Links that connect all of the nodes that a square of booleans connects."""
    root = np.full(len(node), -1)
    for i in range(len(node)):
        if root[i] < 0:
            front = np.zeros(len(node), bool)
            front[i] = True
            while front.any():
                root[front] = i
                front = near[front].any(0) & (root < 0)
    far = np.flatnonzero(root != np.arange(len(node)))
    return [node[i] for i in far], [node[root[i]] for i in far]


def _verify(table: pa.Table) -> pa.Table:
    """Links that connect all texts of two parts of a group that are similar."""
    W.lean()
    u, v = _linked(table.column("node").to_pylist(), similar(*shingle_sets(table.column("text"))))
    return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})


def _shares(values: np.ndarray, offsets: np.ndarray, of: int) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of the intersection and of the union of each set with one of them."""
    own = np.isin(values, values[offsets[of] : offsets[of + 1]])
    common = np.diff(np.append(0, np.cumsum(own))[offsets])
    sizes = np.diff(offsets)
    return common, sizes + sizes[of] - common


def _first(table: pa.Table) -> pa.Table:
    """Of one part of a group, with the representative: its links, and, of a group of several parts, the band of each text by its
    distance to the representative (those of the first band are linked)."""
    W.lean()
    node, parts, root = table.column("node").to_pylist(), table.column("parts")[0].as_py(), table.column("root")[0].as_py()
    values, offsets = shingle_sets(table.column("text"))
    if parts == 1:
        u, v = _linked(node, similar(values, offsets))
        bands = [None] * len(u)
    else:
        common, union = _shares(values, offsets, node.index(root))
        # whole numbers, so that exactly LEAST is in the first band
        far, step = round(100 * (1 - LEAST)), np.maximum(union, 1)
        band = np.maximum(-(-100 * (union - common) // (far * step)) - 1, 0)
        u, v, bands = node, [root if b == 0 else None for b in band], band.tolist()
        copies = [k for k, own in enumerate(table.column("copy").to_pylist()) if own]
        u, v, bands = ([x for k, x in enumerate(own) if k not in copies] for own in (u, v, bands))
    return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary()), "root": pa.array([root] * len(u), pa.binary()), "band": pa.array(bands, pa.int32())})


def _balls(fingerprints: DataFrame) -> DataFrame:
    """Links u, v of nodes whose fingerprints differ in at most ``simhash.MOST_BITS`` bits. fingerprints: ``fp, node``, each pair once."""
    first = written(fingerprints.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    equal = fingerprints.join(first.hint("shuffle_hash"), "fp").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    near = simhash.links(first.select("fp", F.col("fp").alias("node")))
    named = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")).hint("shuffle_hash")
    return equal.unionByName(near.join(named("u"), "u").join(named("v"), "v").where("u_node <> v_node").select(F.col("u_node").alias("u"), F.col("v_node").alias("v")))


def candidates(nodes: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """``node, root`` of the nodes that ball hashing or a shared band links to another, by the components of these links."""
    bands = nodes.select("node", F.explode("bands").alias("key"))
    met = bands.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("most")).where("v < most").select("key", "v")
    shared = bands.join(met.hint("shuffle_hash"), "key").where("node <> v").select(F.col("node").alias("u"), "v")
    return components(written(shared.unionByName(_balls(fingerprints)).distinct(), "bands"))


def _sized(groups: DataFrame, *by: str) -> DataFrame:
    """The number of parts of each large group (of more than one part)."""
    parts = F.ceil(F.greatest(F.count("*") / _PART, F.sum("bytes") / _PART_BYTES)).cast("int")
    return groups.groupBy(*by).agg(parts.alias("parts")).where("parts > 1")


def _with(rows: DataFrame, sizes: DataFrame, *by: str) -> DataFrame:
    """Rows with what is known of their group, where it is large. Rows of a group are spread over ``_SALTS`` keys, so a large group
    isn't joined in one task."""
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(_SALTS)).cast("int")).join(salted.hint("shuffle_hash"), [*by, "salt"], "left").drop("salt")


def links(documents: DataFrame, nodes: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Links u, v that connect all candidates of a similarity of ``LEAST`` or more. nodes: ``node, bytes, bands``, each once;
    fingerprints: the ``fp`` of each node's texts."""
    groups = written(nodes.select("node", "bytes").join(candidates(nodes, fingerprints), "node"), "groups")
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    dealt = written(_with(groups, _sized(groups, "root"), "root").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part), "dealt")
    # the representative is in its own part and, as a copy, in all others
    other = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("part"))
    copies = dealt.where((F.col("node") == F.col("root")) & (F.col("parts") > 1)).withColumn("part", F.explode(other)).withColumn("copy", F.lit(True))
    asked = dealt.withColumn("copy", F.lit(False)).unionByName(copies).select("node", "root", "parts", "part", "copy")
    texts = _texts(documents)
    first = written(texts.join(asked.hint("shuffle_hash"), "node").groupBy("root", "part").applyInArrow(_first, "u binary, v binary, root binary, band int"), "first")
    found = first.where("v is not null and u <> v").select("u", "v")
    left = first.where("band > 0").select("root").distinct()
    if left.isEmpty():  # every large group is like its representative
        return found
    banded = first.where("band is not null").select(F.col("u").alias("node"), "root", "band").join(left.hint("shuffle_hash"), "root", "left_semi").join(nodes.select("node", "bytes"), "node")
    banded = written(banded, "banded")
    # parts of every band of a group; a text meets the parts of its own and the neighbouring bands, unless both are of the first one
    sizes = banded.groupBy("root", "band").agg(F.greatest(F.lit(1), F.ceil(F.greatest(F.count("*") / _PART, F.sum("bytes") / _PART_BYTES))).cast("int").alias("n"))
    sizes = sizes.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("band", "n"))).alias("sizes"))  # a handful of bands
    placed = _with(banded, sizes, "root").withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.try_element_at("sizes", F.col("band"))))
    code = lambda band, part: band.cast("bigint") * F.lit(1 << 40) + part
    near = F.filter(F.array(*[F.col("band") + k for k in (-1, 0, 1)]), lambda b: (b >= 0) & ((b > 0) | (F.col("band") > 0)) & F.try_element_at("sizes", b).isNotNull())
    met = F.flatten(F.transform(near, lambda b: F.transform(F.sequence(F.lit(0), F.try_element_at("sizes", b) - 1), lambda p: code(b, p))))
    pairs = placed.withColumn("own", code(F.col("band"), F.col("part"))).withColumn("other", F.explode(met))
    rows = texts.join(pairs.select("node", "root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).distinct().hint("shuffle_hash"), "node").select("root", "a", "b", "node", "text")
    return found.unionByName(rows.groupBy("root", "a", "b").applyInArrow(_verify, "u binary, v binary"))


def without_near_copies(documents: DataFrame) -> DataFrame:
    """Of each group of texts that links of a similarity of ``LEAST`` or more connect, one row: that of the smallest id.

    Of rows with this id the one with the smallest hash stays. Rows without an id stay and take none away. Texts without
    words are near copies of each other. Sets of 64-bit hashes stand for the texts, and 128-bit hashes of these for sets that are equal.
    """
    rest = [c for c in documents.columns if c not in ("doc_id", "text")]
    key = ["doc_id", "text_hash", "rest"]
    docs = documents.withColumns({"text_hash": F.xxhash64("text"), "rest": F.xxhash64(*rest) if rest else F.lit(0).cast("bigint")})
    signed = written(_signed(docs.where("doc_id is not null")), "signed")
    nodes = written(signed.select("node", "bytes", "bands").dropDuplicates(["node"]), "nodes")
    found = components(written(links(docs.where("doc_id is not null"), nodes, signed.select("fp", "node").distinct()), "links"))
    best = signed.groupBy("node").agg(F.min(F.struct(*key)).alias("x")).join(found.hint("shuffle_hash"), "node", "left")
    kept = best.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("x").alias("x")).select("x.*")
    return docs.join(kept, key, "left_semi").dropDuplicates(key).unionByName(docs.where("doc_id is null")).select(*documents.columns)

"""Substring dedup on a De Bruijn graph of words.

An edge is a run of ``k`` words; edges that occur in two documents or more form the graph. Every edge has a source
coordinate: its first place in the smallest document that has it. An edge is plain if all its occurrences have one word
before and one word after. Neighbouring plain edges occur together everywhere, so their source coordinates are neighbours
too: paths without branches are the runs of neighbouring coordinates of plain edges. They are compacted by joins on
coordinates, blocks of 64 at a time: a run inside a block is read off the block's bits, a run over several blocks is found
by pointer doubling. No task walks along a document.

Every occurrence of a path is one row (document, first word, number of edges, source coordinate of the path's head). It
is cut out of its document only if its words are the source's words: a BLAKE2b digest of the words at the source
coordinate comes with it and is compared with that of the document's own words.

To keep unique text out of the shuffles, edges are made only where a document has an *anchor* that occurs in another
text: the smallest hash among the ``k - a + 1`` runs of ``a`` words in an edge. Equal edges have equal anchors, so
nothing is lost. Edges carry two independent 64-bit hashes, and 64 bits of both neighbours.

Whole-text copies are settled first by a 128-bit hash of the text; only the copy with the smallest id takes part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolith.llm import words as W
from phonolith.llm.store import forget, written

_SPAN = "array<struct<start:int,n:int,source:bigint,source_start:int>>"
_OWN = "array<struct<start:int,n:int,source:bigint,source_start:int,digest:binary>>"
_BLOCK = 64


def _anchors(batch: pa.RecordBatch, k: int, a: int) -> tuple[W.Words, np.ndarray, np.ndarray]:
    """Words, their hashes and, for every run of k words, its anchor; runs across texts are included."""
    words = W.split(batch.column("text"))
    hashes = W.word_hashes(words)
    grams = W.gram_hashes(hashes, a)
    return words, hashes, W.sliding_min(grams, k - a + 1) if len(hashes) >= k else np.empty(0, np.uint64)


def _anchor_rows(k: int, a: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # the texts of this task; its copies add nothing
        for batch in batches:
            new = []
            for i, d in enumerate(batch.column("d").to_pylist()):
                if d not in seen:
                    seen.add(d)
                    new.append(i)
            for part in W.slices(batch.take(pa.array(new, pa.int64())), "text") if new else ():
                words, _, least = _anchors(part, k, a)
                inside = W.gram_inside(words.doc, k)
                h, doc = least[inside], words.doc[: len(least)][inside]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                d = part.column("d").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(h[fresh].view(np.int64)), pa.array(d[doc[fresh]])], ["h", "d"])

    return rows


def _edge_rows(k: int, a: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                words, hashes, least = _anchors(part, k, a)
                if not len(least):
                    continue
                # an anchor that any document has from the list occurs in two texts: the list of the batch will do
                marked = part.column("anchors").flatten().to_numpy().view(np.uint64)
                at = np.flatnonzero(W.gram_inside(words.doc, k) & np.isin(least, marked))
                if not len(at):
                    continue
                first = words.first
                doc = words.doc[at]
                after = np.where(at + k < first[doc + 1], hashes[np.minimum(at + k, len(hashes) - 1)], np.uint64(0))
                before = np.where(at > first[doc], hashes[at - 1], np.uint64(0))
                second = W.gram_hashes(W.word_hashes(words, 1), k)
                ids = part.column("doc_id").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(W.gram_hashes(hashes, k)[at].view(np.int64)),
                        pa.array(second[at].view(np.int64)),
                        pa.array(ids[doc]),
                        pa.array((at - first[doc]).astype(np.int32)),
                        pa.array(W.mix(before * np.uint64(W._BASE) + after).view(np.int64)),
                    ],
                    ["e", "g", "doc", "pos", "beside"],
                )

    return rows


def _digests(words: W.Words, first: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[bytes]:
    """A digest of n words from word ``start`` of a text on, joined by one space, for each of the runs (text by number)."""
    lengths = words.ends - words.starts + 1
    to = np.append(0, np.cumsum(lengths))
    blob = words.data[np.minimum(np.repeat(words.starts - to[:-1], lengths) + np.arange(to[-1]), len(words.data) - 1)]
    blob[to[1:] - 1] = 32
    view = memoryview(blob)
    low = first[doc] + start
    return [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(to[low].tolist(), (to[low + n] - 1).tolist(), strict=True)]


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """For every entry of an array column the row it is in, and the entries; null has none."""
    sizes = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), column.flatten()


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "text"):
            words = W.split(part.column("text"))
            doc, paths = _lists(part.column("paths"))
            start, n = (paths.field(c).to_numpy() for c in ("source_start", "n"))
            found = pa.array(_digests(words, words.first, doc, start, n), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), paths.field("source_start"), paths.field("n"), found], ["source", "source_start", "n", "digest"])


def _cut_rows(k: int):
    names = ("start", "n", "source", "source_start")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())])))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                words = W.split(part.column("text"))
                first = words.first
                n_words = np.diff(first)
                doc, own = _lists(part.column("spans"))
                start, n, source, source_start = (own.field(c).to_numpy() for c in names)
                ok = (start >= 0) & (start + n <= n_words[doc])
                ok[ok] = [a == b for a, b in zip(_digests(words, first, doc[ok], start[ok], n[ok]), own.field("digest").filter(pa.array(ok)).to_pylist(), strict=True)]
                copy_of = part.column("copy_of")
                copies = np.flatnonzero(~np.asarray(copy_of.is_null()) & (n_words >= k))
                doc, start, n = np.append(doc[ok], copies), np.append(start[ok], 0 * copies), np.append(n[ok], n_words[copies])
                source, source_start = np.append(source[ok], copy_of.take(pa.array(copies)).to_numpy()), np.append(source_start[ok], 0 * copies)
                gone = W.covered(first[doc] + start, n, len(words.starts)) if len(doc) else np.zeros(len(words.starts), bool)
                total = np.append(0, np.cumsum(gone))
                order = np.argsort(doc, kind="stable")
                entries = pa.StructArray.from_arrays([pa.array(x[order].astype(t)) for x, t in zip((start, n, source, source_start), (np.int32, np.int32, np.int64, np.int32), strict=True)], fields=list(schema.field("spans").type.value_type))
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order], np.arange(len(n_words) + 1)).astype(np.int32)), entries)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(total[first[1:]] - total[first[:-1]]), pa.array(W.joined(words, ~gone), pa.string()), spans.cast(schema.field("spans").type)], schema=schema)

    return rows


def _heads(nodes: DataFrame) -> DataFrame:
    """``source, source_start, head``: for the coordinate of each plain edge where its path begins (at most there).

    nodes: ``source, source_start`` (distinct). Blocks of 64 coordinates are rows with a bit for each edge; those in which
    all bits are set point to the block before them, and the pointers are doubled until they stand still.
    """
    block, offset = F.floor(F.col("source_start") / _BLOCK).cast("int"), F.pmod("source_start", F.lit(_BLOCK)).cast("int")
    bits = F.expr(f"bit_or(shiftleft(1L, pmod(source_start, {_BLOCK})))")
    blocks = written(nodes.groupBy("source", block.alias("block")).agg(bits.alias("bits")), "blocks")
    over = lambda gaps: F.when(gaps == 0, 0).otherwise(F.length(F.bin(gaps)))  # noqa: E731  place after the highest gap
    full = blocks.where("bits = -1").select("source", "block")
    before = full.select("source", (F.col("block") + 1).alias("block"), F.lit(1).alias("back"))
    reach = written(full.join(before, ["source", "block"], "left").select("source", "block", F.coalesce("back", F.lit(0)).cast("bigint").alias("back")), "reach")
    total = 0
    while (now := reach.agg(F.sum("back")).first()[0] or 0) != total:
        total, old = now, reach
        hop = old.select("source", F.col("block").alias("to"), F.col("back").alias("more"))
        further = old.withColumn("to", (F.col("block") - F.col("back")).cast("int")).join(hop, ["source", "to"])
        reach = written(further.select("source", "block", F.when(F.col("back") > 0, F.col("back") + F.col("more")).otherwise(0).alias("back")), "reach")
        forget(old)
    # where a run that reaches the end of a block begins: inside it, or in the last block before a chain of full ones
    last = blocks.where("bits < 0").join(reach, ["source", "block"], "left").withColumn("from", (F.col("block") - F.coalesce("back", F.lit(-1))).cast("int"))
    inner = blocks.where("bits < 0 and bits <> -1").select("source", F.col("block").alias("at"), (F.col("block") * _BLOCK + over(F.bitwise_not("bits"))).alias("begins"))
    chained = last.where("bits = -1").withColumn("at", (F.col("from") - 1).cast("int")).join(inner, ["source", "at"], "left")
    ends = chained.select("source", "block", F.coalesce("begins", F.col("from") * _BLOCK).alias("begins")).unionByName(inner.withColumnRenamed("at", "block"))
    entry = ends.select("source", (F.col("block") + 1).cast("int").alias("block"), "begins")
    blocks = blocks.join(entry, ["source", "block"], "left").select("source", "block", "bits", "begins")
    gaps = F.bitwise_not("bits").bitwiseAND(F.bitwise_not(F.expr("shiftleft(-1L, offset)")))
    inside = nodes.select("source", "source_start", block.alias("block"), offset.alias("offset")).join(blocks, ["source", "block"])
    head = F.when(gaps == 0, F.coalesce("begins", F.col("block") * _BLOCK)).otherwise(F.col("block") * _BLOCK + over(gaps))
    return inside.select("source", "source_start", head.cast("int").alias("head"))


def _coordinate(document: Column, place: Column) -> Column:
    """Document and place as one number, in their order."""
    return (document.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + place).cast("decimal(38,0)")


def repeated_paths(documents: DataFrame, k: int = 13, a: int = 6) -> tuple[DataFrame, DataFrame]:
    """Occurrences of branch-free paths in texts that are no copies, and every id with the copy it repeats.

    The first table has ``doc, start, n_edges, source, source_start`` (the coordinate of the path's first edge: the
    smallest document with it, and its first place there), the second ``doc_id, d, copy_of`` (d: a hash of the text;
    copy_of: null unless a smaller id has the same text).
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    docs = docs.withColumns({"d": F.xxhash64("text"), "d2": F.xxhash64(F.lit(1), "text")})
    # one text for each id, should an id be there with several
    ids = docs.groupBy("doc_id").agg(F.min(F.struct("d", "d2")).alias("x")).select("doc_id", "x.d", "x.d2")
    ids = written(ids, "ids")
    copies = ids.groupBy("d", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").drop("last")
    copies = written(copies, "copies")  # so that the join deals the ids anew, and a large group of copies is split
    ids = ids.join(copies, ["d", "d2"], "left").select("doc_id", "d", F.when(F.col("doc_id") != F.col("first"), F.col("first")).alias("copy_of"))

    anchors = docs.select("d", "text").mapInArrow(_anchor_rows(k, a), "h bigint, d bigint")
    shared = anchors.groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo <> hi").select("h")
    marked = anchors.join(shared, "h", "left_semi").groupBy("d").agg(F.collect_set("h").alias("anchors"))
    originals = ids.where("copy_of is null").select("d", "doc_id")
    marked = written(marked.join(originals, "d"), "anchors")

    todo = docs.select("doc_id", "d", "text").join(marked, ["doc_id", "d"])
    edges = todo.select("doc_id", "text", "anchors").mapInArrow(_edge_rows(k, a), "e bigint, g bigint, doc bigint, pos int, beside bigint")
    edges = written(edges, "edges")
    forget(marked)

    # a node is plain if all its occurrences have one word before and one word after
    nodes = edges.groupBy("e", "g").agg(F.min(_coordinate(F.col("doc"), F.col("pos"))).alias("at"), F.max("doc").alias("last"), (F.min("beside") == F.max("beside")).alias("plain"))
    source = F.floor(F.col("at") / F.lit(1 << 32).cast("decimal(10,0)")).cast("bigint")
    nodes = nodes.withColumn("source", source).where("source <> last").withColumn("source_start", F.pmod("at", F.lit(1 << 32).cast("decimal(38,0)")).cast("int"))
    nodes = written(nodes.select("e", "g", "source", "source_start", "plain"), "nodes")
    heads = _heads(nodes.where("plain").select("source", "source_start"))
    nodes_at = nodes.join(heads.withColumn("plain", F.lit(True)), ["source", "source_start", "plain"], "left")
    nodes_at = written(nodes_at.select("e", "g", "source", F.coalesce("head", "source_start").alias("source_start"), (F.col("source_start") - F.coalesce("head", "source_start")).alias("along")), "nodes")
    walked = edges.select("e", "g", "doc", "pos").join(nodes_at, ["e", "g"])
    paths = walked.groupBy("doc", (F.col("pos") - F.col("along")).alias("start"), "source", "source_start").agg((F.max("along") + 1).alias("n_edges"))
    paths = written(paths, "paths")
    for used in (edges, nodes, nodes_at):
        forget(used)
    return paths, ids


def remove_repeated_spans(documents: DataFrame, k: int = 13, a: int = 6) -> DataFrame:
    """Cut out of every document the words of runs of k words that also start in a document with a smaller id.

    Returns ``doc_id, n_words, n_removed, kept_text, spans``; spans are (first word, words, document and word of the
    source). Null and empty texts have no words. Of repeated rows all are returned, cut alike; a row without an id, or
    whose id also has another text with a smaller hash, is returned whole and is no source. Other columns are not read.
    """
    paths, ids = repeated_paths(documents, k, a)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("d", F.xxhash64("text"))
    found = paths.where("source < doc").select(F.col("doc").alias("doc_id"), "start", (F.col("n_edges") + k - 1).alias("n"), "source", "source_start")
    asked = found.select(F.col("source").alias("doc_id"), "source_start", "n").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("source_start", "n")).alias("paths"))
    asked = ids.select("doc_id", "d").join(asked, "doc_id")
    proof = texts.join(asked, ["doc_id", "d"]).select("doc_id", "text", "paths").mapInArrow(_digest_rows, "source bigint, source_start int, n int, digest binary").distinct()
    proof = written(proof, "proof")  # so that the join deals both sides anew, and a hot path is split
    spans = found.join(proof, ["source", "source_start", "n"]).groupBy("doc_id")
    spans = spans.agg(F.sort_array(F.collect_list(F.struct("start", "n", "source", "source_start", "digest"))).cast(_OWN).alias("spans"))
    plan = ids.join(spans, "doc_id", "left").where("spans is not null or copy_of is not null")
    whole = texts.join(plan, ["doc_id", "d"], "left").select("doc_id", "text", "spans", "copy_of")
    return whole.mapInArrow(_cut_rows(k), f"doc_id bigint, n_words bigint, n_removed bigint, kept_text string, spans {_SPAN}")

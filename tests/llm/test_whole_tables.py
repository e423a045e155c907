"""Queries without SQL, over all rows of a table, against plain versions of their contracts."""

import hashlib
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from phonolith.llm import matroska, mixing, queries, store, token_files
from tests.llm.test_documents import WORD, frame, random_rows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").collect()


def ids_of(name, end):
    tokenizer = Tokenizer.from_file(queries.tokenizer(name))
    return lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files_of_all_rows(spark, rows):
    encode, at = ids_of("word_bpe_49k.json", 1), 0
    got = {r.doc_id: r for r in queries.op5_token_files(spark, SMALL).collect()}
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = encode(r.text)
        assert tuple(got[r.doc_id])[:4] == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(rows)


def test_packing_of_all_rows(spark, rows):
    encode, pieces, windows = ids_of("byte_bpe_50k.json", 0), defaultdict(list), defaultdict(list)
    for r in queries.op9_packing(spark, SMALL).collect():
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    for r in rows:
        ids, at = encode(r.text), 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(1024 - sum(n for _, n in own) for own in windows.values()) < 0.02 * 1024 * len(windows) + 1024


def test_media_of_all_rows(spark, rows):
    got = {r.doc_id: r for r in queries.op8_media_columns(spark, SMALL).collect()}
    assert len(got) == len(rows)
    forms = defaultdict(set)
    for r in rows:
        text = (r.text or "").encode()
        payload = text + b" " * (-len(text) % 192 if text else 192)
        media = matroska.mux(payload)
        m = got[r.doc_id]
        assert (m.n_bytes, m.payload_bytes, m.payload_sha256, m.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (m.media_bytes, m.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        forms[r.text].add(m.feature)
    assert all(len(f) == 1 for f in forms.values()) and len({*map(min, forms.values())}) > 0.9 * len(forms)


def test_media_of_odd_rows(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, "", "s"), (4, "é" * 100_000, "s"), (4, "é" * 100_000, "s"), (None, "no id", "s"), (5, "\0\x01", "s")]
    out = matroska.read_media(matroska.mux_texts(frame(spark, rows))).select("doc_id", "n_bytes", "payload", "error").collect()
    assert sorted((r.doc_id or 0, r.n_bytes, len(r.payload)) for r in out) == [(0, 5, 192), (1, 0, 192), (2, 0, 192), (3, 0, 192), (4, 200_000, 200_064), (4, 200_000, 200_064), (5, 2, 192)]
    assert all(r.error is None for r in out)
    assert matroska.read_media(matroska.mux_texts(frame(spark, []))).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(doc_id, text):
    """What Spark's xxhash64 gives for the seed, the id and the hash of the text; nulls leave the hash as it is."""
    long = lambda n, seed: xxhash.xxh64_intdigest((n % (1 << 64)).to_bytes(8, "little"), seed)
    own = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    h = xxhash.xxh64_intdigest(mixing.SEED.to_bytes(4, "little"), 42)
    return signed(long(own, h if doc_id is None else long(doc_id, h)))


def naive_mix(docs, weights=(3, 1, 2), share=1.5, most=2):
    """(doc_id, text) -> size, source size, target, taken of documents (id, text, source) that have one source each."""
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, x in docs if x == s) for s in sources}
    weight = {s: weights[i % 3] for i, s in enumerate(sources)}
    target, free, left = {}, list(sources), share * sum(total.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > most * total[s]]
        target |= {s: most * total[s] for s in over} or {s: unit * weight[s] for s in free}
        left -= sum(most * total[s] for s in over)
        free = [s for s in free if s not in target]
    out = []
    for s in sources:
        own = [(spark_hash(i, t), i, t) for i, t, x in docs if x == s]
        own.sort(key=lambda x: (x[0] % 1024, (x[0] >> 10) % 1024, x[0]))
        whole, rest = divmod(round(target[s]), total[s]) if total[s] else (0, 0)
        for _, i, t in own:
            part = min(size(t), rest)
            rest -= part
            out.append((i, size(t), total[s], target[s], whole * size(t) + part))
    return out


def test_mix_of_all_rows(spark, rows):
    want = naive_mix([(r.doc_id, r.text, r.source) for r in rows])
    got = [tuple(r) for r in queries.op6_source_mixing(spark, SMALL).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a == pytest.approx(b)


def test_mix_of_odd_rows_and_ties(spark, monkeypatch):
    rows = [*random_rows(6, n=200), (None, "no id here", "s1"), (7, "again", "s2"), (8, "same same", "s1"), (8, "same same", "s1"), (9, None, "only empty"), (10, "", None)]
    for buckets in (1024, 2):
        monkeypatch.setattr(mixing, "_BUCKETS", buckets)
        got = [tuple(r) for r in mixing.mix(frame(spark, rows)).select("doc_id", "size", "source_size", "target", "taken").collect()]
        order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
        if buckets == 1024:
            for a, b in zip(sorted(got, key=order), sorted(naive_mix(rows), key=order), strict=True):
                assert a == pytest.approx(b)
        taken, target = Counter(), {}
        for _, _, source_size, goal, n in got:
            taken[source_size, goal] += n
            target[source_size, goal] = goal
        assert all(abs(taken[k] - target[k]) <= 0.5 for k in target)


def test_flow_of_parts_is_the_flow_of_the_whole():
    rng = np.random.default_rng(0)
    for _ in range(20):
        members = {tuple(sorted(rng.choice(list("abcdefgh"), rng.integers(1, 3), replace=False).tolist())): 0 for _ in range(6)}
        members = {p: list(p) for p in members}
        supply = {p: int(rng.integers(0, 20)) for p in members}
        demand = {s: float(rng.integers(0, 30)) for p in members for s in p}
        cost = lambda flow: (sum(flow.values()), sum(max(0, sum(n for (q, _), n in flow.items() if q == p) - supply[p]) for p in members))  # noqa: E731, B023
        assert cost(mixing.flow_by_parts(supply, members, demand)) == pytest.approx(cost(mixing.min_cost_flow(supply, members, demand)))


def test_many_sources_send_one_row_each_to_the_driver(spark, monkeypatch):
    n, seen = 20_000, []
    kind = type(spark.range(1))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: (lambda out: (seen.append(len(out)), out)[1])(collect(df)))
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % n).alias("source"), F.lit("two words").alias("text"))
    taken = mixing.mix(docs).agg(F.sum("taken"), F.count("*")).first()
    assert taken[1] == 2 * n and taken[0] == pytest.approx(1.5 * 4 * n, rel=0.2) and max(seen) <= n


def test_many_files_send_one_row_for_each_part_to_the_driver(spark, tmp_path, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), "id").alias("text"))
    token_files.write_token_files(docs, f"{tmp_path}/t", queries.tokenizer("word_bpe_49k.json"), 1, file_bytes=1)
    files = spark.read.parquet(f"{tmp_path}/t/files")
    parts = files.select("part").distinct().count()
    assert files.count() == 3000
    seen, kind = [], type(spark.range(1))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: (lambda out: (seen.append(len(out)), out)[1])(collect(df)))
    out = token_files.read_token_files(spark, f"{tmp_path}/t")
    assert max(seen) <= parts
    at = 0
    for r in out.orderBy("doc_id").collect():
        assert r.start == at
        at += len(r.ids) // 4


def test_a_cluster_without_a_shared_folder_is_an_error():
    session = lambda folder, master: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        store.shared_dir(session(None, "spark://host:7077"))
    assert store.shared_dir(session("hdfs://shared/", "spark://host:7077")) == "hdfs://shared"
    assert store.shared_dir(session(None, "local[2]")).startswith("file:///")

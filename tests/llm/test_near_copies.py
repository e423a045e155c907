"""Near copies against brute-force Jaccard similarities."""

import re

import numpy as np
import pyarrow as pa
from tests.llm.test_documents import WORD, classes

import corpus_pipeline
from phonolith.llm import near_copies, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def close(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b) > 0


def edited(seed=3, groups=25):
    """Texts of 30 to 400 words with copies in which some words are others, around a similarity of 0.8."""
    rng, rows = np.random.default_rng(seed), []
    for _ in range(groups):
        base = [f"W{k}" for k in rng.integers(0, 5000, rng.integers(30, 400))]
        for share in (0, 0.005, 0.02, 0.03, 0.05):
            copy = [f"x{rng.integers(0, 99999)}" if rng.random() < share else w.lower() if rng.random() < 0.5 else w for w in base]
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_stage_is_brute_force_jaccard(spark, monkeypatch):
    rows = [*edited(), (500, None), (501, " "), (502, "one two"), (503, "One two"), (504, "one three"), (505, "a a a a a a a"), (506, "a a a a a")]
    sets = {i: shingles(t) for i, t in rows}
    want = sorted(set(classes(list(sets), lambda a, b: close(sets[a], sets[b])).values()))
    assert 30 < len(want) < len(rows) - 30
    for part in (1024, 3):  # groups of one part and of several
        monkeypatch.setattr(near_copies, "_PART", part)
        assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()) == want


def test_similar_pairs_are_brute_force():
    rows = edited(5, 12)
    sets = [shingles(t) for _, t in rows]
    got = near_copies.similar(*near_copies.shingle_sets(pa.array([t for _, t in rows])))
    assert (got == np.array([[close(a, b) for b in sets] for a in sets])).all()


def test_representative_and_bands_lose_no_link(spark, monkeypatch):
    """Chains of copies of copies that move away from the representative, in one candidate group, dealt in parts of a few."""
    monkeypatch.setattr(near_copies, "_PART", 4)
    rng, rows, words = np.random.default_rng(8), [], [f"w{k}" for k in range(120)]
    for k in range(90):
        rows.append((k, " ".join(words)))
        words = list(words)
        words[rng.integers(0, 120)] = f"y{k}"
        if k % 30 == 29:
            words[40:90] = [f"z{k}x{j}" for j in range(50)]
    sets = {i: shingles(t) for i, t in rows}
    want = sorted(set(classes(list(sets), lambda a, b: close(sets[a], sets[b])).values()))
    # every text is a candidate of every other
    monkeypatch.setattr(near_copies, "candidates", lambda nodes: nodes.select("node").crossJoin(nodes.agg({"node": "min"}).withColumnRenamed("min(node)", "root")))
    docs = table(spark, rows)
    assert sorted(r.doc_id for r in near_copies.without_near_copies(docs).collect()) == want and 1 < len(want) < 10
    signed = near_copies._signed(docs.withColumns({"text_hash": docs.doc_id, "rest": docs.doc_id}))
    found = near_copies.links(docs, signed.select("node", "bytes", "bands").dropDuplicates(["node"])).collect()
    node = {r.doc_id: bytes(r.node) for r in signed.collect()}
    of, own = {n: i for i, n in node.items()}, classes(list(sets), lambda a, b: close(sets[a], sets[b]))
    assert found and all(own[of[bytes(r.u)]] == own[of[bytes(r.v)]] for r in found)


def test_bands_of_distances():
    texts = [" ".join([*(f"a{k}" for k in range(n)), *(f"{n}b{k}" for k in range(100 - n))]) for n in (100, 95, 80, 50, 0)]
    values, offsets = near_copies.shingle_sets(pa.array(texts))
    common, union = near_copies._shares(values, offsets, 0)
    sets = [shingles(t) for t in texts]
    assert common.tolist() == [len(s & sets[0]) for s in sets] and union.tolist() == [len(s | sets[0]) for s in sets]


def test_a_template_costs_its_number_of_copies():
    """Of 4000 near copies of one text every part compares its own with the representative only: no pairs of parts are left."""
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join([*words, f"x{k}"]) for k in range(4000)]
    values, offsets = near_copies.shingle_sets(pa.array(texts))
    common, union = near_copies._shares(values, offsets, 0)
    assert (5 * common >= 4 * union).all()


def test_ball_hashing_alone_links_near_copies(spark, monkeypatch):
    """Without a common band, copies whose fingerprints differ in at most 3 bits are still found; unlike texts stay."""
    lonely = np.random.default_rng(4)
    monkeypatch.setattr(near_copies, "band_keys", lambda values, offsets: np.random.default_rng(int(values[:1].sum() % 2**31)).integers(-(2**62), 2**62, (int((np.diff(offsets) > 0).sum()), near_copies.BANDS)))
    base = [f"w{k}" for k in lonely.integers(0, 5000, 900)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:450], "x", *base[451:]])), (3, " ".join(f"v{k}" for k in range(900)))]
    a, b = simhash.fingerprints_of(pa.array([rows[0][1], rows[1][1]]))
    assert a != b and int(a ^ b).bit_count() <= simhash.MOST_BITS
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()) == [1, 3]

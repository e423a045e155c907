"""Operators on documents against brute force, with null, empty, repeated and very long rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from phonolith.llm import mixing, packing, pii, quality, queries, simhash, substring_dedup, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, quality string, pii string, d int, h int, bucket int, media string, spans int"


def frame(spark, rows):
    """Documents (id, text, source) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, "q", "p", 1, 2, 3, "m", 4) for i, t, s in rows], SCHEMA).repartition(3)


def random_rows(seed, n=60, words=5, length=40):
    rng = np.random.default_rng(seed)
    names = ["a", "b", "é", "dd", "E"][:words]
    rows = []
    for i in range(n):
        text = " ".join(names[k] for k in rng.integers(0, words, rng.integers(0, length)))
        rows.append((i, text.replace(" ", "\n", 1) if i % 5 == 0 else text, f"s{i % 4}" if i % 7 else None))
    rows += [(100, rows[3][1], "s1"), (101, rows[3][1], "s1"), (102, None, "s0"), (103, "", None), (104, " \t\n ", "s2"), (105, " ".join(names * 1000), "s3")]
    return rows


def test_substring_dedup_is_brute_force(spark):
    for k, a in ((3, 2), (5, 3), (13, 6)):
        rows = random_rows(k, words=2 if k == 13 else 4)
        words = {i: WORD.findall(t or "") for i, t, _ in rows}
        first = {}
        for i in sorted(words):
            for p in range(len(words[i]) - k + 1):
                first.setdefault(tuple(words[i][p : p + k]), i)
        want = {}
        for i, w in words.items():
            gone = {p + j for p in range(len(w) - k + 1) if first[tuple(w[p : p + k])] < i for j in range(k)}
            want[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
        out = substring_dedup.remove_repeated_spans(frame(spark, rows), k, a).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out} == want
        assert all(s.source < r.doc_id for r in out for s in r.spans)


def test_substring_dedup_of_odd_rows(spark):
    text = " ".join("abcdefghijklmnopq")
    out = substring_dedup.remove_repeated_spans(frame(spark, [(5, text, "s"), (5, text, "s"), (None, text, "s"), (7, "x " + text, "s")])).collect()
    assert sorted(((r.doc_id or -1), r.n_removed) for r in out) == [(-1, 0), (5, 0), (5, 0), (7, 17)]
    assert substring_dedup.remove_repeated_spans(frame(spark, [])).count() == 0


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, linked):
    """Smallest member that each item reaches."""
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in items}


def test_near_duplicates_are_brute_force(spark):
    rng = np.random.default_rng(4)
    base = " ".join(f"w{k}" for k in rng.integers(0, 300, 120))
    near = [(200 + i, re.sub(f"w{i} ", f"v{i} ", base, count=i % 4), "s") for i in range(40)]
    rows = [*random_rows(1), *near]
    prints = {i: brute_fingerprint(t) for i, t, _ in rows}
    want = classes(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    out = simhash.near_duplicates(frame(spark, [*rows, (None, base, "s"), (3, rows[3][1], "s")])).collect()
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == want
    assert len(out) == len(rows) + 2 and len(set(want.values())) < len(want) - 5
    assert all(r.fp % (1 << 64) == prints[r.doc_id] for r in out if r.doc_id is not None)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_ball_hashing_finds_all_links(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    flips = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)) for b in base[:100] for k in (1, 2, 3, 3, 4)]
    fp = np.unique(np.concatenate([base, np.array(flips, np.uint64)]))
    node, far = np.arange(len(fp)), np.bitwise_count(fp[:, None] ^ fp[None, :])
    want = classes(node.tolist(), lambda a, b: far[a, b] <= 3)
    for bits, run in ((0, 1 << 21), (5, 1 << 21), (0, 20_000)):
        monkeypatch.setattr(simhash, "_RUN", run)
        found = {(a, b) for prefix in range(1 << bits) for u, v in simhash._meet(fp, node, prefix, bits) for a, b in zip(u.tolist(), v.tolist(), strict=True)}
        assert all(far[a, b] <= 3 for a, b in found)
        assert classes(node.tolist(), lambda a, b: (a, b) in found or (b, a) in found) == want


def naive_measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {p + j for p in range(len(words) - 7) if grams[tuple(words[p : p + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    letters = re.findall("[A-Za-z]", text)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(again), len(letters), sum(c.isupper() for c in letters),
        sum(a == b for a, b in zip(words, words[1:], strict=False)),
    )


def test_quality_ledger(spark):
    rows = [*random_rows(2, words=2), (300, "THE!! END!! #|#\nx y\nx y\n \n", "s"), (301, "wie wie wie " * 20, "s"), (302, "clean words here and there " + " ".join(f"n{i}" for i in range(40)), "s")]
    held = quality.ledger(frame(spark, rows)).cache()
    for r in held.collect():
        assert tuple(r.quality)[:-1] == naive_measures(dict((i, t) for i, t, _ in rows)[r.doc_id])
    fails = {r.doc_id: r.quality.failures for r in held.collect()}
    assert fails[302] == 0 and fails[102] & 1 and fails[301] & 128
    found = {r.rule: (r.fails, r.fails_alone) for r in quality.ablations(held, quality.V1).collect()}
    for bit, name, _ in quality.RULES:
        assert found[name] == (sum(f >> bit & 1 for f in fails.values()), sum(f == 1 << bit for f in fails.values()))
    assert held.where(quality.passes(quality.BASE)).count() == sum(f & 3 == 0 for f in fails.values())
    assert quality.ledger(frame(spark, [])).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    rows = [*random_rows(3), (None, "no id", "s"), (7, "again <|x|> don't", "s")]
    path = queries.tokenizer("word_bpe_49k.json")
    token_files.write_token_files(frame(spark, rows), f"{tmp_path}/t", path, 1, file_bytes=500)
    out = token_files.read_token_files(spark, f"{tmp_path}/t").orderBy("start").collect()
    from tokenizers import Tokenizer

    tokenizer, at = Tokenizer.from_file(path), 0
    assert [r.doc_id for r in out] == sorted((i for i, *_ in rows), key=lambda i: -1 if i is None else i)
    texts = defaultdict(list)
    for i, t, _ in rows:
        texts[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    for r in out:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and ids in texts[r.doc_id]
        texts[r.doc_id].remove(ids)
        at += len(ids)
    file = spark.read.parquet(f"{tmp_path}/t/files").first().file
    with pytest.raises(ValueError):
        token_files.read_index(bytes(file), b"another dictionary")
    token_files.write_token_files(frame(spark, []), f"{tmp_path}/e", path, 1)
    assert token_files.read_token_files(spark, f"{tmp_path}/e").count() == 0


def test_packing_covers_every_token_once(spark):
    path = queries.tokenizer("byte_bpe_50k.json")
    rows = [*random_rows(5), (None, "no id", "s"), (7, "twice", "s")]
    out = packing.pack(frame(spark, rows), path, 0, length=64, open_windows=4).collect()
    from tokenizers import Tokenizer

    tokenizer, pieces, windows = Tokenizer.from_file(path), defaultdict(list), defaultdict(list)
    for r in out:
        assert len(r.ids) == 4 * r.length
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        ends = [o + n for o, n in sorted(w)]
        assert [o for o, _ in sorted(w)] == [0, *ends[:-1]] and ends[-1] <= 64
    for i, t, _ in rows:
        if i in (7, None):
            continue
        own = sorted(pieces[i], key=lambda r: r.start)
        ids = [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()]
        assert ids == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] and all(r.doc_tokens == len(ids) for r in own)
    assert sum(len(w) and 64 - max(o + n for o, n in w) for w in windows.values()) < 0.05 * 64 * len(windows) + 64
    assert packing.pack(frame(spark, []), path, 0).count() == 0


def test_mixing_targets_and_takes(spark):
    rows = [*random_rows(6, n=200), (None, "no id here", "s1"), (7, "again", "s2")]
    out = mixing.mix(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 1 and target[s] <= 2 * size[s] + 1e-6 for s in target)
    again = mixing.mix(frame(spark, rows)).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.mix(frame(spark, [])).count() == 0


def test_targets_reshare_what_is_above():
    assert mixing.capped_targets([("b", 10), ("a", 90), (None, 0)]) == pytest.approx({"a": 130.0, "b": 20.0, None: 0.0})


def test_flow_is_cheapest():
    """Overlapping sources: against all whole-number splits."""
    supply, members, demand = {("a",): 3, ("a", "b"): 4, ("b",): 1}, {("a",): ["a"], ("a", "b"): ["a", "b"], ("b",): ["b"]}, {"a": 5.0, "b": 6.0}
    flow = mixing.min_cost_flow(supply, members, demand)
    cost = lambda used: sum(max(0, n - supply[p]) for p, n in used.items())
    best = min(
        (cost({("a",): x, ("a", "b"): (5 - x) + (6 - z), ("b",): z}) for x in range(6) for z in range(3) if 0 <= (5 - x) + (6 - z) <= 8 and x <= 6),
    )
    used = Counter()
    for (p, _), n in flow.items():
        used[p] += n
    assert cost(used) == pytest.approx(best)
    assert sum(n for (_, q), n in flow.items() if q == "a") == pytest.approx(5) and sum(n for (_, q), n in flow.items() if q == "b") == pytest.approx(6)


def test_mixing_of_overlapping_sources(spark):
    rows = random_rows(8, n=100)
    members = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("x"), F.lit("y"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("y"))).otherwise(F.array(F.lit("z")))
    out = mixing.mix(frame(spark, rows), members, share=1.2).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in out) and sum(r.taken for r in out) > 0


def test_personal_data(spark):
    text = "mail bob.x@mail.example.com or +1 (743) 555-3824, card 4111 1111 1111 1111\nhost 10.0.0.255 not 300.1.1.1 é token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" in 2019, 1234567890123456"
    rows = [(1, text, "s"), (1, text, "s"), (2, None, "s"), (3, "", "s"), (4, "the clean 12 words of 1999, page 3.", "s"), (None, "a@b.c", "s")]
    found = pii.find(frame(spark, rows)).cache()
    own = {r.doc_id: [(s.kind, text[s.start : s.end], s.by_pattern) for s in r.pii] for r in found.collect()}
    base = {("email", "bob.x@mail.example.com", True), ("ip", "10.0.0.255", True), ("card", "4111 1111 1111 1111", True), ("phone", "+1 (743) 555-3824", True)}
    assert base <= set(own[1]) and ("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", False) in own[1] and len(own[1]) == 5
    assert own[2] == own[3] == own[4] == []
    redacted = {r.doc_id: r.text for r in pii.redact(found).collect()}
    assert redacted[1] == 'mail <EMAIL> or <PHONE>, card <CARD>\nhost <IP> not 300.1.1.1 é token = "<SECRET>" in 2019, 1234567890123456'
    assert redacted[2] is None and redacted[None] == "<EMAIL>"
    assert pii.find(frame(spark, [])).count() == 0


def test_decoding_is_exhaustive_search():
    rng = np.random.default_rng(0)
    model = pii.default_model()
    lengths = [1, 4, 3, 5]
    shape = rng.choice(np.unique(np.concatenate([pii.shapes_of(pii.W.split(pa.array([" ".join(w for w, _ in row)]))) for row in pii.labelled()[::20]])), sum(lengths))
    starts = np.cumsum([0, *lengths[:-1]])
    got = pii.decode(shape, starts, model)
    import itertools

    for s, n in zip(starts, lengths, strict=True):
        own = [pii.SHAPES, *shape[s : s + n], pii.SHAPES]
        emit = [model[0][0][own[t]] + model[0][1][own[t + 1]] + model[0][2][own[t + 2]] for t in range(n)]
        value = lambda y: sum(emit[t][y[t]] for t in range(n)) + sum(model[1][a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: E731, B023
        assert value(tuple(got[s : s + n])) == pytest.approx(max(map(value, itertools.product(range(6), repeat=n))), rel=1e-5)


def test_field_labels_held_out_lines():
    line = lambda *words: pa.array([" ".join(words)])
    kinds = lambda *words: [pii.LABELS[i] for i in pii.decode(pii.shapes_of(pii.W.split(line(*words))), np.array([0]), pii.default_model())]
    assert kinds("call", "(212)", "555-0199", "now") == ["", "phone", "phone", ""]
    assert kinds("in", "1999", "the", "and", "of", "12", "men") == [""] * 7


def test_queries_return_their_columns(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    for name, query in queries.QUERIES.items():
        rows = query(spark, d)
        of = spark.read.parquet(f"{d}/embeddings.parquet").count() if name.startswith("op13") else n
        assert name.startswith(("op9", "op2_")) or rows.count() == of, name
    r = queries.op5_token_files(spark, d).orderBy("start").first()
    assert r.start == 0 and r.n_tokens > 0
    media = queries.op8_media_columns(spark, d).orderBy("doc_id").first()
    text = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").first().text.encode()
    payload = text + b" " * (-len(text) % 192 if text else 192)
    assert (media.payload_bytes, media.payload_sha256, media.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))

"""Merkle manifest against trees built level by level on all rows of a table, and on random small ones."""

import hashlib
import random
import zlib
from collections import defaultdict

from phonolith.llm import merkle, queries


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """The root, and for each leaf (place, siblings) by level."""
    level, members, paths = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(level) > 1:
        up, joined = [], []
        for a in range(0, len(level), 3):
            run = level[a : a + 3]
            for k, own in enumerate(members[a : a + 3]):
                for i in own:
                    paths[i].append((k, run[:k] + run[k + 1 :]))
            up.append(sha(*run))
            joined.append(sum(members[a : a + 3], []))
        level, members = up, joined
    return level[0], paths


def plain_manifest(rows, altered):
    """rows: (id, group, values, altered values)."""
    groups = defaultdict(list)
    for i, g, values, other in rows:
        groups[g].append((i is not None, i or 0, plain_leaf(values), plain_leaf(other), i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: r[:3])
        trees[g] = plain_tree([r[2] for r in groups[g]])
    if not order:
        return []
    root, tops = plain_tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            value, path = r[3], path + top
            for k, others in path:
                value = sha(*others[:k], value, *others[k:])
            out.append((r[4], r[2], trees[g][0], root, sha(*(d for _, o in path for d in o)), value))
    return sorted(out, key=repr)


def test_all_rows_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    odd = lambda r: zlib.crc32(str(r.doc_id).encode()) % 2 == 0
    text = lambda r: r.text.replace("\n", "") if odd(r) and r.text is not None else r.text
    rows = [(r.doc_id, r.source, (r.doc_id, r.source, r.lang, r.n_chars, r.text), (r.doc_id, r.source, r.lang, r.n_chars, text(r))) for r in docs]
    got = queries.op12_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(r[:6]) for r in got), key=repr) == plain_manifest(rows, None)
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    assert {r.doc_id for r in got if not r.verified} == {r.doc_id for r in docs if text(r) != r.text}


def manifest(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, leaf int").repartition(3)
    got = merkle.manifest(df, "source", "doc_id", ["doc_id", "source", "text"], {"text": df["text"].substr(1, 1)}, **how).collect()
    want = plain_manifest([(i, s, (i, s, t), (i, s, None if t is None else t[:1])) for i, s, t, _ in rows], None)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_many_rounds_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(60)]), rng.choice(["a", "b", "hot", "hot", "hot", None, "", "é", "Z"]), rng.choice(["x", "", None, "long " * 50]), k) for k in range(300)]
    rows += rows[:20]
    rows += [(k, f"own{k}", "t", 0) for k in range(40)]
    manifest(spark, rows, run=4, joined=2)
    manifest(spark, rows)


def test_one_row_and_none(spark):
    manifest(spark, [(1, "a", "x", 1)])
    manifest(spark, [(1, None, None, None), (1, None, None, None)], run=1, joined=3)
    df = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert merkle.manifest(df, "source", "doc_id", ["text"]).collect() == []


def test_events_complete_parents_in_any_order():
    rng = random.Random(9)
    for size in (1, 2, 3, 4, 9, 10, 28, 100):
        leaves = [sha(str(k)) for k in range(size)]
        nodes = [((0, k), v) for k, v in enumerate(leaves)]
        rng.shuffle(nodes)
        nodes = dict(nodes)
        merkle.combine(nodes, size)
        assert nodes[merkle.levels(size), 0] == plain_tree(leaves)[0]

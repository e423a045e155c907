"""Merkle trees over groups of rows, and over the groups, with a proof for every row.

Trees are built from events. A task holds a run of nodes of a tree; every node that is known is an event for its parent,
which combines the indexed digests of its children by key. Once it has as many as its place and the tree's size say,
its own digest is known and is the next event. Parents that a task can't complete leave their children as its frontier. Frontiers
are dealt anew by wider and wider stretches of their tree until only roots are left, and proofs come back the same way:
a node's proof is its siblings and then its parent's proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolith.llm.store import written
from phonolith.operators.windows import numbered, numbered_within

ARITY = 3
#: Leaves of a stretch in the first round, and how many stretches each next round joins to one.
RUN, JOINED = 3**6, 3**5
_NODE = "tree string, size bigint, level int, idx bigint, digest string, origin string"
_COLUMNS = ["tree", "size", "level", "idx", "digest", "origin"]


def field(value: Column) -> Column:
    """A value in a leaf: ``-`` if null, else its length in UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row."""
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(size: int) -> int:
    """The level of the root of a tree of so many leaves."""
    top = 0
    while size > 1:
        size, top = -(-size // ARITY), top + 1
    return top


def at_level(size: int, level: int) -> int:
    """The number of nodes on a level."""
    return -(-size // ARITY**level)


def combine(nodes: dict[tuple[int, int], str], size: int) -> dict[tuple[int, int], list[str]]:
    """Run the events of some nodes, {(level, idx): digest}, of a tree: nodes that they complete are added, with their
    children's digests as the result."""
    top, partial, made, events = levels(size), {}, {}, list(nodes.items())
    while events:
        (level, idx), value = events.pop()
        if level == top:
            continue
        parent = (level + 1, idx // ARITY)
        held = partial.setdefault(parent, {})
        held[idx % ARITY] = value
        if len(held) == min(ARITY, at_level(size, level) - ARITY * parent[1]):
            made[parent] = [held[k] for k in range(len(held))]
            nodes[parent] = digest(made[parent])
            events.append((parent, nodes[parent]))
            del partial[parent]
    return made


def path_of(place: int, children: list[str]) -> str:
    """A step of a proof: the place among the children and the siblings, from left to right."""
    return ":".join([str(place), *children[:place], *children[place + 1 :]])


def fold(value: str, path: list[str]) -> str:
    """The root that a digest and the steps of its proof lead to."""
    for step in path:
        place, *others = step.split(":")
        others.insert(int(place), value)
        value = digest(others)
    return value


def siblings(path: list[str]) -> str:
    """The digest of all siblings of a proof."""
    return digest([d for step in path for d in step.split(":")[1:]])


def _frontier(table: pa.Table) -> pa.Table:
    """One task's nodes of one key: what is left of them once all that can be is combined."""
    out = {c: [] for c in _COLUMNS}
    key = table.column("key")[0].as_py()
    for (tree, size), nodes in _by_tree(table).items():
        made = combine(nodes, size)
        inside = {(level - 1, ARITY * idx + k) for (level, idx), own in made.items() for k in range(len(own))}
        for (level, idx), value in nodes.items():
            if (level, idx) not in inside:
                for c, v in zip(_COLUMNS, (tree, size, level, idx, value, key), strict=True):
                    out[c].append(v)
    return pa.table([pa.array(out[c], t) for c, t in zip(_COLUMNS, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)], _COLUMNS)


def _by_tree(table: pa.Table) -> dict[tuple[str, int], dict[tuple[int, int], str]]:
    out: dict[tuple[str, int], dict[tuple[int, int], str]] = {}
    for tree, size, level, idx, value in zip(*(table.column(c).to_pylist() for c in _COLUMNS[:5]), strict=True):
        out.setdefault((tree, size), {})[level, idx] = value
    return out


def _climbs(nodes: pa.Table, known: pa.Table) -> Iterator[tuple[str, str, list[str]]]:
    """For each of one task's nodes of one key, from what is known of its frontier: the key above, the tree's root and the steps of
    the node's proof."""
    given = {(t, lv, i): (r, p.split(",") if p else []) for t, lv, i, r, p in zip(*(known.column(c).to_pylist() for c in ("tree", "level", "idx", "root", "path")), strict=True)}
    up: dict[tuple, tuple] = {}  # each child's parent and its step
    for (tree, size), own in _by_tree(nodes).items():
        for (level, idx), children in combine(own, size).items():
            for k in range(len(children)):
                up[tree, level - 1, ARITY * idx + k] = ((tree, level, idx), path_of(k, children))
    for tree, level, idx, origin in zip(*(nodes.column(c).to_pylist() for c in ("tree", "level", "idx", "origin")), strict=True):
        at, path = (tree, level, idx), []
        while at in up:
            at, step = up[at]
            path.append(step)
        root, rest = given[at]
        yield origin, root, path + rest


_KNOWN = "tree string, level int, idx bigint, root string, path string, origin string"


def _down(nodes: pa.Table, known: pa.Table) -> pa.Table:
    origin, root, path = zip(*((o, r, ",".join(p)) for o, r, p in _climbs(nodes, known)), strict=True)
    own = nodes.select(["tree", "level", "idx"])
    for name, values in (("root", root), ("path", path), ("origin", origin)):
        own = own.append_column(name, pa.array(values, pa.string()))
    return own


def _prove(nodes: pa.Table, known: pa.Table) -> pa.Table:
    """The leaves of one key with the digest of their siblings, and the root that the altered leaf leads to."""
    found = [(r, siblings(p), fold(a, p)) for (_, r, p), a in zip(_climbs(nodes, known), nodes.column("altered").to_pylist(), strict=True)]
    for name, values in zip(("subroot", "proof", "folded_root"), zip(*found, strict=True), strict=True):
        nodes = nodes.append_column(name, pa.array(values, pa.string()))
    return nodes.drop_columns(["key", "size", "level", "origin"])


def _trace(nodes: pa.Table, known: pa.Table) -> pa.Table:
    """The leaves of one key with the steps of their proofs."""
    return nodes.append_column("path", pa.array([",".join(p) for _, _, p in _climbs(nodes, known)], pa.string())).drop_columns(["key", "size", "level", "origin"])


def climb(leaves: DataFrame, name: str, run: int = RUN, joined: int = JOINED) -> list[DataFrame]:
    """Rounds of nodes of the trees whose ``leaves`` (tree, size, idx, digest, any others) are given, the last one their roots.

    size is the tree's number of leaves, idx a leaf's place from 0. A key of the first round has a stretch of ``run`` leaves,
    one of each next round ``joined`` stretches: there are few rounds at any size, and no task sees a whole large tree.
    """
    # a node's stretch is that of the leaf it starts with
    stretch = lambda width: F.concat_ws("|", F.lit(str(width)), F.floor(F.col("idx") * F.pow(F.lit(ARITY), F.col("level")).cast("bigint") / width).cast("string"), F.col("tree"))
    largest, width = leaves.agg(F.max("size")).first()[0] or 1, run
    rounds = [written(leaves.withColumns({"level": F.lit(0), "origin": F.lit("")}).withColumn("key", stretch(width)), f"{name}-leaves")]
    while True:
        left = rounds[-1].select("key", *_COLUMNS).groupBy("key").applyInArrow(_frontier, _NODE)
        if width >= largest:
            return [*rounds, written(left, f"{name}-roots")]
        width *= joined
        rounds.append(written(left.withColumn("key", stretch(width)), f"{name}-frontier"))


def descend(rounds: list[DataFrame], above: DataFrame, each: Callable[[pa.Table, pa.Table], pa.Table], added: str) -> DataFrame:
    """The leaves of ``climb()`` with the columns ``added`` of ``_prove()`` or ``_trace()``. above: tree and the path (steps of a
    proof, comma-joined) from its root on."""
    known = rounds[-1].join(above, "tree").select("tree", "level", "idx", F.col("digest").alias("root"), "path", "origin")
    for nodes in rounds[-2:0:-1]:
        known = written(nodes.groupBy("key").cogroup(known.groupBy("origin")).applyInArrow(_down, _KNOWN), "merkle-known")
    first = rounds[0]
    kept = [f for f in first.schema if f.name not in ("key", "size", "level", "origin")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), added])
    return first.groupBy("key").cogroup(known.groupBy("origin")).applyInArrow(each, schema)


def manifest(rows: DataFrame, group: str, order: str, content: list[str], altered: dict[str, Column] | None = None, run: int = RUN, joined: int = JOINED) -> DataFrame:
    """``order, leaf, subroot, root, proof, folded_root`` of every row.

    A leaf is the digest of the columns ``content``. Leaves are put in the order of ``order`` in a tree for each value of
    ``group``, ties and nulls (first) by their digests, and the trees' roots, in the order of the groups (null first, UTF-8
    bytewise), in one more. proof is the digest of the siblings on the way up, folded_root what the same way leads to from the row with
    the columns ``altered``. Repeated rows are leaves of their own. An empty table gives an empty result. Columns not in
    ``content`` aren't read.
    """
    changed = {c: F.col(c) for c in content} | (altered or {})
    leaves = rows.select(F.col(group).cast("string").alias("_group"), F.col(order).alias("_order"), leaf(*(F.col(c) for c in content)).alias("digest"), leaf(*changed.values()).alias("altered"))
    placed = numbered_within(leaves, ["_group"], ["_order", "digest"], "idx", "size")
    tree = F.coalesce(F.concat(F.lit("="), F.col("_group")), F.lit("-"))
    rounds = climb(placed.select(tree.alias("tree"), "size", "idx", "digest", "altered", "_order"), "merkle", run, joined)
    # trees' names sort as their groups do: "-" before "="
    tops = numbered(rounds[-1].select(F.col("tree").alias("name"), "digest"), "idx", "size", "name")
    top_rounds = climb(tops.select(F.lit("").alias("tree"), "size", "idx", "digest", "name"), "merkle-top", run, joined)
    whole = top_rounds[-1].select("digest").first()
    # the steps from each tree's root on
    above = descend(top_rounds, top_rounds[-1].select("tree", F.lit("").alias("path")), _trace, "path string")
    proven = descend(rounds, above.select(F.col("name").alias("tree"), "path"), _prove, "subroot string, proof string, folded_root string")
    return proven.select(F.col("_order").alias(order), F.col("digest").alias("leaf"), "subroot", F.lit(whole.digest if whole else None).cast("string").alias("root"), "proof", "folded_root")

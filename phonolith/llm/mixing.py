"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document counts for). Each pattern sends its
words to the sources it belongs to; the first use of a word costs nothing, each further one its number of earlier uses
(a convex cost), so the flow repeats as little as the targets allow. The driver gets one sum for each pattern and solves
the flow, one connected part of the network at a time: patterns that share no source with others need no search. Then
every pattern takes its flow from documents in a seeded order, of which only one in about a million is sorted.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonolith.llm.store import written

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, 17
_BUCKETS = 1024  # of each of two levels


def n_words(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def capped_targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Targets by source: ``share`` of all sizes by weight (repeating over the sources in code point order, null last),
    none above ``most`` times its source's size; what is above is shared again by weight among the others."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    size, total = dict(ordered), share * sum(n for _, n in ordered)
    full: set = set()
    while True:
        free = [s for s in size if s not in full]
        left = total - most * sum(size[s] for s in full)
        unit = left / sum(weight[s] for s in free) if free else 0.0
        over = [s for s in free if weight[s] * unit > most * size[s]]
        if not over:
            return {s: float(most * size[s]) if s in full else weight[s] * unit for s in size}
        full.update(over)


def min_cost_flow(supply: dict, members: dict, demand: dict, most: int = MOST) -> dict:
    """Words that each pattern sends to each source, {(pattern, source): words}, by successive shortest paths.

    supply: words of a pattern; members: its sources; demand: words wanted by a source. A pattern can be used up to
    ``most`` times; its n-th use costs n - 1 a word. As much of the demand is met as the patterns allow, at least cost.
    """
    names = ["s", "t", *(("p", p) for p in supply), *(("q", q) for q in demand)]
    number = {x: i for i, x in enumerate(names)}
    graph: list[list[int]] = [[] for _ in names]
    arcs: list[list] = []  # to, room, cost

    def arc(a, b, room: float, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0.0, -cost)):
            graph[number[x]].append(len(arcs))
            arcs.append([number[y], r, c])
        return len(arcs) - 2

    kept = {}
    for p, n in supply.items():
        for use in range(most):
            arc("s", ("p", p), float(n), use)
        for q in members[p]:
            if q in demand:
                kept[p, q] = arc(("p", p), ("q", q), float("inf"), 0)
    for q, n in demand.items():
        arc(("q", q), "t", float(n), 0)
    potential = [0] * len(names)
    tiny = 1e-9 * max([1.0, *map(float, supply.values())])
    while True:
        distance, into = [float("inf")] * len(names), [-1] * len(names)
        distance[0], heap = 0, [(0, 0)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > distance[x]:
                continue
            for i in graph[x]:
                y, room, cost = arcs[i]
                if room > tiny and (e := d + cost + potential[x] - potential[y]) < distance[y]:
                    distance[y], into[y] = e, i
                    heapq.heappush(heap, (e, y))
        if distance[1] == float("inf"):
            break
        potential = [p + (d if d < float("inf") else distance[1]) for p, d in zip(potential, distance, strict=True)]
        path, x = [], 1
        while x:
            path.append(into[x])
            x = arcs[into[x] ^ 1][0]
        sent = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= sent
            arcs[i ^ 1][1] += sent
    return {k: arcs[i ^ 1][1] for k, i in kept.items() if arcs[i ^ 1][1] > tiny}


def flow_by_parts(supply: dict, members: dict, demand: dict, most: int = MOST) -> dict:
    """``min_cost_flow()`` of each connected part of the network on its own."""
    root = {s: s for own in members.values() for s in own}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for own in members.values():
        for s in own[1:]:
            root[find(s)] = find(own[0])
    parts: dict = {}
    for p, own in members.items():
        if own:
            parts.setdefault(find(own[0]), []).append(p)
    out: dict = {}
    for patterns in parts.values():
        wanted = {q: demand[q] for p in patterns for q in members[p]}
        out |= min_cost_flow({p: supply[p] for p in patterns}, {p: members[p] for p in patterns}, wanted, most)
    return out


def _edge(sums: DataFrame, plan: DataFrame, level: str) -> DataFrame:
    """plan with the bucket in which ``rest`` runs out, and what of it is left there. sums: members, bucket, n."""
    order = Window.partitionBy("members").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = sums.withColumn("after", F.sum("n").over(order))  # a pattern has at most _BUCKETS rows
    found = after.join(plan.select("members", "rest"), "members").where("after > rest")
    edge = found.groupBy("members").agg(F.min("bucket").alias(level), F.min_by(F.col("rest") - F.col("after") + F.col("n"), "bucket").alias("left"))
    # without an edge all that the pattern has is taken
    return plan.join(edge, "members", "left").withColumns({level: F.coalesce(level, F.lit(_BUCKETS)), "rest": F.coalesce("left", "rest")}).drop("left")


def mix(documents: DataFrame, members: Column | None = None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, targets: Callable = capped_targets, carried: Sequence[str] = ()) -> DataFrame:
    """How much of each document the mix takes: ``doc_id, source, size, source_size, target, taken``.

    members: array of the sources a document counts for (default: its ``source``; null is a source of its own). size is
    its words, taken the words that the mix takes of it, between 0 and ``most`` times its size: whole uses, and for the
    last document of a pattern a part of one, so that the pattern's flow is met. Documents come in the order of a
    seeded hash of their id. source_size and target are those of the document's first source (in code point order).

    Null and empty texts have size 0 and are never taken. Rows without an id are ordered by a hash of their text alone;
    repeated rows are documents of their own. Columns named in ``carried`` are in a struct ``row``, others are not read.
    """
    row = [F.struct(*carried).alias("row")] if carried else []
    key = F.array("source") if members is None else F.coalesce(F.array_sort(F.array_distinct(members)), F.array().cast("array<string>"))
    docs = documents.select("doc_id", key.alias("members"), n_words().alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")).alias("h"), *row)
    docs = docs.withColumn("members", F.transform("members", lambda x: F.coalesce(F.concat(F.lit("s"), x), F.lit("n"))))
    docs = written(docs.withColumns({"b1": F.pmod("h", F.lit(_BUCKETS)).cast("int"), "b2": F.pmod(F.shiftright("h", 10), F.lit(_BUCKETS)).cast("int")}), "sizes")
    supply = {tuple(x[1:] if x[0] == "s" else None for x in r.members): r.n for r in docs.groupBy("members").agg(F.sum("size").alias("n")).collect()}
    size: dict = {}
    for p, n in supply.items():
        for s in p:
            size[s] = size.get(s, 0) + n
    goal = targets(list(size.items()), weights, share, most)
    total: dict = {}
    for (p, _), n in flow_by_parts(supply, {p: list(p) for p in supply}, goal, most).items():
        total[p] = total.get(p, 0.0) + n
    rows = []
    for p, n in supply.items():
        whole, rest = divmod(round(total.get(p, 0.0)), n) if n else (0, 0)
        first = min(p, key=lambda s: (s is None, s or "")) if p else None
        rows.append((["n" if s is None else f"s{s}" for s in p], first, size.get(first, 0), float(goal.get(first, 0.0)), int(whole), int(rest)))
    plan = docs.sparkSession.createDataFrame(rows, "members array<string>, source string, source_size bigint, target double, uses int, rest bigint")
    # the plan has a row for each pattern; whether it is broadcast is for the planner, by its size
    plan = _edge(docs.groupBy("members", F.col("b1").alias("bucket")).agg(F.sum("size").alias("n")), plan, "edge1")
    plan = written(plan, "plan")
    inner = docs.join(plan.select("members", "edge1"), "members").where("b1 = edge1").groupBy("members", F.col("b2").alias("bucket")).agg(F.sum("size").alias("n"))
    plan = written(_edge(inner, plan, "edge2"), "plan")
    placed = docs.join(plan, "members").withColumn("size_used", F.col("size") * F.col("uses"))
    columns = ["doc_id", "source", "size", "source_size", "target", *(["row"] if carried else [])]
    before = (F.col("b1") < F.col("edge1")) | ((F.col("b1") == F.col("edge1")) & (F.col("b2") < F.col("edge2")))
    edge = (F.col("b1") == F.col("edge1")) & (F.col("b2") == F.col("edge2"))
    other = placed.where(~edge).select(*columns, (F.col("size_used") + F.when(before, F.col("size")).otherwise(0)).alias("taken"))
    order = Window.partitionBy("members").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = placed.where(edge).withColumn("after", F.sum("size").over(order))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("after") + F.col("size")))
    return other.unionByName(at.select(*columns, (F.col("size_used") + part).alias("taken")))

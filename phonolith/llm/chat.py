"""Tool calls of conversations: linked to their results, put in order, checked against schemas and written as JSON.

Only DataFrame and SQL functions are used. A call is one row; no conversation is gathered in one place, so one that
holds a third of all calls is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonolith.llm.store import forget, written

_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:variant>>>"
_RESULT = "struct<tool_call_id:string,content:string>"
#: JSON types that a schema can ask for, and the names that variants give them
_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in messages ``conv_id, turn, role, text``, as ``link()`` takes them.

    A call is an entry of ``{"tool_calls": [{"id", "name", "arguments"}]}`` in an assistant's text, a result a tool's
    ``{"tool_call_id", "content"}``. Other texts, nulls and broken JSON have neither; repeated rows give repeated calls.
    """
    calls = messages.where("role = 'assistant'").select("conv_id", "turn", F.explode(F.from_json("text", _CALLS)["tool_calls"]).alias("c"))
    results = messages.where("role = 'tool'").select("conv_id", "turn", F.from_json("text", _RESULT).alias("r")).where("r.tool_call_id is not null")
    return (
        calls.select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.to_json("c.arguments").alias("arguments")),
        results.select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content")),
    )


# a reference in canonical JSON: a key follows a brace or comma, and quotes inside strings are escaped
_REFERENCE = r'[{,]"\$ref":"((?:[^"\\]|\\.)*+)"'


def _references(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, parent``: the ids that arguments refer to, at any depth, read from their canonical JSON."""
    found = F.regexp_extract_all(F.to_json(F.try_parse_json("arguments")), F.lit(_REFERENCE))
    plain = F.transform(found, lambda x: F.from_json(F.concat(F.lit('{"id":"'), x, F.lit('"}')), "id string")["id"])
    return calls.select("conv_id", "call_id", F.explode(F.array_distinct(plain)).alias("parent"))


def _chains(refs: DataFrame) -> DataFrame:
    """``conv_id, call_id, up, back`` of calls that refer to one other call: where the chain of such calls ends, and how
    many references away. Pointers double, so a chain of n calls takes log n rounds; chains into a cycle are left out."""
    keys = ["conv_id", "call_id"]
    state = refs.groupBy(*keys).agg(F.count("*").alias("n"), F.min("parent").alias("up")).where("n = 1")
    state = written(state.select(*keys, "up", F.lit(1).cast("bigint").alias("back"), F.lit(False).alias("done")), "chains")
    for _ in range(state.count().bit_length() + 1):
        if state.where("not done").isEmpty():
            break
        hop = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("back").alias("more"), F.col("done").alias("end"))
        met = state.where("not done").join(hop, ["conv_id", "up"], "left")
        met = met.select(*keys, F.coalesce("next", "up").alias("up"), (F.col("back") + F.coalesce("more", F.lit(0))).alias("back"), F.coalesce("end", F.lit(True)).alias("done"))
        before, state = state, written(state.where("done").unionByName(met), "chains")
        forget(before)
    return state.where("done").drop("done")


def _levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level``: 0 without references, else one more than the highest level referred to.

    Chains of single references are followed by pointer doubling; one round of joins follows for each level of calls
    that refer to several others. Calls in a cycle, and those that depend on one, get none.
    """
    keys = ["conv_id", "call_id"]
    known = calls.select("conv_id", F.col("call_id").alias("parent"))
    refs = written(_references(calls).join(known, ["conv_id", "parent"]), "references")
    chains = _chains(refs)
    several = refs.join(refs.groupBy(*keys).agg(F.count("*").alias("open")).where("open > 1"), keys)
    single = refs.groupBy(*keys).agg(F.count("*").alias("n")).where("n = 1").select("conv_id", F.col("call_id").alias("parent"), F.lit(True).alias("single"))
    over = chains.select("conv_id", F.col("call_id").alias("parent"), "up", "back")
    # what a call of several references waits for: where each chain ends; nothing ends in a cycle
    edges = several.join(single, ["conv_id", "parent"], "left").join(over, ["conv_id", "parent"], "left")
    edges = edges.select(*keys, "open", F.coalesce("up", F.when(F.col("single").isNull(), F.col("parent"))).alias("up"), F.coalesce("back", F.lit(0)).alias("back"))
    edges = written(edges, "waits")
    waiting = written(edges.groupBy(*keys).agg(F.first("open").alias("open"), F.lit(0).cast("bigint").alias("level")), "waiting")
    done = [written(known.withColumnRenamed("parent", "call_id").join(refs, keys, "left_anti").select(*keys, F.lit(0).cast("bigint").alias("level")), "level")]
    while not waiting.isEmpty() and not done[-1].isEmpty():
        newest = done[-1].select("conv_id", F.col("call_id").alias("up"), F.col("level").alias("below"))
        met = edges.join(newest, ["conv_id", "up"]).groupBy(*keys).agg(F.count("*").alias("met"), F.max(F.col("below") + F.col("back") + 1).alias("least"))
        left = waiting.join(met, keys, "left").select(*keys, (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"), F.greatest("level", "least").alias("level"))
        before, left = waiting, written(left, "waiting")
        done.append(written(left.where("open = 0").select(*keys, "level"), "level"))
        waiting = written(left.where("open > 0"), "waiting")
        forget(before)
        forget(left)
    ends = done[0]
    for x in done[1:]:
        ends = ends.unionByName(x)
    own = chains.join(ends.withColumnRenamed("call_id", "up"), ["conv_id", "up"]).select(*keys, (F.col("level") + F.col("back")).alias("level"))
    return written(ends.unionByName(own).withColumn("level", F.col("level").cast("int")), "levels")


def _errors() -> F.Column:
    """What is wrong with the arguments, by the schema's parameters in ``parameters``; a call without a schema is unknown."""
    held = F.from_json("arguments", "map<string,variant>")

    def fault(p):
        own = F.regexp_extract(F.schema_of_variant(F.element_at(F.col("held"), p["parameter"])), "^[A-Z]+", 0)
        fits = F.lit(False)
        for kind, names in _TYPES.items():
            fits = fits | ((p["type"] == kind) & own.isin(*names))
        there = F.array_contains(F.map_keys("held"), p["parameter"])
        return F.when(~there & p["required"], F.concat(F.lit("missing "), p["parameter"])).when(there & ~F.coalesce(fits, F.lit(False)), F.concat(F.lit("not "), p["type"], F.lit(" "), p["parameter"]))

    names = F.transform("parameters", lambda p: p["parameter"])
    more = F.transform(F.array_sort(F.array_except(F.map_keys("held"), names)), lambda k: F.concat(F.lit("unknown "), k))
    found = F.concat(F.filter(F.transform("parameters", fault), lambda e: e.isNotNull()), more)
    return held, F.when(F.col("parameters").isNull(), F.array(F.lit("no schema"))).when(F.col("held").isNull(), F.array(F.lit("no JSON object"))).otherwise(found)


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call or unclaimed result: ``conv_id, call_id, turn, level, status, errors, canonical``.

    calls: conv_id, turn, call_id, name, arguments (JSON); results: conv_id, turn, call_id, content; schemas: name,
    parameter, type, required. ``{"$ref": "<call id>"}`` in arguments refers to a call of the same conversation; sorted
    by level and turn, every call follows what it refers to. status is ``ok``, ``invalid`` (see errors), ``no result``,
    ``cycle`` (level null) or ``no call``. canonical is JSON without blanks, keys in code point order.

    Of calls (results) that share an id, the one of the smallest turn counts, then of the smallest content. Rows
    without a conversation or call id are left out; null arguments are no JSON. Other columns are not read.
    """
    return link_all(calls, results, schemas).where("n = 1").drop("n")


def link_all(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """``link()`` with ``n``, and a row for every further call or result of an id.

    The n-th call of an id belongs to its n-th result, in the order of turn and content. From n = 2 on status is
    ``repeated id`` and level null: references are to the first call of an id.
    """
    keys = ["conv_id", "call_id"]
    numbered = lambda df, *c: df.where("conv_id is not null and call_id is not null").select(*keys, "turn", *c).withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("turn", *c)))
    calls = written(numbered(calls, "name", "arguments"), "calls")
    results = numbered(results, "content").withColumnRenamed("turn", "result_turn")
    forms = schemas.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("parameter", "type", "required"))).alias("parameters"))
    linked = calls.withColumn("called", F.lit(True)).join(results.hint("shuffle_hash"), [*keys, "n"], "full_outer").join(forms, "name", "left")
    linked = linked.join(_levels(calls.where("n = 1")).withColumn("n", F.lit(1)), [*keys, "n"], "left")
    held, errors = _errors()
    linked = linked.withColumn("held", held).withColumn("errors", F.when(F.col("called"), errors).otherwise(F.array().cast("array<string>")))
    status = F.when(F.col("n") > 1, "repeated id").when(F.col("called").isNull(), "no call").when(F.col("level").isNull(), "cycle").when(F.size("errors") > 0, "invalid").when(F.col("result_turn").isNull(), "no result").otherwise("ok")
    record = F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "level", "name", F.col("content").alias("result"))
    return linked.select(*keys, "n", F.coalesce("turn", "result_turn").alias("turn"), "level", status.alias("status"), "errors", F.to_json(record).alias("canonical"))


def calls_of_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every user turn as a call of ``reply`` and the assistant's next turn as its result; some calls are faulty.

    A call's arguments are the length of its text (size), its number and text, and, if turn // 2 is another user turn, a
    reference to that call as its context; turns of 0 and below have none. By the size, calls have faults that linking
    has to find: an unknown name (size % 11 = 3), a reference to itself (17: 4), a number that is a string (7: 2), no text
    (13: 5), one parameter more (5: 1), or the id of turn 0 (23: 6); by its own size, a result
    has an id that no call has (29: 8). Ids of turns with turn % 4 = 2 hold quotes and a
    backslash. Null texts count as empty; rows without a conversation or turn have no id and are left out by ``link()``;
    a turn that is there twice gives two calls of one id.
    """
    size, turn = F.length("text"), F.col("turn")
    plain = lambda t: F.concat_ws(":", F.col("conv_id"), F.when(F.pmod(t, F.lit(4)) == 2, F.concat(F.lit('"'), t, F.lit('"\\'))).otherwise(t.cast("string")))
    name = lambda t, n: F.when(t.isNotNull() & F.col("conv_id").isNotNull(), plain(F.when(F.pmod(n, F.lit(23)) == 6, F.lit(0).cast("bigint")).otherwise(t)))
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    users = rows.where("role = 'user'")
    earlier = users.groupBy("conv_id", F.col("turn").alias("half")).agg(F.min(F.length("text")).alias("half_size"))
    users = users.withColumn("half", F.when(turn > 0, F.floor(turn / 2))).join(earlier, ["conv_id", "half"], "left")
    own = name(turn, size)
    context = F.when(F.pmod(size, F.lit(17)) == 4, own).when(F.col("half_size").isNotNull(), name(F.col("half"), F.col("half_size")))
    number = F.when(F.pmod(size, F.lit(7)) == 2, F.to_json(F.struct(turn.cast("string").alias("number")))).otherwise(F.to_json(F.struct(turn.alias("number"))))
    parts = [F.to_json(F.struct(F.struct(context.alias("$ref")).alias("context"))), F.when(F.pmod(size, F.lit(5)) == 1, '{"note":true}'), number, F.to_json(F.struct(size.alias("size")))]
    parts = [F.when(context.isNotNull(), parts[0]), *parts[1:], F.when(F.pmod(size, F.lit(13)) != 5, F.to_json(F.struct("text")))]
    inner = [F.substring(p, F.lit(2), F.length(p) - 2) for p in parts]
    arguments = F.concat(F.lit("{"), F.concat_ws(",", *inner), F.lit("}"))
    calls = users.select("conv_id", "turn", own.alias("call_id"), F.when(F.pmod(size, F.lit(11)) == 3, "answer").otherwise("reply").alias("name"), arguments.alias("arguments"))
    asked = earlier.select("conv_id", (F.col("half") + 1).alias("turn"), F.col("half_size").alias("asked_size"))
    results = rows.where("role = 'assistant'").join(asked, ["conv_id", "turn"], "left")
    answered = F.concat(name(turn - 1, F.coalesce("asked_size", F.lit(0))), F.when(F.pmod(size, F.lit(29)) == 8, "?").otherwise(""))
    return calls, results.select("conv_id", "turn", answered.alias("call_id"), F.col("text").alias("content"))

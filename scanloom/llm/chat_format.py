"""Chat formatting: link tool calls with results, order them, validate, serialise.

Messages are rows (conversation, turn, role, text).  A text may be plain, or one
JSON object:

* role ``system``: ``{"content": ..., "tools": [{"name", "parameters"}]}``, where
  ``parameters`` is an object schema (``properties`` with ``type`` and ``enum``,
  ``required``, ``additionalProperties``);
* role ``assistant``: ``{"content": ..., "tool_calls": [{"id", "name",
  "arguments", "depends_on": [ids]}]}``; arguments are an object, or a string
  that holds one;
* role ``tool``: ``{"tool_call_id": ..., "content": ...}``.

Calls and results are hash-joined by conversation and identifier.  Calls are
ordered topologically: a call's level is one more than the greatest level of the
calls it depends on.
Rows carry their place as the columns (anchor_turn, level, call_index, kind_rank,
turn), so that no conversation is sorted in one task; ordering by conversation
and these columns gives every result after its call, and every call after the
results it depends on.  JSON is canonical: sorted keys, no white space, one row
for each message, call and result.

Schemas are read to the depth stated above: one level of properties, whose
``type`` is a name or a list of names.  Nested properties, items, bounds and
patterns are not checked.

Defined results: a null text is the empty string; a null turn comes first; null
roles are ``unknown``; text that isn't such an object is a plain message.  Of
calls that repeat an identifier in a conversation, the first is linked and the
others are ``duplicate``; of results the same; a result without call is
``orphan``, a call without result ``unanswered``, a call in a circle of
dependencies, or whose dependency is missing or comes in a later turn,
``unordered``; a call without identifier or without conversation is linked with
nothing and ``unnamed``.  Repeated rows are rows like others: calls that tie in
(turn, place) are all the first, with all their dependencies, and results that
tie in turn likewise; none of them multiplies another.  An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.llm.common import staged

_CALLS = "struct<content:string, tool_calls:array<struct<id:string, name:string, arguments:variant, depends_on:array<string>>>>"
_RESULT = "struct<tool_call_id:string, content:variant>"
_TOOLS = "struct<content:string, tools:array<struct<name:string, parameters:variant>>>"
_SCHEMA = "struct<properties:map<string,struct<type:string, enum:array<string>>>, required:array<string>, additionalProperties:boolean>"
#: Variant type names (their beginnings) that a schema type admits.
_ADMITS = {
    "string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL", "FLOAT"], "boolean": ["BOOLEAN"],
    "object": ["OBJECT"], "array": ["ARRAY"], "null": ["VOID"],
}
#: Calls of a run of turns, and of one turn beyond which a conversation is peeled.
RUN, WIDE = 1024, 64
#: A null turn's place.
_FIRST = -(1 << 63)


def _parsed(role: str, marker: str, schema: str) -> Column:
    """The text as an object where the role and a field name call for it, else null."""
    wanted = (F.col("role") == role) & F.col("text").startswith("{") & F.contains("text", F.lit(f'"{marker}"'))
    return F.when(wanted, F.from_json("text", schema))


def _errors(arguments: Column, schema: Column) -> Column:
    """What is wrong with an argument map under an object schema, in sorted order."""
    missing = F.transform(F.filter(F.coalesce(schema["required"], F.array().cast("array<string>")), lambda r: ~F.map_contains_key(arguments, r)), lambda r: F.concat(F.lit("missing:"), r))
    props = F.coalesce(schema["properties"], F.create_map().cast("map<string,struct<type:string,enum:array<string>>>"))

    def wrong(entry: Column) -> Column:
        kind, have = props[entry["key"]]["type"], F.schema_of_variant(entry["value"])
        named, fits = F.lit(False), F.lit(False)
        for name, begins in _ADMITS.items():
            some = F.lit(False)
            for b in begins:
                some = some | have.startswith(b)
            asked = (kind == name) | F.contains(kind, F.lit(f'"{name}"'))  # one name, or a list of them
            named, fits = named | asked, fits | (asked & some)
        fits = F.coalesce(fits | ~named, F.lit(True))
        allowed = props[entry["key"]]["enum"]
        listed = allowed.isNull() | F.array_contains(allowed, F.regexp_replace(F.to_json(entry["value"]), '^"|"$', ""))
        return F.map_contains_key(props, entry["key"]) & ~(fits & listed)

    entries = F.map_entries(arguments)
    mistyped = F.transform(F.filter(entries, wrong), lambda e: F.concat(F.lit("invalid:"), e["key"]))
    extra = F.transform(F.filter(entries, lambda e: (F.coalesce(schema["additionalProperties"], F.lit(True)) == F.lit(False)) & ~F.map_contains_key(props, e["key"])), lambda e: F.concat(F.lit("unexpected:"), e["key"]))
    return F.array_sort(F.concat(missing, mistyped, extra))


def _levels(calls: DataFrame) -> DataFrame:
    """conv, id, level of every linked call that can be ordered, one row each.

    Conversations are cut into runs of turns of some ``RUN`` calls.  The runs of one
    number are ordered together, each as one row, from the levels of the runs
    before; so there are as many rounds as the longest conversation has runs, and
    a row is bounded.  Conversations with more than ``WIDE`` calls in one turn are
    peeled instead.
    """
    first = calls.where("first")
    heads = first.groupBy("conv", "id").agg(F.min(F.struct("turn")).alias("at")).select("conv", "id", F.coalesce("at.turn", F.lit(_FIRST)).alias("t"))
    needs = staged(first.select("conv", "id", F.coalesce("turn", F.lit(_FIRST)).alias("t"), F.explode("depends_on").alias("need")).distinct(), even=True)
    if needs.isEmpty():
        return heads.select("conv", "id", F.lit(0).alias("level"))
    known = needs.join(heads.select("conv", F.col("id").alias("need"), F.col("t").alias("need_t")), ["conv", "need"], "left")
    dead = known.where(F.col("need_t").isNull() | (F.col("need_t") > F.col("t"))).select("conv", "id")
    deps = needs.groupBy("conv", "id").agg(F.collect_list("need").alias("needs"))
    alive = heads.join(dead, ["conv", "id"], "left_anti").join(deps, ["conv", "id"], "left").withColumn("needs", F.coalesce("needs", F.array().cast("array<string>")))
    turns = heads.groupBy("conv", "t").agg(F.count(F.lit(1)).alias("width"))
    turns = turns.withColumn("run", F.floor((F.sum("width").over(Window.partitionBy("conv").orderBy("t")) - F.col("width")) / RUN))
    widest = turns.groupBy("conv").agg(F.max("width").alias("widest"))
    alive = staged(alive.join(turns, ["conv", "t"]).join(widest, "conv"), even=True)
    last = alive.where(F.col("widest") <= WIDE).agg(F.max("run")).first()[0]
    done = _peeled(alive.where(F.col("widest") > WIDE))
    for n in range(0 if last is None else last + 1):
        run = alive.where((F.col("widest") <= WIDE) & (F.col("run") == n))
        rows = run.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("t", "id", "needs"))).alias("calls"), F.max("width").cast("int").alias("passes"))
        if n:
            before = run.select("conv", F.explode("needs").alias("id")).distinct().join(done, ["conv", "id"])
            rows = rows.join(before.groupBy("conv").agg(F.map_from_entries(F.collect_list(F.struct("id", "level"))).alias("before")), "conv", "left")
        else:
            rows = rows.withColumn("before", F.lit(None).cast("map<string,int>"))
        rows = rows.withColumn("before", F.coalesce("before", F.create_map().cast("map<string,int>")))
        found = rows.select("conv", "before", F.explode(_ordered(F.col("calls"), F.col("before"), F.col("passes"))).alias("id", "level"))
        done = done.union(staged(found.where(~F.map_contains_key("before", F.col("id"))).select("conv", "id", "level"), even=True))
    return done


def _ordered(calls: Column, before: Column, passes: Column) -> Column:
    """id to level of the calls (sorted by turn) that can be ordered, and what was known before.

    A pass orders every call whose dependencies stand before it; those inside one
    turn may stand in any order, hence as many passes as a turn has calls.
    """

    def step(levels: Column, call: Column) -> Column:
        ready = ~F.map_contains_key(levels, call["id"]) & F.forall(call["needs"], lambda n: F.map_contains_key(levels, n))
        level = F.coalesce(F.array_max(F.transform(call["needs"], lambda n: F.element_at(levels, n))) + 1, F.lit(0))
        return F.when(ready, F.map_concat(levels, F.map_from_arrays(F.array(call["id"]), F.array(level)))).otherwise(levels)

    return F.aggregate(F.sequence(F.lit(1), passes), before, lambda levels, _: F.aggregate(calls, levels, step))


def _peeled(alive: DataFrame) -> DataFrame:
    """conv, id, level by peeling: a round takes the calls whose dependencies all have a level.

    Rounds read only the dependencies that are still open and write only what is
    new, so that the work is the sum of the levels, not calls times depth.
    """
    level = lambda rows, n: rows.select("conv", "id", F.lit(n).alias("level"))
    if alive.isEmpty():
        return level(alive, 0)
    open_ = staged(alive.select("conv", "id", F.explode("needs").alias("need")), even=True)
    done = fresh = staged(level(alive.where(F.size("needs") == 0), 0), even=True)
    n = 0
    while True:
        met = fresh.select("conv", F.col("id").alias("need"))
        rest = staged(open_.join(met, ["conv", "need"], "left_anti").select("conv", "id", "need"), even=True)
        asked = open_.join(met, ["conv", "need"], "left_semi").select("conv", "id").distinct()
        n += 1
        fresh = staged(level(asked.join(rest.select("conv", "id"), ["conv", "id"], "left_anti"), n), even=True)
        if fresh.isEmpty():
            return done
        done, open_ = done.union(fresh), rest
        if n % 32 == 0:  # a long chain's plan stays short
            done = staged(done, even=True)


def format_chats(messages: DataFrame, tools: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, kind, place columns, call_id, linked_turn, status, errors and json of every message, call and result.

    ``tools``: name and parameters (JSON text) that hold in all conversations; a
    conversation's own declaration goes before.
    """
    base = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    read = base.withColumn("calls", _parsed("assistant", "tool_calls", _CALLS)).withColumn("result", _parsed("tool", "tool_call_id", _RESULT)).withColumn("declared", _parsed("system", "tools", _TOOLS))
    is_result = F.col("result.tool_call_id").isNotNull()

    # plain part of every message: one scan, nothing is moved
    content = F.when(F.size(F.coalesce("calls.tool_calls", F.array().cast(_CALLS.split("tool_calls:")[1][:-1]))) > 0, F.coalesce("calls.content", F.lit(""))).otherwise(F.col("text"))
    said = read.where(~F.coalesce(is_result, F.lit(False))).select(
        "conv", "turn", "role", F.lit("message").alias("kind"), F.col("turn").alias("anchor_turn"), F.lit(0).alias("level"), F.lit(-1).alias("call_index"), F.lit(0).alias("kind_rank"),
        F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("long").alias("linked_turn"), F.lit("ok").alias("status"), F.array().cast("array<string>").alias("errors"),
        F.to_json(F.struct(content.alias("content"), F.col("role").alias("role"), F.lit("message").alias("type"))).alias("json"),
    )

    # calls and results: only messages that hold them go on
    calls = read.where(F.size("calls.tool_calls") > 0).select("conv", "turn", "role", F.posexplode("calls.tool_calls").alias("call_index", "call")).select("conv", "turn", "role", "call_index", "call.*")
    given = F.when(F.schema_of_variant("arguments") == "STRING", F.try_parse_json(F.try_variant_get("arguments", "$", "string"))).otherwise(F.col("arguments"))
    calls = staged(calls.withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>"))).withColumn("json_arguments", F.to_json(given)).drop("arguments"), even=True)
    results = staged(read.where(is_result).select("conv", "turn", "role", F.col("result.tool_call_id").alias("id"), F.to_json("result.content").alias("json_content")), even=True)

    # one row for each (conv, id) in all three, so that no join multiplies rows
    firsts = calls.where("conv is not null and id is not null").groupBy("conv", "id").agg(F.min(F.struct("turn", "call_index")).alias("at"))
    answers = results.where("conv is not null").groupBy("conv", "id").agg(F.min(F.struct("turn")).alias("answer"))
    named = calls.join(firsts, ["conv", "id"], "left").withColumn("first", F.coalesce(F.struct("turn", "call_index").eqNullSafe(F.col("at")) & F.col("at").isNotNull(), F.lit(False)))
    named = staged(named.drop("at"), even=True)
    levels = _levels(named)

    own = read.where(F.size("declared.tools") > 0).select("conv", F.explode("declared.tools").alias("t")).groupBy("conv", F.col("t.name").alias("name")).agg(F.min(F.to_json("t.parameters")).alias("own_schema"))
    wide = tools.groupBy("name").agg(F.min("parameters").alias("wide_schema")) if tools is not None else messages.sparkSession.range(0).select(F.lit("").alias("name"), F.lit("").alias("wide_schema"))
    full = named.join(levels, ["conv", "id"], "left").join(answers, ["conv", "id"], "left").join(own, ["conv", "name"], "left").join(wide, "name", "left")
    schema = F.from_json(F.coalesce("own_schema", "wide_schema"), _SCHEMA)
    as_map = F.from_json("json_arguments", "map<string,variant>")
    is_object = F.coalesce(F.col("json_arguments").startswith("{"), F.lit(False))
    full = full.withColumn("schema", schema).withColumn("map", F.when(is_object, as_map))
    errors = F.when(~is_object, F.array(F.lit("arguments:not_an_object"))).when(F.coalesce("own_schema", "wide_schema").isNull(), F.array(F.lit("tool:not_declared"))).otherwise(_errors(F.col("map"), F.col("schema")))
    status = F.when(F.col("conv").isNull() | F.col("id").isNull(), "unnamed").when(~F.col("first"), "duplicate")
    status = status.when(F.col("level").isNull(), "unordered").when(F.col("answer").isNull(), "unanswered").otherwise("ok")
    made = full.select(
        "conv", "turn", "role", F.lit("call").alias("kind"), F.col("turn").alias("anchor_turn"), F.coalesce("level", F.lit(0)).cast("int").alias("level"), "call_index", F.lit(1).alias("kind_rank"),
        F.col("id").alias("call_id"), F.when(F.col("first"), F.col("answer.turn")).alias("linked_turn"), status.alias("status"), errors.alias("errors"),
        F.to_json(F.struct(F.try_parse_json("json_arguments").alias("arguments"), F.array_sort("depends_on").alias("depends_on"), F.col("id").alias("id"), F.col("name").alias("name"), F.lit("call").alias("type"))).alias("json"),
    )

    linked = results.join(firsts.join(levels, ["conv", "id"], "left"), ["conv", "id"], "left").join(answers, ["conv", "id"], "left")
    state = F.when(F.col("at").isNull(), "orphan").when(~F.col("turn").eqNullSafe(F.col("answer.turn")), "duplicate").otherwise("ok")
    back = linked.select(
        "conv", "turn", "role", F.lit("result").alias("kind"), F.coalesce("at.turn", "turn").alias("anchor_turn"), F.coalesce("level", F.lit(0)).cast("int").alias("level"), F.coalesce("at.call_index", F.lit(-1)).alias("call_index"), F.lit(2).alias("kind_rank"),
        F.col("id").alias("call_id"), F.col("at.turn").alias("linked_turn"), state.alias("status"), F.array().cast("array<string>").alias("errors"),
        F.to_json(F.struct(F.try_parse_json("json_content").alias("content"), F.col("id").alias("id"), F.lit("result").alias("type"))).alias("json"),
    )
    return said.union(made).union(back).withColumnRenamed("conv", "conv_id")

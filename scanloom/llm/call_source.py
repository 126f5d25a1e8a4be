"""Tool calls derived from plain conversations.

A table of conversations without tool use still has the shape of one: answers
follow questions, and later turns build on earlier ones.  ``with_calls`` keeps
every message as it is and derives from it what an agent's log would hold
beside it, by fixed rules over the role, the turn and the text's length ``n``:

* an ``assistant`` message calls ``measure`` (identifier ``t<turn>``, arguments
  n_chars, turn, style, sometimes note; it depends on the answer two turns
  before) and ``find`` or ``guess`` (identifier ``u<turn mod 4>``, which repeats;
  arguments in a string; it depends on both calls of ``measure``);
* a ``user`` message after the first turn brings the results of the turn before;
* a ``system`` message declares its own ``measure``; ``TOOLS`` hold elsewhere.

So every state that linking, ordering and validation know occurs: missing and
late dependencies, repeated identifiers, orphans, unanswered calls, undeclared
tools, arguments that break their schema or aren't JSON.

Defined results: null roles derive nothing; a null text has length 0; a null turn
gives calls without identifiers.  Repeated rows derive repeated messages.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STYLES = ("plain", "list", "code")


def _measure(styles: tuple[str, ...]) -> dict:
    kinds = {"n_chars": {"type": "integer"}, "turn": {"type": "integer"}, "style": {"type": "string", "enum": list(styles)}}
    return {"type": "object", "properties": kinds, "required": ["n_chars"], "additionalProperties": False}


#: Tools that hold in every conversation: name and schema.
TOOLS = {"measure": _measure(STYLES[:2]), "find": {"type": "object", "properties": {"q": {"type": ["string", "null"]}}, "required": ["q"]}}


def tools(spark: SparkSession) -> DataFrame:
    """``TOOLS`` as a table of name and parameters."""
    rows = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(json.dumps(v)).alias("parameters")) for k, v in TOOLS.items()))
    return spark.range(1).select(F.inline(rows))


def _tag(letter: str, number: Column) -> Column:
    return F.concat(F.lit(letter), number.cast("string"))


def with_calls(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: every row of ``conversations`` and the messages derived from it."""
    turn, n = F.col("turn"), F.char_length(F.coalesce("text", F.lit("")))
    before = F.when(turn >= 3, F.array(_tag("t", turn - 2))).otherwise(F.array().cast("array<string>"))
    style = F.element_at(F.array(*map(F.lit, STYLES)), (n % 3 + 1).cast("int"))
    arguments = F.struct(F.when(n % 5 != 0, n).alias("n_chars"), turn.alias("turn"), style.alias("style"), F.when(n % 7 == 0, F.lit("x")).alias("note"))
    measure = F.struct(_tag("t", turn).alias("id"), F.lit("measure").alias("name"), arguments.alias("arguments"), before.alias("depends_on"))
    asked = F.when(n % 3 == 0, F.concat(F.lit('{"q":"'), n.cast("string"), F.lit('"}'))).otherwise(F.concat(F.lit('{"q":'), n.cast("string"), F.lit("}")))
    asked = F.when(n % 11 == 0, F.lit("not json")).otherwise(asked)
    find = F.struct(_tag("u", turn % 4).alias("id"), F.when(n % 2 == 0, "find").otherwise("guess").alias("name"), asked.alias("arguments"), F.array_append(before, _tag("t", turn)).alias("depends_on"))
    calls = F.concat(F.lit('{"content":"","tool_calls":['), F.to_json(measure), F.lit(","), F.to_json(find), F.lit("]}"))
    declared = F.lit(json.dumps({"content": "", "tools": [{"name": "measure", "parameters": _measure(STYLES)}]}))

    def result(tag: Column, content: Column) -> Column:
        return F.struct(F.lit("tool").alias("role"), F.to_json(F.struct(tag.alias("tool_call_id"), content.alias("content"))).alias("text"))

    none = F.array().cast("array<struct<role:string,text:string>>")
    measured = result(_tag("t", turn - 1), F.struct(n.alias("n"), F.lit(True).alias("ok")))
    found = result(_tag("u", (turn - 1) % 4), F.array(n, turn))
    more = F.when(F.col("role") == "assistant", F.array(F.struct(F.col("role"), calls.alias("text")))).when(F.col("role") == "system", F.array(F.struct(F.col("role"), declared.alias("text"))))
    more = more.when((F.col("role") == "user") & (turn >= 1), F.when(n % 4 == 0, F.array(measured, found)).otherwise(F.array(measured))).otherwise(none)
    own = F.array(F.struct(F.col("role"), F.col("text")))
    return conversations.select("conv_id", "turn", F.inline(F.concat(own, more)))

"""Operator 7: chat formatting with tool-call linking, in DataFrame functions only.

Messages are rows (conv_id, turn, role, text). An assistant message calls tools if
its text is a JSON object with ``tool_calls``, an array of ``{"id", "name",
"arguments"}`` beside an optional ``content``. A message of role ``tool`` answers a
call if its text is a JSON object with ``tool_call_id`` and ``content``. All other
texts are plain content.

Calls and results of a conversation are hash-joined by (conv_id, id). Of calls,
and of results, with one id the first counts; later ones are ``repeated``.

The order is topological: messages follow their turns, but no result stands
before its call. ``place`` is an array to sort by, (turn, calls ahead, own turn): a
result that comes too early takes its call's turn and stands right after the
calling message, results of one message in the order of its calls. No window over
a conversation is needed, so one that holds a third of all rows is no hot group.

Arguments are checked against a table of tools, one row each: ``name`` and
``parameters``, an array of (name, type, required) with the types string, integer,
number, boolean, array, object and null. JSON is written canonically: keys in
order, no white space, numbers in one form; null members are left out of the
message itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.operators.skew import spread_lookup

MESSAGE = "content string, tool_call_id string, tool_calls array<struct<id:string,name:string,arguments:variant>>"
PARAMETERS = "array<struct<name:string,type:string,required:boolean>>"
#: JSON types of the names that Spark gives to the types of variant values.
TYPES = (
    ("^VOID$", "null"),
    ("^STRING$", "string"),
    ("^BIGINT$", "integer"),
    ("^(DECIMAL|DOUBLE|FLOAT)", "number"),
    ("^BOOLEAN$", "boolean"),
    ("^ARRAY", "array"),
    ("^OBJECT", "object"),
)


def json_type(value: Column) -> Column:
    name = F.schema_of_variant(value)
    kind = F.when(value.isNull(), "null")
    for pattern, own in TYPES:
        kind = kind.when(name.rlike(pattern), own)
    return kind


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``m``: what a message says as JSON (null if it is plain)."""
    said = F.when(F.ltrim("text").startswith("{"), F.from_json("text", MESSAGE))
    ours = messages.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").withColumn("_m", said)
    speaks = ((F.col("role") == "assistant") & F.col("_m.tool_calls").isNotNull()) | (
        (F.col("role") == "tool") & F.col("_m.tool_call_id").isNotNull()
    )
    return ours.withColumn("m", F.when(speaks, F.col("_m"))).drop("_m")


def calls_of(messages: DataFrame) -> DataFrame:
    """One row per tool call: conv_id, turn, number in the message from 0, id, name, arguments."""
    calls = messages.filter("role = 'assistant' and m is not null")
    calls = calls.select("conv_id", "turn", F.posexplode("m.tool_calls").alias("number", "call"))
    return calls.select("conv_id", "turn", "number", "call.id", "call.name", "call.arguments")


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, id, call_turn, number, result_turn): first call and first result of each id, hash-joined."""
    calls = calls_of(messages).filter("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "number")).alias("at"))
    results = messages.filter("role = 'tool' and m is not null")
    results = results.groupBy("conv_id", F.col("m.tool_call_id").alias("id")).agg(F.min("turn").alias("result_turn"))
    both = calls.join(results.hint("shuffle_hash"), ["conv_id", "id"], "full")
    return both.select("conv_id", "id", F.col("at.turn").alias("call_turn"), F.col("at.number").alias("number"), "result_turn")


def checked(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """``calls`` with ``errors``: sorted texts, empty if the arguments fit the tool's parameters.

    Arguments that are no JSON object, or that name a key twice, do not fit; neither
    do unknown tools and parameters, missing required ones and wrong types. An
    integer is a number too. A tool that is listed twice has all its parameters.
    """
    known = tools.groupBy(F.col("name").alias("_tool")).agg(F.flatten(F.collect_list("parameters")).alias("parameters"))
    calls = calls.withColumn("_tool", F.coalesce("name", F.lit("")))
    joined = spread_lookup(calls, known, ["_tool"], ["conv_id", "turn", "number"], "left")
    text = F.to_json("arguments")
    given = F.coalesce(
        F.transform(
            F.map_entries(F.from_json(text, "map<string,variant>")),
            lambda e: F.struct(e["key"].alias("name"), json_type(e["value"]).alias("type")),
        ),
        F.array().cast("array<struct<name:string,type:string>>"),
    )
    joined = joined.withColumn("_given", given)
    fits = lambda p, g: (p["type"] == g["type"]) | ((p["type"] == "number") & (g["type"] == "integer"))
    missing = F.filter(
        "parameters", lambda p: F.coalesce(p["required"], F.lit(False)) & ~F.exists("_given", lambda g: g["name"] == p["name"])
    )
    wrong = F.filter("_given", lambda g: F.exists("parameters", lambda p: (p["name"] == g["name"]) & ~fits(p, g)))
    unknown = F.filter("_given", lambda g: ~F.exists("parameters", lambda p: p["name"] == g["name"]))
    say = lambda what, found: F.transform(found, lambda x: F.concat(F.lit(what), x["name"]))
    errors = (
        F.when(F.col("parameters").isNull(), F.array(F.lit("unknown tool")))
        .when(text.isNull() | ~text.startswith("{"), F.array(F.lit("no object")))
        .otherwise(F.concat(say("missing ", missing), say("type of ", wrong), say("unknown ", unknown)))
    )
    return joined.withColumn("errors", F.array_sort(F.array_distinct(errors))).drop("_tool", "_given", "parameters")


def canonical() -> Column:
    """JSON of a message, from ``role``, ``text`` and ``m``."""
    said = F.col("m").isNotNull()
    calls = F.transform(
        "m.tool_calls", lambda c: F.struct(c["arguments"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name"))
    )
    return F.to_json(
        F.struct(
            F.when(said, F.col("m.content")).otherwise(F.col("text")).alias("content"),
            F.col("role").alias("role"),
            F.when(F.col("role") == "tool", F.col("m.tool_call_id")).alias("tool_call_id"),
            F.when(F.col("role") == "assistant", calls).alias("tool_calls"),
        )
    )


def formatted(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, place, status, calls, json.

    ``status`` is set for results: ``linked``, ``repeated`` (not the first of its id) or
    ``orphan`` (no such call in the conversation). ``calls`` has, for assistant messages
    with calls, (number, id, name, result_turn, errors) of each; ``result_turn`` is null
    if nobody answers or if an earlier call has the id. A null text is a message
    without content, a null role or turn stays null; messages that repeat conv_id, turn
    and text share the calls' entries. Extra columns are not returned.
    """
    said = parsed(messages)
    linked = links(said)
    place = F.array(F.col("turn"), F.lit(0).cast("bigint"), F.col("turn"))
    nothing = "array<struct<number:int,id:string,name:string,result_turn:bigint,errors:array<string>>>"

    def row(status: Column, place: Column, calls: Column) -> list[Column]:
        return [
            F.col("conv_id"), F.col("turn"), F.col("role"), place.alias("place"),
            status.alias("status"), calls.cast(nothing).alias("calls"), canonical().alias("json"),
        ]

    none = F.lit(None)
    is_result = (F.col("role") == "tool") & F.col("m").isNotNull()
    is_call = (F.col("role") == "assistant") & F.col("m").isNotNull()
    other = ~(F.coalesce(is_result, F.lit(False)) | F.coalesce(is_call, F.lit(False)))
    plain = said.filter(other).select(*row(none.cast("string"), place, none))

    results = said.filter(is_result).withColumn("id", F.col("m.tool_call_id"))
    results = results.join(linked.withColumnsRenamed({"number": "call_number"}), ["conv_id", "id"], "left")
    first = F.coalesce(F.col("turn") == F.col("result_turn"), F.lit(False))
    status = F.when(F.col("call_turn").isNull(), "orphan").when(first, "linked").otherwise("repeated")
    early = (F.col("turn") < F.col("call_turn")) & (status != "orphan")
    moved = F.when(early, F.array("call_turn", F.col("call_number").cast("bigint") + 1, "turn")).otherwise(place)
    results = results.select(*row(status, moved, none))

    calls = checked(calls_of(said), tools).join(linked.withColumnsRenamed({"number": "first_number"}), ["conv_id", "id"], "left")
    own = (F.col("turn") == F.col("call_turn")) & (F.col("number") == F.col("first_number"))
    entry = F.struct("number", "id", "name", F.when(own, F.col("result_turn")).alias("result_turn"), "errors")
    calls = calls.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set(entry)).alias("calls"))
    callers = said.filter(is_call).join(calls, ["conv_id", "turn"], "left").select(*row(none.cast("string"), place, F.col("calls")))
    return plain.union(results).union(callers)

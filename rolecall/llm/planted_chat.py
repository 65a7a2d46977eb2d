"""Messages with tool calls, derived from every row of ``conversations``, for operator 7's query.

Turns are multiplied by ten to make room. Each assistant message gets a call with
its own words as arguments; results come late, too early, or not at all, and some
answer no call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOOLS = [
    ("lookup", [("words", "integer", True), ("query", "string", True), ("limit", "number", False)]),
    ("count", [("words", "number", True), ("query", "string", False)]),
]


def messages(conversations: DataFrame) -> DataFrame:
    at, mix = F.col("turn") * 10, F.col("conv_id") + F.col("turn")
    words, query = F.length("text"), F.substring("text", 1, 20)
    name = F.when(F.col("turn") % 4 == 1, "lookup").otherwise("count")

    def call(words):
        arguments = F.struct(words.alias("words"), query.alias("query"))
        one = F.struct(F.concat(F.lit("c"), "turn").alias("id"), name.alias("name"), arguments.alias("arguments"))
        return F.to_json(F.struct(F.array(one).alias("tool_calls"), F.col("text").alias("content")))

    asked = F.when(mix % 5 == 0, call(words.cast("string"))).otherwise(call(words))
    said = conversations.select(
        "conv_id", at.alias("turn"), "role", F.when(F.col("role") == "assistant", asked).otherwise(F.col("text")).alias("text")
    )
    content = words.cast("string").alias("content")
    reply = F.to_json(F.struct(F.concat(F.lit("c"), "turn").alias("tool_call_id"), content))
    late = F.when(mix % 3 == 0, at - 5).otherwise(at + 5)
    answers = conversations.filter((F.col("role") == "assistant") & (mix % 7 != 0))
    answers = answers.select("conv_id", late.alias("turn"), F.lit("tool").alias("role"), reply.alias("text"))
    stray = F.to_json(F.struct(F.concat(F.lit("x"), "turn").alias("tool_call_id"), content))
    strays = conversations.filter((F.col("role") == "user") & (F.col("conv_id") % 4 == 0))
    strays = strays.select("conv_id", (at + 7).alias("turn"), F.lit("tool").alias("role"), stray.alias("text"))
    return said.union(answers).union(strays)


def tools(spark) -> DataFrame:
    return spark.createDataFrame(TOOLS, "name string, parameters array<struct<name:string,type:string,required:boolean>>")


SQL = """
WITH c AS (SELECT *, conv_id + turn AS mix FROM conversations),
calls AS (
  SELECT conv_id, turn * 10 AS turn, 'assistant' AS role, [turn * 10, 0, turn * 10] AS place, NULL AS status,
         1 AS n_calls, CASE WHEN mix % 7 <> 0 THEN 1 ELSE 0 END AS n_answered,
         CASE WHEN mix % 5 = 0 THEN 'type of words' ELSE '' END AS errors,
         json_object('content', text, 'role', 'assistant', 'tool_calls', json_array(json_object(
           'arguments', json_object('query', substr(text, 1, 20), 'words',
             CASE WHEN mix % 5 = 0 THEN to_json(length(text)::VARCHAR) ELSE to_json(length(text)) END),
           'id', 'c' || turn, 'name', CASE WHEN turn % 4 = 1 THEN 'lookup' ELSE 'count' END)))::VARCHAR AS json
  FROM c WHERE role = 'assistant'),
answers AS (
  SELECT conv_id, CASE WHEN mix % 3 = 0 THEN turn * 10 - 5 ELSE turn * 10 + 5 END AS turn, 'tool' AS role,
         CASE WHEN mix % 3 = 0 THEN [turn * 10, 1, turn * 10 - 5] ELSE [turn * 10 + 5, 0, turn * 10 + 5] END AS place,
         'linked' AS status, 0 AS n_calls, 0 AS n_answered, '' AS errors,
         json_object('content', length(text)::VARCHAR, 'role', 'tool', 'tool_call_id', 'c' || turn)::VARCHAR AS json
  FROM c WHERE role = 'assistant' AND mix % 7 <> 0),
strays AS (
  SELECT conv_id, turn * 10 + 7 AS turn, 'tool' AS role, [turn * 10 + 7, 0, turn * 10 + 7] AS place, 'orphan' AS status,
         0 AS n_calls, 0 AS n_answered, '' AS errors,
         json_object('content', length(text)::VARCHAR, 'role', 'tool', 'tool_call_id', 'x' || turn)::VARCHAR AS json
  FROM c WHERE role = 'user' AND conv_id % 4 = 0),
plain AS (
  SELECT conv_id, turn * 10 AS turn, role, [turn * 10, 0, turn * 10] AS place, NULL AS status, 0 AS n_calls, 0 AS n_answered,
         '' AS errors, json_object('content', text, 'role', role)::VARCHAR AS json
  FROM c WHERE role <> 'assistant')
SELECT conv_id, turn, role, array_to_string(place, ':') AS place, coalesce(status, '') AS status,
       n_calls, n_answered, errors, json
FROM (SELECT * FROM calls UNION ALL SELECT * FROM answers UNION ALL SELECT * FROM strays UNION ALL SELECT * FROM plain)
"""

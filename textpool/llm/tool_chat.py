"""Chat formatting: tool calls linked with their results.

Calls and results are joined by identifier, ordered topologically along the
calls whose results they build on, their arguments are checked against the
tools' schemas, and every call becomes one line of canonical JSON. One row
per call: a conversation of any length is never held together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpool.llm.common import materialise

#: Schemas by tool name, a subset of JSON schema: type object, properties (type, enum, minimum), required, additionalProperties.
SCHEMAS = {"reply": {"type": "object", "properties": {"prompt": {"type": "string"}, "turn": {"type": "integer", "minimum": 0}},
                     "required": ["prompt", "turn"], "additionalProperties": False}}

_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def _fits(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES.get(kind, object))


def schema_error(value, schema: Mapping, at: str = "arguments") -> str | None:
    """The first fault of ``value`` under ``schema`` in key order, or None."""
    if "type" in schema and not _fits(value, schema["type"]):
        return f"{at}: not of type {schema['type']}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not an allowed value"
    if "minimum" in schema and _fits(value, "number") and value < schema["minimum"]:
        return f"{at}: below {schema['minimum']}"
    if isinstance(value, dict):
        for name in sorted(schema.get("required", ())):
            if name not in value:
                return f"{at}.{name}: missing"
        known = schema.get("properties", {})
        for name in sorted(value):
            if name in known:
                if fault := schema_error(value[name], known[name], f"{at}.{name}"):
                    return fault
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{name}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if fault := schema_error(x, schema["items"], f"{at}[{i}]"):
                return fault
    return None


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and no escapes that are not needed; numbers that JSON lacks are a ``ValueError``."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def depths(spark: SparkSession, calls: DataFrame) -> DataFrame:
    """(call_id, depth) of ``calls(call_id, parent_id)``: number of calls before it on its chain; null on a cycle.

    Pointer jumping: every round doubles the reach, so a chain of n calls
    takes log2(n) joins. A parent that does not exist counts as none.
    """
    known = calls.select(F.col("call_id").alias("p"))
    state = (calls.join(known, F.col("parent_id") == F.col("p"), "left")
             .select("call_id", F.col("p").alias("up"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    state = materialise(spark, state, "call-depths")
    n, rounds = state.count(), 0
    while rounds <= max(1, n).bit_length() and state.filter("up IS NOT NULL").limit(1).count():
        above = state.select(F.col("call_id").alias("u"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = state.join(above, F.col("up") == F.col("u"), "left").select(
            "call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        state = materialise(spark, state, "call-depths")
        rounds += 1
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link_calls(spark: SparkSession, calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping] = SCHEMAS) -> DataFrame:
    """conv_id, call_id, depth, status, fault, n_results, json: one row per identifier of
    ``calls(conv_id, call_id, parent_id, turn, name, arguments)`` with ``results(call_id, content)``.

    ``arguments`` is JSON text. Calls that repeat an identifier count as one,
    the smallest by (turn, name, arguments); of several results the smallest
    text is taken and ``n_results`` tells their number. Arguments that no JSON
    can repeat (NaN, infinite numbers, half a surrogate pair) are bad JSON.
    Calls without an identifier, and results of no call, are left out. ``status`` is ok,
    invalid (``fault`` says why: bad JSON, unknown tool, or the schema),
    unanswered or cyclic, the worst last. ``depth`` orders the calls of a
    conversation topologically, then ``turn``. Empty tables give an empty result.
    """
    own = F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("name", F.lit("")).alias("name"),
                   F.coalesce("arguments", F.lit("")).alias("arguments"), "conv_id", "parent_id")
    once = materialise(spark, calls.filter("call_id IS NOT NULL").groupBy("call_id").agg(F.min(own).alias("c")).select("call_id", "c.*"), "calls")
    answers = results.filter("call_id IS NOT NULL").groupBy("call_id").agg(
        F.min(F.coalesce("content", F.lit(""))).alias("content"), F.count(F.lit(1)).alias("n_results"))
    linked = (once.join(answers, "call_id", "left").join(depths(spark, once.select("call_id", "parent_id")), "call_id")
              .select("conv_id", "call_id", "parent_id", "turn", "name", "arguments", "content",
                      F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "depth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, faults, lines = [], [], []
            for r in batch.to_pylist():
                try:
                    arguments = json.loads(r["arguments"])
                    canonical(arguments).encode()  # no number beyond JSON's, no half of a surrogate pair
                    fault = None if r["name"] in schemas else "unknown tool"
                    fault = fault or schema_error(arguments, schemas[r["name"]])
                except (ValueError, RecursionError):
                    arguments, fault = None, "bad JSON"
                state = "cyclic" if r["depth"] is None else "unanswered" if not r["n_results"] else "invalid" if fault else "ok"
                status.append(state)
                faults.append(fault)
                lines.append(canonical({
                    "id": r["call_id"], "parent": r["parent_id"], "call": {"name": r["name"], "arguments": arguments},
                    "result": r["content"], "status": state}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("call_id"), batch.column("turn"), batch.column("depth"), pa.array(status, pa.string()),
                 pa.array(faults, pa.string()), batch.column("n_results"), pa.array(lines, pa.string())],
                ["conv_id", "call_id", "turn", "depth", "status", "fault", "n_results", "json"])

    return linked.mapInArrow(run, "conv_id long, call_id string, turn long, depth long, status string, fault string, n_results long, json string")


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results told by plain conversations: a user's turn calls ``reply``, the assistant's next turn answers it,
    and a user's turn two after another one builds on it. Turns without a conv_id or number, and those of other roles,
    are neither calls nor results."""
    def call_id(turn):
        return F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))

    rows = conversations.select("conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    turn = F.col("turn").cast("long")
    arguments = F.concat(F.lit('{"prompt":'), F.coalesce(F.expr("substring(to_json(named_struct('t', text)), 6)"), F.lit("")))
    arguments = F.when(F.col("text").isNull(), F.lit('{"prompt":null')).otherwise(F.regexp_replace(arguments, r"\}$", ""))
    calls = rows.filter("role = 'user'").select(
        F.col("conv_id").cast("long").alias("conv_id"), call_id(turn).alias("call_id"), call_id(turn - 2).alias("parent_id"), turn.alias("turn"),
        F.lit("reply").alias("name"), F.concat(arguments, F.lit(',"turn":'), turn.cast("string"), F.lit("}")).alias("arguments"))
    results = rows.filter("role = 'assistant'").select(call_id(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def tool_chat_digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conv_id, call_id, turn, depth, status, n_results, json of every call: what the registered query returns."""
    calls, results = conversation_calls(conversations)
    return link_calls(spark, calls, results).select("conv_id", "call_id", "turn", "depth", "status", "n_results", "json")


SQL = r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
answers AS (
  SELECT conv_id, turn - 1 AS turn, min(coalesce(text, '')) AS content, count(*) AS n FROM conversations
  WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
chain AS (
  SELECT c.conv_id, c.turn, 0 AS depth FROM calls c ANTI JOIN calls p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2
  UNION ALL
  SELECT c.conv_id, c.turn, depth + 1 FROM chain h JOIN calls c ON c.conv_id = h.conv_id AND c.turn = h.turn + 2),
told AS (
  SELECT h.conv_id, h.turn, h.depth, c.text, a.content, coalesce(a.n, 0) AS n,
         CASE WHEN a.n IS NULL THEN 'unanswered' WHEN c.text IS NULL OR h.turn < 0 THEN 'invalid' ELSE 'ok' END AS status
  FROM chain h JOIN calls c USING (conv_id, turn) LEFT JOIN answers a USING (conv_id, turn))
SELECT conv_id, conv_id || ':' || turn AS call_id, turn, depth, status, n AS n_results,
       '{"call":{"arguments":{"prompt":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"turn":' || turn || '},"name":"reply"},"id":"' || conv_id || ':' || turn
       || '","parent":"' || conv_id || ':' || (turn - 2) || '","result":' || coalesce(to_json(content)::VARCHAR, 'null')
       || ',"status":"' || status || '"}' AS json
FROM told
"""

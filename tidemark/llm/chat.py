"""Chat formatting: tool calls linked to their results, ordered topologically, checked against schemas, as canonical JSON.

A message is one row. An assistant's text that is a JSON object with `tool_calls` holds calls (id, name, arguments as an
object or its JSON text), a tool's text that is one with `tool_call_id` is a result; every other text is plain. Calls and
results meet by a hash join on conversation and identifier. A result comes after its call, and a call that names a
result as "$ref:<id>" in its arguments comes after that call; levels are given by rounds of joins until none is left.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import materialise

_KINDS = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys, no white space and characters unescaped."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _no_constant(name: str):
    raise ValueError(name)


def _loads(text: str | None):
    """A JSON object; null for all else, and for one that can't be written again (lone surrogates, NaN, too deep)."""
    try:
        data = json.loads(text, parse_constant=_no_constant) if text and text.lstrip()[:1] == "{" else None
        canonical(data).encode()
        return data
    except (ValueError, RecursionError):
        return None


def fault(value, schema: dict, at: str = "arguments") -> str | None:
    """The first way in which a value breaks a JSON schema (type, required, properties, additionalProperties, enum, items), or null."""
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = {"integer": number and (isinstance(value, int) or value.is_integer()), "number": number}.get(kind, kind is None or isinstance(value, _KINDS.get(kind, object)))
    if not fits:
        return f"{at}: not of type {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not one of the values allowed"
    if isinstance(value, dict):
        own = schema.get("properties", {})
        for k in schema.get("required", []):
            if k not in value:
                return f"{at}: {k} is missing"
        for k in sorted(value):
            if k not in own and schema.get("additionalProperties") is False:
                return f"{at}: {k} isn't allowed"
            if k in own and (f := fault(value[k], own[k], f"{at}.{k}")):
                return f
    if isinstance(value, list) and "items" in schema:
        return next((f for i, x in enumerate(value) if (f := fault(x, schema["items"], f"{at}[{i}]"))), None)
    return None


def parsed(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, turn, role, json (canonical), calls: array<struct<id, name, fault, refs>> and result_of of every message."""
    schemas = schemas or {}
    rows = messages.select("conv_id", "turn", "role", "text")
    call = pa.struct([("id", pa.string()), ("name", pa.string()), ("fault", pa.string()), ("refs", pa.list_(pa.string()))])
    schema = "conv_id long, turn long, role string, json string, calls array<struct<id:string,name:string,fault:string,refs:array<string>>>, result_of string"

    def one(role: str | None, text: str | None):
        data = _loads(text) if role in ("assistant", "tool") else None
        if role == "assistant" and isinstance(data, dict) and isinstance(data.get("tool_calls"), list):
            calls, out = [], []
            for c in data["tool_calls"]:
                c = c if isinstance(c, dict) else {}
                given = c.get("arguments")
                args = given if isinstance(given, dict) else _loads(given if isinstance(given, str) else None)
                id_, name = (None if c.get(k) is None else str(c[k]) for k in ("id", "name"))
                wrong = "arguments: not an object" if args is None else fault(args, schemas[name]) if name in schemas else "no schema" if schemas else None
                calls.append({"id": id_, "name": name, "fault": wrong, "refs": sorted(set(re.findall(r'"\$ref:([^"]+)"', canonical(args))))})
                out.append({"arguments": args if args is not None else given, "id": id_, "name": name})
            return canonical({"content": data.get("content"), "role": role, "tool_calls": out}), calls, None
        if role == "tool" and isinstance(data, dict) and data.get("tool_call_id") is not None:
            id_ = str(data["tool_call_id"])
            return canonical({"content": data.get("content"), "role": role, "tool_call_id": id_}), [], id_
        return canonical({"content": text, "role": role}), [], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [one(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            text, calls, result = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(text, pa.string()), pa.array(calls, pa.list_(call)), pa.array(result, pa.string())], names=["conv_id", "turn", "role", "json", "calls", "result_of"])

    return rows.mapInArrow(run, schema)


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, id, level, place_turn of calls(conv_id, id, refs, call_turn, answer_turn).

    level: 1 without references, else 1 more than the highest call named. place_turn: the latest of the call's own turn and,
    for each call that it names, that call's place and answer. Calls in a cycle, or that wait for one, get no row.
    References to unknown calls don't count; one to the call itself is a cycle. One round of joins a level."""
    key = ["conv_id", "id"]
    known = calls.select("conv_id", F.col("id").alias("ref")).distinct()
    edges = calls.select(*key, F.explode("refs").alias("ref")).distinct().join(known, ["conv_id", "ref"])
    left, done, level = calls.select(*key, "call_turn", "answer_turn", F.col("call_turn").alias("place_turn")).dropDuplicates(key), None, 1
    while True:
        waiting = edges.select(*key).distinct()
        now = materialise(left.join(waiting, key, "left_anti").withColumn("level", F.lit(level)), "level")
        done = now if done is None else done.unionAll(now)
        left = left.join(waiting, key, "left_semi")
        if now.isEmpty() or left.isEmpty():
            return done.select(*key, "level", "place_turn")
        ready = now.select("conv_id", F.col("id").alias("ref"), F.greatest("place_turn", "answer_turn").alias("seen"))
        later = edges.join(ready, ["conv_id", "ref"]).groupBy(*key).agg(F.max("seen").alias("seen"))
        left = materialise(left.join(later, key, "left").withColumn("place_turn", F.greatest("place_turn", "seen")).drop("seen"), "left")
        edges = materialise(edges.join(ready.select("conv_id", "ref"), ["conv_id", "ref"], "left_anti"), "edges")
        level += 1


def linked(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """Every message, canonical and placed: conv_id, turn, role, after_turn, level, n_calls, n_answered, n_valid, status, json.

    (after_turn, level, turn) is the order within a conversation: plain messages stand at their own turn, a call at the latest
    of its own and of the places and answers of all calls that it waits for, directly or not, and a result at its own turn or
    its call's place, whichever is later. level is 0 for plain messages, odd for calls, and one more for their results.
    status: plain, calls, cycle (placed at its own turn), result, orphan (no such call) or duplicate (the id has an earlier
    result). Where an id is used by several calls, the first in (turn, place) is linked and the others count as invalid. Null
    text or role: plain with a null. Repeated rows stay; an empty table gives no rows; other columns are ignored. One row a
    message, so no conversation is gathered in one place."""
    rows = materialise(parsed(messages, schemas), "chat")
    call = F.col("call")
    each = rows.where(F.size("calls") > 0).select("conv_id", "turn", F.posexplode("calls").alias("place", "call")).where("call.id IS NOT NULL")
    first = each.groupBy("conv_id", call["id"].alias("id")).agg(F.min(F.struct("turn", "place", call["refs"].alias("refs"))).alias("f")).select("conv_id", "id", F.col("f.turn").alias("call_turn"), F.col("f.place").alias("call_place"), F.col("f.refs").alias("refs"))
    results = rows.where("result_of IS NOT NULL").select("conv_id", F.col("result_of").alias("id"), "turn")
    answer = results.groupBy("conv_id", "id").agg(F.min("turn").alias("answer_turn"))
    known = materialise(first.join(answer, ["conv_id", "id"], "left"), "calls")
    after = known.drop("refs").join(levels(known), ["conv_id", "id"], "left").withColumn("place_turn", F.coalesce("place_turn", "call_turn")).withColumn("level", F.expr("2 * level - 1"))
    mine = each.select("conv_id", "turn", "place", call["id"].alias("id"), call["fault"].isNull().alias("fine")).join(after, ["conv_id", "id"])
    is_first = F.expr("turn = call_turn AND place = call_place")
    of_calls = mine.groupBy("conv_id", "turn").agg(F.max("place_turn").alias("c_after"), F.max("level").alias("c_level"), F.max(F.col("level").isNull()).alias("cycle"), F.count_if(is_first & F.col("answer_turn").isNotNull()).alias("n_answered"), F.count_if(is_first & F.col("fine")).alias("n_valid"))
    of_results = results.distinct().join(after, ["conv_id", "id"], "left").groupBy("conv_id", "turn", F.col("id").alias("result_of")).agg(
        F.max(F.greatest("turn", "place_turn")).alias("r_after"), F.max("level").alias("r_level"), F.max("call_turn").isNotNull().alias("has_call"), F.max(F.col("turn") > F.col("answer_turn")).alias("again")
    )
    plain = rows.where("size(calls) = 0 AND result_of IS NULL").select("conv_id", "turn", "role", F.col("turn").alias("after_turn"), F.lit(0).alias("level"), *[F.lit(0).cast("long").alias(c) for c in ("n_calls", "n_answered", "n_valid")], F.lit("plain").alias("status"), "json")
    calls = rows.where("size(calls) > 0").join(of_calls, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", F.coalesce("c_after", "turn"), F.coalesce("c_level", F.lit(1)), F.size("calls").cast("long"), F.coalesce("n_answered", F.lit(0)), F.coalesce("n_valid", F.lit(0)), F.when(F.col("cycle"), "cycle").otherwise("calls"), "json")
    status = F.when(~F.coalesce("has_call", F.lit(False)), "orphan").when(F.col("again"), "duplicate").otherwise("result")
    tools = rows.where("result_of IS NOT NULL").join(of_results, ["conv_id", "turn", "result_of"], "left").select("conv_id", "turn", "role", F.coalesce("r_after", "turn"), F.coalesce(F.col("r_level") + 1, F.lit(0)), *[F.lit(0).cast("long")] * 3, status, "json")
    return plain.unionAll(calls).unionAll(tools)

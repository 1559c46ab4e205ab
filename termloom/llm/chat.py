"""Chat formatting with linked tool calls.

Messages, calls and results come as rows. Calls and results meet in a hash join on the
conversation and the call's identifier; the identifier spreads a conversation of any length
over the cluster. Calls may name the calls that they depend on, and a call's level is one above
the highest of those. Calls with one dependency form chains, which are followed by pointer
doubling, so a chain costs the logarithm of its length in rounds; calls with several wait for
all of theirs, level by level. Each round is a join written to the shared folder. Calls in a
cycle, and those above one, are never placed and are marked. Arguments are checked against the
schema of the call's function. The rows are range-sorted by conversation, level (of its call,
for a result), turn and kind, and each becomes one line of canonical JSON: sorted keys, no
spaces, UTF-8, half surrogates escaped.

Defined cases: a null text is an empty content; arguments that aren't JSON, hold NaN or an
infinity, or are nested too deep for the reader are invalid and kept as text; results without
a call are orphans and calls without a result are open; a null ``call_id`` links nothing, so
such calls are open and such results orphans; a null ``conv_id`` is a conversation like any
other; several results of a call each get their row; repeated rows get a row each; plain
messages have no level and come first; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import materialize, short

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


_HALF = re.compile("[\ud800-\udfff]")


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces and characters as they are; ValueError for what JSON can't say."""
    out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _HALF.sub(lambda m: f"\\u{ord(m.group()):04x}", out)


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def read_json(text: str | None) -> object:
    """The value of a JSON text that has a canonical form; ValueError for any other text."""
    try:
        value = json.loads(text or "", parse_constant=_no_constant)
        canonical([[[[value]]]])  # a record adds a few levels
    except RecursionError as e:
        raise ValueError("nested too deep") from e
    return value


def schema_errors(value: object, schema: dict, at: str = "$") -> list[str]:
    """What in a value is against a JSON schema (types, required, properties, items, bounds)."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    ok = not kinds or any(isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds)
    if not ok:
        return [f"{at}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not one of the listed values")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            found.append(f"{at}: too long")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            found.append(f"{at}: too small")
        if value > schema.get("maximum", value):
            found.append(f"{at}: too large")
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += schema_errors(x, schema["items"], f"{at}[{i}]")
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}: {k} is missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += schema_errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}: {k} is not allowed")
    return found


def _key(call_id: str) -> Column:
    """Conversation and call as one value that is never null."""
    return F.to_json(F.struct(F.col("conv_id").alias("c"), F.col(call_id).alias("i")))


def _anchors(chain: DataFrame) -> DataFrame:
    """(key, anchor, steps): where calls (key, to) with one dependency each lead, by doubling; calls
    that lead into a cycle are left out."""
    now = materialize(chain.select("key", F.col("to").alias("anchor"), F.lit(1).alias("steps")), "chat-chain")
    rounds = math.ceil(math.log2(now.count() + 1)) + 1
    while True:
        on = now.select(F.col("key").alias("anchor"), F.col("anchor").alias("next"), F.col("steps").alias("more"))
        joined = now.join(on, "anchor", "left")
        if rounds == 0 or joined.where("next is not null").isEmpty():
            return joined.where("next is null").select("key", "anchor", "steps")
        far = joined.select("key", F.coalesce("next", "anchor").alias("anchor"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        now, rounds = materialize(far, "chat-chain"), rounds - 1


def levels(calls: DataFrame) -> DataFrame:
    """(key, level) of calls with ``depends_on`` arrays of ids in the same conversation; calls in or
    above a cycle have no row. Unknown ids don't count."""
    nodes = materialize(calls.select(_key("call_id").alias("key")).distinct(), "chat-nodes")
    edges = calls.select("conv_id", _key("call_id").alias("key"), F.explode("depends_on").alias("needs"))
    edges = edges.select("key", _key("needs").alias("to")).distinct().join(nodes.select(F.col("key").alias("to")), "to", "left_semi")
    edges = materialize(edges, "chat-edges")
    needs = edges.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("to"))
    needs = materialize(nodes.join(needs, "key", "left"), "chat-needs")
    chained = materialize(_anchors(needs.where("n = 1").select("key", "to")), "chat-anchors")
    # calls with several dependencies: each leads to a call without any, or to another of their kind
    several = needs.where("n > 1").select("key")
    ends = needs.where("n is null").select("key")
    wide = edges.join(several, "key", "left_semi").join(chained.withColumnRenamed("key", "to"), "to", "left")
    cyclic = wide.where("anchor is null").join(needs.where("n = 1").select(F.col("key").alias("to")), "to", "left_semi").select("key")
    wide = wide.select("key", F.coalesce("anchor", "to").alias("anchor"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    wide = materialize(wide.join(cyclic.distinct(), "key", "left_anti"), "chat-wide")
    placed = materialize(ends.withColumn("level", F.lit(0)), "chat-level")
    while True:
        of = placed.select(F.col("key").alias("anchor"), "level")
        met = wide.join(placed.select("key"), "key", "left_anti").join(of, "anchor", "left").groupBy("key")
        ready = met.agg(F.max(F.col("level") + F.col("steps")).alias("level"), F.sum(F.col("level").isNull().cast("int")).alias("wait"))
        fresh = materialize(ready.where("wait = 0").select("key", "level"), "chat-level")
        if fresh.isEmpty():
            break
        placed = materialize(placed.unionByName(fresh), "chat-level")
    of = placed.select(F.col("key").alias("anchor"), "level")
    return placed.unionByName(chained.join(of, "anchor").select("key", (F.col("level") + F.col("steps")).alias("level")))


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Link and serialise messages (conv_id, turn, role, text, call_id, name, depends_on).

    Rows with a ``name`` are calls (``text`` holds the arguments as JSON), rows with role
    ``tool`` are results of ``call_id``, others are plain messages. Returns conv_id, turn,
    role, call_id, kind, status, level, line, in order."""
    kinds = {c: messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    is_call = F.col("name").isNotNull()
    kind = F.when(is_call, "call").when(F.col("role") == "tool", "result").otherwise("message")
    rows = messages.select("conv_id", "turn", "role", "text", "call_id", "name", kind.alias("kind"))
    rows = rows.withColumn("call_id", F.when(F.col("kind") != "message", F.col("call_id")))
    level_of = levels(messages.where(is_call).select("conv_id", "call_id", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")))
    has_id = F.col("call_id").isNotNull()
    ends = rows.where("kind <> 'message'").groupBy(_key("call_id").alias("key"))
    ends = ends.agg(F.max((F.col("kind") == "call") & has_id).alias("has_call"), F.max((F.col("kind") == "result") & has_id).alias("has_result"))
    ends = ends.join(level_of, "key", "left")
    linked = rows.where("kind <> 'message'").withColumn("key", _key("call_id")).join(ends, "key", "left")
    linked = linked.withColumn("level", F.when((F.col("kind") == "call") | F.col("has_call"), F.col("level")))
    plain = rows.where("kind = 'message'").withColumns({"has_call": F.lit(None).cast("boolean"), "has_result": F.lit(None).cast("boolean"), "level": F.lit(None).cast("int")})
    order = ["conv_id", "turn", "role", "text", "call_id", "name", "kind", "has_call", "has_result", "level"]
    place = {"message": 0, "call": 1, "result": 2}
    by = [F.asc_nulls_first(c) for c in ("conv_id", "level", "turn")]
    by.append(F.asc(F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in place.items()])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            status, lines, at = [], [], []
            for r in batch.select(["role", "text", "call_id", "name", "kind", "has_call", "has_result", "level"]).to_pylist():
                record = {"role": r["role"], "content": r["text"] or ""}
                level, state = r["level"], "message"
                if r["kind"] == "call":
                    try:
                        arguments = read_json(r["text"])
                        wrong = schema_errors(arguments, schemas[r["name"]]) if r["name"] in schemas else ["$: unknown function"]
                    except ValueError:
                        arguments, wrong = r["text"], ["$: not JSON"]
                    state = "cycle" if level is None else "invalid" if wrong else "linked" if r["has_result"] else "open"
                    record = {"role": r["role"], "tool_call": {"id": r["call_id"], "name": r["name"], "arguments": arguments}}
                    if wrong:
                        record["tool_call"]["errors"] = wrong
                elif r["kind"] == "result":
                    state = "linked" if r["has_call"] else "orphan"
                    record["tool_call_id"] = r["call_id"]
                status.append(state)
                at.append(level)
                lines.append(canonical(record))
            columns = [batch.column(c) for c in ("conv_id", "turn", "role", "call_id", "kind")]
            columns += [pa.array(status, pa.string()), pa.array(at, pa.int32()), pa.array(lines, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "call_id", "kind", "status", "level", "line"])

    shape = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, call_id string, kind string, status string, level int, line string"
    both = linked.select(*order).unionByName(plain.select(*order))
    # texts last: what tells equal rows of a hot conversation apart is their turn
    return both.repartitionByRange(*by).sortWithinPartitions(*by, "call_id", "role", "text").mapInArrow(run, shape)


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations with the answers as tool results: a user turn calls
    ``answer`` with its text, and the assistant's next turn is the call's result. A call depends
    on the call of the turn before it or, where that is none, of the turn before that."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    name = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt")))
    asked = conversations.where(user & F.col("turn").isNotNull()).select(F.col("conv_id").alias("c"), (F.col("turn") + 1).alias("t")).distinct()
    rows = conversations.join(asked, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left")
    return rows.select(
        "conv_id",
        "turn",
        F.when(assistant, "tool").otherwise(F.col("role")).alias("role"),
        F.when(user, arguments).otherwise(F.col("text")).alias("text"),
        F.when(F.col("turn").isNotNull(), F.when(user, name(0)).when(assistant, name(1))).alias("call_id"),
        F.when(user, "answer").alias("name"),
        F.when(user, F.array(F.when(F.col("t").isNotNull(), name(1)).otherwise(name(2)))).alias("depends_on"),
    )


#: The schema of the call that :func:`turns_as_calls` makes.
ANSWER_SCHEMA = {"answer": {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1}}, "required": ["prompt"], "additionalProperties": False}}

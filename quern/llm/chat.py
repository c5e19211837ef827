"""Chat messages as canonical JSON, with tool calls linked to their results; DataFrame functions only.

An assistant's text may be a JSON object with ``tool_calls``, a list of {id, name, arguments, depends_on}; a tool's
text one with ``tool_call_id``. Calls and results meet in a hash join by conversation and identifier.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import materialise

CALL = "content string, tool_calls array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>"
RESULT = "tool_call_id string, content string"
#: Tables of levels that are read side by side at most; so many are written as one.
UNITED = 32
#: The JSON type names of Spark's variant types.
_TYPES = {"BIGINT": "integer", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "DOUBLE": "number", "FLOAT": "number"}


def _type_name(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    named = F.create_map(*[F.lit(x) for pair in _TYPES.items() for x in pair])[kind]
    return F.when(kind.startswith("DECIMAL"), F.lit("number")).when(kind.startswith("OBJECT"), F.lit("object")).when(kind.startswith("ARRAY"), F.lit("array")).otherwise(named)


def _none() -> Column:
    return F.array().cast("array<string>")


def _fits(value: Column, kinds: list[str]) -> Column:
    got = _type_name(value)
    return F.coalesce(got.isin(kinds) | (F.lit("number" in kinds) & (got == "integer")), F.lit(False))


def _said(bad: Column, text: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.lit(text))).otherwise(_none())


def _value_errors(value: Column, schema: dict[str, Any], path: str) -> Column:
    """What is wrong with a variant by a schema: type, enum, bounds of numbers and lengths, items, properties at any depth."""
    checks = [_none()]
    if kinds := schema.get("type"):
        kinds = [kinds] if isinstance(kinds, str) else list(kinds)
        checks.append(_said(~_fits(value, kinds), f"{path} is not {' or '.join(kinds)}"))
    if "enum" in schema:
        known = [json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True) for x in schema["enum"]]
        checks.append(_said(~F.to_json(value).isin(known), f"{path} is not in the list"))
    number = F.when(_fits(value, ["number"]), value.cast("double"))
    length = F.when(_fits(value, ["string"]), F.length(value.cast("string")))
    for key, bad in (("minimum", number < schema.get("minimum")), ("maximum", number > schema.get("maximum")), ("minLength", length < schema.get("minLength")), ("maxLength", length > schema.get("maxLength"))):
        if key in schema:
            checks.append(_said(bad, f"{path} is beyond its {key}"))
    if "items" in schema:
        items = F.when(_type_name(value) == "array", value.cast("array<variant>"))
        checks.append(F.coalesce(F.flatten(F.transform(items, lambda x: _value_errors(x, schema["items"], f"{path}[]"))), _none()))
    if {"properties", "required", "additionalProperties"} & schema.keys():
        checks.append(F.coalesce(F.when(_type_name(value) == "object", _object_errors(value, schema, f"{path}.")), _none()))
    return F.concat(*checks)


def _object_errors(value: Column, schema: dict[str, Any], path: str = "") -> Column:
    given, properties = value.cast("map<string,variant>"), schema.get("properties", {})
    wanted = F.array(*[F.lit(k) for k in sorted(schema.get("required", []))]).cast("array<string>")
    checks = [F.transform(F.filter(wanted, lambda p: ~F.map_contains_key(given, p)), lambda p: F.concat(F.lit(f"missing {path}"), p))]
    for key, inner in sorted(properties.items()):
        checks.append(F.when(F.map_contains_key(given, F.lit(key)), _value_errors(F.try_element_at(given, F.lit(key)), inner, path + key)).otherwise(_none()))
    if schema.get("additionalProperties") is False:
        known = F.array(*[F.lit(k) for k in sorted(properties)]).cast("array<string>")
        checks.append(F.transform(F.array_sort(F.array_except(F.map_keys(given), known)), lambda p: F.concat(F.lit(f"unknown {path}"), p)))
    return F.concat(*checks)


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, Any]]) -> Column:
    """What is wrong with a call's arguments, in a fixed order; an empty list if nothing is.

    ``schemas`` holds JSON schemas of objects by tool: properties, required names and additionalProperties; of each value its type,
    enum, minimum, maximum, minLength, maxLength, items and properties of its own. A tool without a schema is an error if there are any
    schemas at all.
    """
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    found = F.when(~is_object, F.array(F.lit("arguments are not an object")))
    for tool, schema in sorted(schemas.items()):
        found = found.when(name == tool, _object_errors(F.when(is_object, value), schema))
    if schemas:
        return F.coalesce(found.otherwise(F.array(F.lit("unknown tool"))), _none())
    return found.otherwise(_none())


def parse_messages(messages: DataFrame, schemas: dict[str, dict[str, Any]] | None = None) -> DataFrame:
    """(conv_id, turn, role, text, key, calls, call_id): messages with what their JSON says of tools."""
    looks = F.ltrim(F.col("text")).startswith("{")
    call = F.from_json(F.when((F.col("role") == "assistant") & looks, F.col("text")), CALL)
    result = F.from_json(F.when((F.col("role") == "tool") & looks, F.col("text")), RESULT)
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("conv_id", "turn", "role", "text")).withColumn("_call", call).withColumn("_result", result)
    calls = F.transform(
        F.coalesce(F.col("_call.tool_calls"), F.from_json(F.lit("[]"), "array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>")),
        lambda c: F.struct(F.try_parse_json(c["arguments"]).alias("arguments"), argument_errors(c["name"], c["arguments"], schemas or {}).alias("errors"), c["id"].alias("id"), c["name"].alias("name"), c["depends_on"].alias("depends_on")),
    )
    content = F.when(F.size("calls") > 0, F.coalesce(F.col("_call.content"), F.lit(""))).when(F.col("_result.tool_call_id").isNotNull(), F.coalesce(F.col("_result.content"), F.lit(""))).otherwise(F.col("text"))
    return rows.withColumn("calls", calls).withColumn("content", content).select("conv_id", "turn", "role", "content", "key", "calls", F.col("_result.tool_call_id").alias("call_id"))


def _chain_ends(singles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ends, stuck) of calls (conv_id, id, to, dist) that wait for one other: (conv_id, id, to, dist) with the first call on the way that waits
    for none or several, and (conv_id, id) of those whose way runs into a cycle.

    Each round doubles how far a call sees, so rounds grow with the logarithm of a chain.
    """
    known, left = materialise(singles, "call-chains"), -1
    while True:
        beyond = known.select("conv_id", F.col("id").alias("to"), F.col("to").alias("_to"), F.col("dist").alias("_dist"))
        seen = materialise(known.join(beyond, ["conv_id", "to"], "left").select("conv_id", "id", "to", "dist", "_to", "_dist"), "call-chains")
        open_ = seen.filter("_to is not null").count()
        if open_ in (0, left):  # what does not get fewer runs in circles
            return seen.filter("_to is null").select("conv_id", "id", "to", "dist"), seen.filter("_to is not null").select("conv_id", "id")
        known, left = seen.select("conv_id", "id", F.coalesce("_to", "to").alias("to"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist")), open_


def _several_levels(waits: DataFrame, free: DataFrame) -> DataFrame:
    """``free`` (conv_id, id, level) and, with their levels, the calls that wait for several: ``waits`` is (conv_id, id, to, dist), one row
    for each way to a call of ``free``, to another of these, or to none (null). Calls on or behind a cycle are left out.

    A round for each level among themselves, and one write a round.
    """
    levels, ready = [free], free
    while True:
        met = waits.join(ready.select("conv_id", F.col("id").alias("to"), F.col("level").alias("_level")), ["conv_id", "to"], "left")
        way = F.struct("to", "dist", (F.coalesce("level", "_level") if "level" in waits.columns else F.col("_level")).alias("level"))
        calls = materialise(met.groupBy("conv_id", "id").agg(F.collect_list(way).alias("ways")), "call-several")  # no longer than its depends_on
        done = F.forall("ways", lambda w: w["level"].isNotNull())
        ready = calls.filter(done).select("conv_id", "id", (F.array_max(F.transform("ways", lambda w: w["level"] + w["dist"])) + 1).alias("level"))
        levels.append(ready)
        if len(levels) == UNITED:
            levels = [materialise(reduce(DataFrame.unionByName, levels), "call-levels")]
        waits = calls.filter(~done).select("conv_id", "id", F.inline("ways"))
        if waits.filter("level is null").join(ready.select("conv_id", F.col("id").alias("to")), ["conv_id", "to"], "left_semi").isEmpty():
            return reduce(DataFrame.unionByName, levels)


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level): 0 for calls that wait for no other, else one more than the calls they wait for.

    ``calls`` is (conv_id, id, depends_on), one row for each id. Names of calls that do not exist are ignored; calls on a cycle, and those that
    wait for one, have a null level. Chains of calls that wait for one other each are followed by doubling; calls that wait for several take
    one round for each level among themselves.
    """
    ids = calls.select("conv_id", F.col("id").alias("wanted"), F.col("id").alias("found"))
    edges = calls.select("conv_id", "id", F.explode_outer(F.array_distinct("depends_on")).alias("wanted")).join(ids, ["conv_id", "wanted"], "left")
    graph = materialise(edges.groupBy("conv_id", "id").agg(F.collect_list("found").alias("wanted")), "call-graph")  # no longer than a depends_on
    n, zero, none = F.size("wanted"), F.lit(0), F.lit(None).cast("int")
    free = graph.filter(n == 0).select("conv_id", "id", zero.alias("level"))
    if graph.filter(n > 0).isEmpty():
        return free
    ends, stuck = _chain_ends(graph.filter(n == 1).select("conv_id", "id", F.col("wanted")[0].alias("to"), F.lit(1).alias("dist")))
    # Every call by the end of its way: itself, or where its chain begins; a stuck one has no end.
    itself = graph.filter(n != 1).select("conv_id", "id", F.col("id").alias("to"), zero.alias("dist"))
    placed = itself.unionByName(ends).unionByName(stuck.select("conv_id", "id", F.lit(None).cast("string").alias("to"), none.alias("dist")))
    known, several = free, graph.filter(n > 1)
    if not several.isEmpty():
        waits = several.select("conv_id", "id", F.explode("wanted").alias("wanted")).join(placed.withColumnRenamed("id", "wanted"), ["conv_id", "wanted"])
        known = _several_levels(waits.select("conv_id", "id", "to", "dist"), free)
    levels = placed.join(known.select("conv_id", F.col("id").alias("to"), "level"), ["conv_id", "to"], "left")
    return levels.select("conv_id", "id", (F.col("level") + F.col("dist")).alias("level"))


def format_chat(messages: DataFrame, schemas: dict[str, dict[str, Any]] | None = None) -> DataFrame:
    """One row for each message: (conv_id, turn, role, anchor, slot, level, place, n_calls, n_answered, n_errors, status, message).

    ``message`` is canonical JSON: keys in order of code points, no spaces, numbers and strings as Spark's variant writes
    them, nulls left out. Sorting a conversation by (anchor, slot, level, place, turn) is a topological order: results stand right
    after the message with their call, those of calls that others wait for first. ``n_errors`` counts what
    :func:`argument_errors` finds and calls on a cycle. ``status`` of a tool message is linked, duplicate (the call was answered in an earlier
    turn), early (its turn is before the call's), orphan (no such call) or unmarked (no identifier); else it is null.
    Of calls that share an identifier in a conversation the first counts. Null conversations are one conversation each
    for linking: they link nothing. A null text is empty, a null role "unknown", a null turn sorts first; repeated rows give repeated
    rows, text that is not such JSON is content; an empty table gives an empty result; other columns are not read.
    """
    parsed = materialise(parse_messages(messages, schemas), "messages")
    exploded = parsed.filter("size(calls) > 0 and conv_id is not null").select("conv_id", "turn", "key", F.posexplode("calls").alias("place", "c"))
    first = exploded.filter("c.id is not null").groupBy("conv_id", F.col("c.id").alias("id")).agg(F.min(F.struct("turn", "key", "place", F.col("c.depends_on").alias("depends_on"))).alias("f"))
    calls = materialise(first.select("conv_id", "id", "f.turn", "f.key", "f.place", "f.depends_on"), "calls")
    levels = call_levels(calls.select("conv_id", "id", "depends_on"))
    owners = calls.select("conv_id", F.col("id").alias("call_id"), F.col("turn").alias("call_turn"), F.col("key").alias("call_key"), F.col("place").alias("call_place"))
    results = parsed.filter("call_id is not null and conv_id is not null").select("conv_id", "call_id", "turn", "key")
    answered = results.join(owners.hint("shuffle_hash"), ["conv_id", "call_id"]).filter("turn >= call_turn").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "key")).alias("answer"))
    owners = owners.join(levels.select("conv_id", F.col("id").alias("call_id"), F.col("level").alias("call_level")), ["conv_id", "call_id"])
    owners = materialise(owners.join(answered, ["conv_id", "call_id"], "left"), "answers")
    # Only messages with calls or identifiers meet the linked tables, in one join: callers what is known of their calls, results the call; the others pass by.
    caller, zero = F.size("calls") > 0, F.lit(0).cast("long")
    tally = owners.groupBy("conv_id", F.col("call_key").cast("string").alias("link")).agg(F.count("answer").alias("n_answered"), F.count_if(F.col("call_level").isNull()).alias("n_cycles"))
    facts = owners.withColumnRenamed("call_id", "link").drop("call_key").withColumn("caller", F.lit(False)).unionByName(tally.withColumn("caller", F.lit(True)), allowMissingColumns=True)
    met = parsed.filter(caller | F.col("call_id").isNotNull()).withColumn("caller", caller).withColumn("link", F.when(caller, F.col("key").cast("string")).otherwise(F.col("call_id")))
    met = met.join(facts, ["conv_id", "caller", "link"], "left")
    status = F.when(F.col("caller"), F.lit(None)).when(F.col("call_turn").isNull(), "orphan").when(F.col("turn") < F.col("call_turn"), "early").when(F.col("answer.key") == F.col("key"), "linked").otherwise("duplicate")
    linked = F.col("status").isin("linked", "duplicate")
    met = met.withColumn("status", status).select(
        *parsed.columns, F.when(linked, F.col("call_turn")).otherwise(F.col("turn")).alias("anchor"), F.when(linked, 1).otherwise(0).alias("slot"), F.when(linked, F.coalesce("call_level", F.lit(1 << 30))).otherwise(0).alias("level"),
        F.when(linked, F.col("call_place")).otherwise(0).alias("place"), F.coalesce("n_answered", zero).alias("n_answered"), F.coalesce("n_cycles", zero).alias("n_cycles"), "status",
    )
    none, plain = F.lit(0), parsed.filter(~caller & F.col("call_id").isNull())
    plain = plain.select(*parsed.columns, F.col("turn").alias("anchor"), none.alias("slot"), none.alias("level"), none.alias("place"), zero.alias("n_answered"), zero.alias("n_cycles"), F.when(F.col("role") == "tool", "unmarked").alias("status"))
    rows = plain.unionByName(met)
    errors = F.aggregate("calls", zero, lambda n, c: n + F.size(c["errors"]))
    told = F.transform("calls", lambda c: F.struct(c["arguments"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    message = F.to_json(F.struct("content", "role", F.col("call_id").alias("tool_call_id"), F.when(F.size("calls") > 0, told).alias("tool_calls")))
    return rows.select("conv_id", "turn", "role", "anchor", "slot", "level", "place", F.size("calls").cast("long").alias("n_calls"), "n_answered", (errors + F.col("n_cycles")).alias("n_errors"), "status", message.alias("message"))


def conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, messages): one JSON list for each conversation, in topological order. A conversation becomes one string, so it must fit in memory."""
    ordered = F.sort_array(F.collect_list(F.struct("anchor", "slot", "level", "place", "turn", "message")))
    return formatted.groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["message"]), ","), F.lit("]")).alias("messages"))

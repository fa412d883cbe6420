"""Operator 8: chat formatting with tool-call linking, in DataFrame operations only.

Messages are rows (conv_id, turn, role, text). An assistant's text may be a JSON object with "tool_calls", a list of objects
with an "id", a "name" and "arguments" (by themselves or as members of a "function"; arguments as an object or as its text) and
maybe "depends_on", a list of ids; a message of role "tool" is a JSON object with "tool_call_id". Calls and results meet in a
hash join by (conv_id, id). Order is topological: a result follows its call, a call follows the calls it depends on, and beyond
that the turns decide; the order is given as sortable columns (order_turn, order_slot, order_index), so no conversation is ever
gathered or sorted in one task. Arguments are checked against schemas and every message is serialised as canonical JSON: all its
members with sorted keys, no white space, the message's and the calls' own nulls left out, arguments as an object wherever they
are one, the row's role, calls in topological order.

Messages that are not special (no calls, no result) are formatted where they are read and never shuffled.

Edge cases: text that is not such JSON (or names a member twice) is plain content; null text has no content, a null role no
role; a null conv_id or id links with nothing; of several calls (results) with one id the first by turn counts, the others are
marked "duplicate"; calls in a circle of dependencies, or behind one, keep their turns and are marked "cycle"; a dependency on
an id that no call has is none; repeated rows give repeated rows; an empty table an empty result; other columns are not read.
"""
from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, rows_of, stored

#: JSON schema types and what schema_of_variant says of their values.
TYPES = {"string": r"STRING", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": r"BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": r"BOOLEAN", "array": r"ARRAY<.*", "object": r"OBJECT<.*", "null": "VOID"}


def of(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def faults(value: Column, schema: dict, path: str = "") -> list[tuple[Column, str]]:
    """(condition, name) of what may be wrong with a variant that is there, in the order in which it counts. A JSON null is no fault of type."""
    kind, name, out = F.schema_of_variant(value), path[1:], []
    there = value.isNotNull() & (kind != "VOID")
    types = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", [])
    known = [TYPES[t] for t in types if t in TYPES]
    if known:
        out.append((there & ~kind.rlike(f"^({'|'.join(known)})$"), f"type:{name}"))
    if "enum" in schema:
        out.append((there & ~F.to_json(value).isin([json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in schema["enum"]]), f"enum:{name}"))
    number, text, items = of(value, "$", "double"), F.when(kind == "STRING", F.length(of(value, "$", "string"))), F.when(kind.startswith("ARRAY"), of(value, "$", "array<variant>"))
    for key, measure, says in (("minimum", F.when(~kind.isin("STRING", "BOOLEAN"), number), "range"), ("minLength", text, "length"), ("minItems", F.size(items), "length")):
        bounds = [measure < schema[key]] if key in schema else []
        bounds += [measure > schema[key.replace("min", "max")]] if key.replace("min", "max") in schema else []
        out += [(there & F.coalesce(b, F.lit(False)), f"{says}:{name}") for b in bounds]
    if "items" in schema:
        bad = lambda e: reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c, _ in faults(e, schema["items"])], F.lit(False))
        out.append((there & F.coalesce(F.exists(items, bad), F.lit(False)), f"items:{name}"))
    for key, rule in schema.get("properties", {}).items():
        own, place = of(value, "$['" + key.replace("'", "\\'") + "']"), f"{path}.{key}"
        if key in schema.get("required", ()):
            out.append((there & own.isNull(), f"missing:{place[1:]}"))
        out += [(there & own.isNotNull() & c, says) for c, says in faults(own, rule, place)]
    if schema.get("additionalProperties", True) is False:
        keys = F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))
        extra = F.size(F.array_except(keys, F.array(*(F.lit(k) for k in schema.get("properties", {}))).cast("array<string>"))) > 0
        out.append((there & extra, f"extra:{name}" if path else "extra_argument"))
    return out


def verdict(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """'ok' or the first thing wrong with a call. schemas: tool -> JSON schema of its arguments (type, enum, bounds, items, properties, required, additionalProperties)."""
    value = F.try_parse_json(arguments)
    out = F.when(value.isNull() | ~F.schema_of_variant(value).startswith("OBJECT"), F.lit("bad_json"))
    for tool, schema in schemas.items():
        found = F.lit("ok")
        for wrong, says in reversed(faults(value, schema)):
            found = F.when(wrong, F.lit(says)).otherwise(found)
        out = out.when(name == tool, found)
    return out.otherwise(F.lit("unknown_tool"))


def text_json(c: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(c.alias("a")))
    return F.when(c.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def canonical(arguments: Column) -> Column:
    """A variant: an object, or the text of one, as that object; anything else as it is."""
    text = of(arguments, "$", "string")
    return F.coalesce(F.when(F.schema_of_variant(arguments) == "STRING", F.to_json(F.try_parse_json(text))), F.to_json(arguments))


def members(value: Column, skip: tuple[str, ...] = (), special: Callable[[Column, Column], Column] | None = None) -> Column:
    """(key, json) of an object's members that are not null."""
    entries = F.filter(F.map_entries(of(value, "$", "map<string,variant>")), lambda e: ~e["key"].isin(list(skip) or [""]) & (F.schema_of_variant(e["value"]) != "VOID"))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), (special(e["key"], e["value"]) if special else F.to_json(e["value"])).alias("json")))


def joined(found: Column) -> Column:
    """An object of (key, json), sorted by key."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(found), lambda m: F.concat(text_json(m["key"]), F.lit(":"), m["json"])), ","), F.lit("}"))


def call_json(call: Column) -> Column:
    inner = lambda key, value: F.when(key == "arguments", canonical(value)).otherwise(F.to_json(value))
    outer = lambda key, value: F.when(key == "arguments", canonical(value)).when((key == "function") & F.schema_of_variant(value).startswith("OBJECT"), joined(members(value, (), inner))).otherwise(F.to_json(value))
    return joined(members(call, (), outer))


def message(*own: tuple[str, Column], others: Column | None = None) -> Column:
    """own: members by key, left out where null."""
    found = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), c.alias("json")) for k, c in own)), lambda m: m["json"].isNotNull())
    return joined(found if others is None else F.concat(found, F.coalesce(others, F.array().cast("array<struct<key:string,json:string>>"))))


def then(first: Column, second: Column) -> Column:
    """What a call's dependency amounts to, as a function (m, k, r) of the settled (turn, level) of another call: of a turn from m on the
    same turn, k levels deeper; of an earlier turn (m, r). This is the function that goes through first, then second."""
    ahead = first["m"] >= second["m"]
    return F.struct(F.greatest(first["m"], second["m"]).alias("m"), (first["k"] + second["k"]).alias("k"), F.when(ahead, first["r"] + second["k"]).otherwise(second["r"]).alias("r"))


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, id, order_turn, level, cycle of the calls (conv_id, id, turn): a call behind others by edges (conv_id, id, needs) takes the turn of the last of them if its own is no later.

    Calls are settled once all they need are. A round also shortens what is open: an edge to a call that itself needs one other
    alone goes on to that one, with what lies between as a function, so ways along such calls halve and a chain of n takes
    log2(n) rounds; calls with several dependencies in a row take a round each. A round that settles nothing leaves circles, and
    what is behind them, however long they are.
    """
    known = calls.select("conv_id", F.col("id").alias("needs"))
    none = F.struct(F.lit(-(1 << 62)).cast("bigint").alias("m"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("r"))
    met = edges.join(known, ["conv_id", "needs"], "left_semi").join(calls.select("conv_id", "id", F.col("turn").cast("bigint").alias("turn")), ["conv_id", "id"])
    open_ = stored(met.select("conv_id", "id", "turn", "needs", none.alias("way"), F.lit(None).cast("bigint").alias("dt"), F.lit(None).cast("bigint").alias("dl")), "open")
    waiting = open_.select("conv_id", "id").distinct()
    new = stored(calls.join(waiting, ["conv_id", "id"], "left_anti").select("conv_id", "id", F.col("turn").cast("bigint").alias("order_turn"), F.lit(0).cast("bigint").alias("level")), "settled")
    settled = new
    while True:
        done = new.select("conv_id", F.col("id").alias("needs"), F.col("order_turn").alias("t"), F.col("level").alias("l"))
        late = F.col("t") >= F.col("way.m")
        told = open_.join(done, ["conv_id", "needs"], "left").select(
            "conv_id", "id", "turn", "needs", "way", F.coalesce("dt", F.when(F.col("t").isNotNull(), F.greatest("t", "way.m"))).alias("dt"), F.coalesce("dl", F.when(late, F.col("l") + F.col("way.k")).when(F.col("t").isNotNull(), F.col("way.r"))).alias("dl")
        )
        told = stored(told, "open")
        ready = told.groupBy("conv_id", "id", "turn").agg(F.count_if(F.col("dt").isNull()).alias("left"), F.max(F.struct("dt", "dl")).alias("d")).where(F.col("left") == 0)
        behind = F.col("d.dt") >= F.col("turn")
        new = stored(ready.select("conv_id", "id", F.when(behind, F.col("d.dt")).otherwise(F.col("turn")).alias("order_turn"), F.when(behind, F.col("d.dl") + 1).otherwise(0).alias("level")), "settled")
        discard(open_)
        rest = told.join(new, ["conv_id", "id"], "left_anti")
        own = F.struct(F.col("turn").alias("m"), F.lit(1).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("r"))
        alone = rest.groupBy("conv_id", "id").agg(F.count("*").alias("n"), F.count("dt").alias("told"), F.any_value("needs").alias("on"), F.any_value(then(F.col("way"), own)).alias("by")).where("n = 1 and told = 0")
        on = rest.join(alone.select("conv_id", F.col("id").alias("needs"), "on", "by"), ["conv_id", "needs"], "left")
        jump = F.col("on").isNotNull() & F.col("dt").isNull()
        open_ = stored(on.select("conv_id", "id", "turn", F.when(jump, F.col("on")).otherwise(F.col("needs")).alias("needs"), F.when(jump, then(F.col("by"), F.col("way"))).otherwise(F.col("way")).alias("way"), "dt", "dl"), "open")
        discard(told)
        if not rows_of(new):
            break
        settled = settled.union(new)
    circle = calls.join(open_.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_semi").select("conv_id", "id", F.col("turn").cast("bigint").alias("order_turn"), F.lit(0).cast("bigint").alias("level"), F.lit(True).alias("cycle"))
    return settled.withColumn("cycle", F.lit(False)).union(circle)


def format_chats(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, turn, order_turn, order_slot, order_index, role, link, n_calls, n_valid, call_status, message_json: one row per message."""
    rows = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    like = F.ltrim(F.coalesce("text", F.lit(""))).startswith("{") & (((F.col("role") == "assistant") & F.col("text").contains('"tool_calls"')) | ((F.col("role") == "tool") & F.col("text").contains('"tool_call_id"')))
    rows = rows.withColumn("v", F.when(like, F.try_parse_json("text")))
    rows = rows.withColumn("calls", F.when(F.col("role") == "assistant", of(F.col("v"), "$.tool_calls", "array<variant>")))
    rows = rows.withColumn("answers", F.when(F.col("role") == "tool", of(F.col("v"), "$.tool_call_id", "string")))
    is_call, is_result = F.coalesce(F.size("calls") > 0, F.lit(False)), F.col("answers").isNotNull()
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")
    content, role = F.when(F.schema_of_variant(of(F.col("v"), "$.content")) != "VOID", F.to_json(of(F.col("v"), "$.content"))), text_json(F.col("role"))
    plain = rows.where(~is_call & ~is_result).select(
        "conv_id", "turn", F.col("turn").alias("order_turn"), F.lit(0).alias("order_slot"), zero.alias("order_index"), "role", F.lit("plain").alias("link"), F.lit(0).alias("n_calls"), F.lit(0).alias("n_valid"),
        none.alias("call_status"), message(("content", text_json(F.col("text"))), ("role", role)).alias("message_json"),
    )
    rows = rows.withColumn("m", F.xxhash64("role", "text"))
    callers, answers = rows.where(is_call), rows.where(is_result)
    call = F.col("c")
    calls = callers.select("conv_id", "turn", "m", F.posexplode("calls").alias("i", "c"))
    calls = calls.select(
        "conv_id", "turn", "m", F.col("i").cast("bigint").alias("i"), of(call, "$.id", "string").alias("id"), F.coalesce(of(call, "$.name", "string"), of(call, "$.function.name", "string")).alias("name"),
        F.coalesce(of(call, "$.arguments", "string"), of(call, "$.function.arguments", "string")).alias("arguments"), of(call, "$.depends_on", "array<string>").alias("depends_on"), call_json(call).alias("json"),
    )
    calls = stored(calls, "calls", dependent=F.count_if(F.size("depends_on") > 0))
    results = stored(answers.select("conv_id", "turn", "m", F.col("answers").alias("id"), message(("content", content), ("role", role), others=members(F.col("v"), ("content", "role"))).alias("json")), "results")
    first_call = calls.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "m", "i")).alias("call"))
    first_result = results.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "m")).alias("result"))
    link = first_call.where("conv_id is not null and id is not null").join(first_result, ["conv_id", "id"], "left")
    if calls._tidemill_seen.get("dependent", 1):
        own = calls.join(first_call, ["conv_id", "id"]).where("call = struct(turn, m, i)")
        edges = own.select("conv_id", "id", F.explode("depends_on").alias("needs")).distinct()
        order = levels(link.select("conv_id", "id", F.col("call.turn").alias("turn")), edges)
        link = link.join(order, ["conv_id", "id"], "left")
    else:
        link = link.withColumns({"order_turn": F.col("call.turn"), "level": zero, "cycle": F.lit(False)})
    link = stored(link, "links")
    met = calls.join(link, ["conv_id", "id"], "left").withColumn("own", F.coalesce(F.col("call") == F.struct("turn", "m", "i"), F.lit(False)))
    linkable = F.col("id").isNotNull() & F.col("conv_id").isNotNull()
    status = F.when(~linkable, "no_id").when(~F.col("own"), "duplicate").when(F.col("cycle"), "cycle").when(F.col("result").isNull(), "unanswered").otherwise("linked")
    behind = lambda c, other: F.when(F.col("own"), F.col(c)).otherwise(other)
    one_call = F.struct(F.coalesce(behind("level", zero), zero).alias("level"), "i", "json", status.alias("status"), verdict(F.col("name"), F.col("arguments"), schemas or {}).alias("verdict"), F.coalesce(behind("order_turn", F.col("turn")), "turn").alias("order_turn"))
    # The calls of one message come together again: as many as its own text holds. Repeated rows give equal entries.
    grouped = met.groupBy("conv_id", "turn", "m").agg(F.array_sort(F.collect_set(one_call)).alias("found"))
    same = [callers[c].eqNullSafe(grouped[c]) for c in ("conv_id", "turn", "m")]
    each = lambda field: F.transform("found", lambda c: c[field])
    called = callers.join(grouped, same[0] & same[1] & same[2]).select(
        callers["conv_id"], callers["turn"], F.array_max(each("order_turn")).alias("order_turn"), F.lit(0).alias("order_slot"), F.array_max(each("level")).alias("order_index"), "role", F.lit("call").alias("link"), F.size("found").alias("n_calls"),
        F.size(F.filter("found", lambda c: c["verdict"] == "ok")).alias("n_valid"), F.array_join(F.transform("found", lambda c: F.concat(c["status"], F.lit("/"), c["verdict"])), ",").alias("call_status"),
        message(("content", content), ("role", role), ("tool_calls", F.concat(F.lit("["), F.array_join(each("json"), ","), F.lit("]"))), others=members(F.col("v"), ("content", "role", "tool_calls"))).alias("message_json"),
    )
    answered = results.join(link, ["conv_id", "id"], "left").withColumn("own", F.coalesce(F.col("result") == F.struct("turn", "m"), F.lit(False)))
    linked = F.col("call").isNotNull() & F.col("own")
    answered = answered.select(
        "conv_id", "turn", F.when(linked, F.greatest(F.col("turn"), F.col("order_turn"))).otherwise(F.col("turn")).alias("order_turn"), F.when(linked, 1).otherwise(0).alias("order_slot"),
        F.when(linked, F.col("level") * (1 << 32) + F.col("call.i")).otherwise(zero).alias("order_index"), F.lit("tool").alias("role"),
        F.when(F.col("call").isNull(), "orphan").when(~F.col("own"), "duplicate").otherwise("linked").alias("link"), F.lit(0).alias("n_calls"), F.lit(0).alias("n_valid"), none.alias("call_status"), F.col("json").alias("message_json"),
    )
    return plain.unionByName(called).unionByName(answered)

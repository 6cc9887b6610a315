"""Tool calls of conversations: linked, ordered, validated, serialised.

Calls and results are tables. A hash join on (conversation, call id) links them;
ids used twice, results without a call and calls without a result are marked.
Calls name the calls that they need; they are ordered so that each comes after
those, by doubling pointers along chains and removing in rounds the calls whose
several needs are met; what never gets free is on a cycle or needs one, or needs
an unknown call. Arguments are checked against a table of parameters.
JSON is parsed to variants, which keep keys sorted, so that writing them gives
one canonical text for equal values.

All of it is Spark expressions; keys are (conversation, id) pairs, counts are
combined before they are shuffled, and rounds are cut by tables in the shared
folder.

Defined cases: a null conversation or call id makes a call that links with
nothing and is invalid; arguments that are null or no JSON object are invalid
and written as null; repeated calls of an id are all kept and marked; results
that repeat are counted, the earliest is linked; results whose conversation or
call id is null or unknown are rows of their own (`link_all`); empty tables give empty tables.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.tables import stored, unused_name

#: The least kind of variant that a parameter type admits, as a pattern on its schema.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<"}


def canonical(text: Column) -> Column:
    """Compact JSON with sorted keys; null where the text is none."""
    return F.to_json(F.try_parse_json(text))


def ordered(calls: DataFrame) -> DataFrame:
    """Adds `level`: 0 for calls without needs, else one more than the highest level needed; null where there is none.

    A call with one need is as many levels above the first call without or with several needs as there are links between
    them: pointers along such chains are doubled, in as many rounds as the logarithm of the number of calls. Calls with
    several needs, in terms of the ends of these chains, are then freed in rounds.
    """
    key = ["conv_id", "call_id"]
    nodes = calls.where("conv_id is not null and call_id is not null").select(*key).distinct()
    needs = calls.select(*key, F.explode_outer("needs").alias("need")).where("need is not null and conv_id is not null and call_id is not null").distinct()
    degree = nodes.join(needs.groupBy(*key).agg(F.count("*").alias("n"), F.min("need").alias("only")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    degree = stored(degree, "needs")
    # end: where a call's pointer leads; open while that is a call with one need itself.
    chains = stored(degree.select(*key, F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("call_id")).alias("end"), F.when(F.col("n") == 1, 1).otherwise(0).alias("steps"), (F.col("n") == 1).alias("open")), "chains")
    rounds = int(chains.count()).bit_length() + 1
    while rounds and chains.where("open").head(1):
        rounds -= 1
        onward = chains.select("conv_id", F.col("call_id").alias("end"), F.col("end").alias("next"), F.col("steps").alias("more"), F.col("open").alias("still"))
        chains = chains.join(onward, ["conv_id", "end"], "left")
        chains = stored(chains.select(*key, F.when(F.col("open"), F.col("next")).otherwise(F.col("end")).alias("end"), (F.col("steps") + F.when(F.col("open"), F.coalesce("more", F.lit(0))).otherwise(0)).alias("steps"), (F.col("open") & F.coalesce("still", F.lit(False))).alias("open")), "chains")
    # Chains that never end are cycles; those that lead nowhere need an unknown call.
    chains = chains.where("not open and end is not null").select(*key, "end", "steps")

    done = stored(degree.where("n = 0").select(*key, F.lit(0).alias("level")), "levels")
    several = needs.join(degree.where("n > 1").select(*key), key, "left_semi")
    via = chains.select("conv_id", F.col("call_id").alias("need"), "end", "steps")
    open_ = stored(several.join(via, ["conv_id", "need"], "left").select(*key, F.col("end").alias("need"), "steps"), "needs")
    known = done
    while True:
        met = known.select("conv_id", F.col("call_id").alias("need"), "level")
        marked = open_.join(met, ["conv_id", "need"], "left").groupBy(*key).agg(F.count_if(F.col("level").isNull()).alias("left"), (F.max(F.col("level") + F.col("steps")) + 1).alias("level"))
        free = stored(marked.where("left = 0").select(*key, F.col("level").cast("int").alias("level")), "levels")
        if not free.head(1):
            break
        known = known.union(free)
        open_ = stored(open_.join(free.select(*key), key, "left_anti"), "needs")
    ends = known.select("conv_id", F.col("call_id").alias("end"), F.col("level").alias("base"))
    levels = chains.join(ends, ["conv_id", "end"]).select(*key, (F.col("base") + F.col("steps")).cast("int").alias("level"))
    return calls.join(levels, key, "left")


def argument_faults(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """Adds `faults` to rows with tool and arguments (JSON text): what is wrong with the arguments, sorted, without repeats.

    `parameters` has tool, name, type and required. Those of a tool are joined to its calls as one list, so a call is checked where it is.
    """
    known, listed, given = (unused_name(n, calls.columns) for n in ("known_tool", "listed", "given"))
    spec = F.struct("name", "type", F.coalesce("required", F.lit(False)).alias("required"))
    tools = parameters.where("tool is not null").groupBy(F.col("tool").alias(known)).agg(F.collect_set(F.when(F.col("name").isNotNull(), spec)).alias(listed))
    rows = calls.withColumn(given, F.try_parse_json("arguments")).join(tools, F.col("tool") == F.col(known), "left")
    kinds = F.map_entries(F.try_variant_get(given, "$", "map<string, variant>"))
    kinds = F.transform(kinds, lambda e: F.struct(e["key"].alias("name"), F.schema_of_variant(e["value"]).alias("kind")))
    fits = lambda s, kind: reduce(operator.or_, [(s["type"] == name) & kind.rlike(pattern) for name, pattern in TYPES.items()])
    of = lambda e: F.filter(listed, lambda s: s["name"] == e["name"])
    stray = lambda e: F.filter(F.array(F.concat(e["name"], F.lit(": not a parameter"))), lambda _: F.size(of(e)) == 0)
    wrong = lambda e: F.transform(F.filter(of(e), lambda s: s["type"].isNotNull() & ~fits(s, e["kind"])), lambda s: F.concat(e["name"], F.lit(": no "), s["type"]))
    untyped = lambda e: F.transform(F.filter(of(e), lambda s: s["type"].isNull()), lambda s: F.concat(e["name"], F.lit(": not a parameter")))
    missing = F.transform(F.filter(listed, lambda s: s["required"] & ~F.exists(kinds, lambda e: e["name"] == s["name"])), lambda s: F.concat(s["name"], F.lit(": missing")))
    no_object, no_tool = F.coalesce(~F.schema_of_variant(given).startswith("OBJECT<"), F.lit(True)), F.col(known).isNull()
    none = F.array().cast("array<string>")
    checked = F.when(no_object | no_tool, none).otherwise(F.concat(F.flatten(F.transform(kinds, lambda e: F.concat(stray(e), wrong(e), untyped(e)))), missing))
    shape = F.when(no_object, F.array(F.lit("arguments: no object"))).otherwise(none)
    tool = F.when(no_tool, F.array(F.lit("tool: unknown"))).otherwise(none)
    return rows.withColumn("faults", F.array_sort(F.array_distinct(F.concat(shape, tool, checked)))).drop(known, listed, given)


def link_calls(calls: DataFrame, results: DataFrame, parameters: DataFrame) -> DataFrame:
    """One row for each call, with its result, place, faults and canonical JSON.

    `calls`: conv_id, call_id, turn, tool, arguments (JSON text), needs (array of call ids).
    `results`: conv_id, call_id, turn, content. `parameters`: tool, name, type, required.
    Adds repeated, result_turn, results, level, place (from 1 in a conversation; null with level), faults, record.
    """
    key = ["conv_id", "call_id"]
    answers = results.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("answer"), F.count("*").alias("results"))
    uses = calls.groupBy(*key).count().where("count > 1").select(*key, F.lit(True).alias("repeated"))
    rows = argument_faults(ordered(calls), parameters)
    linked = rows.join(answers, key, "left").join(uses, key, "left")
    after = F.struct("level", "turn", "call_id")
    places = linked.where("level is not null").select("conv_id", after.alias("after")).distinct()
    places = ranked(places)
    linked = linked.withColumn("after", after).join(places, ["conv_id", "after"], "left")
    alone = F.col("conv_id").isNull() | F.col("call_id").isNull()
    out = linked.select(
        "conv_id", "call_id", "turn", "tool", "arguments", "needs",
        F.coalesce("repeated", F.lit(False)).alias("repeated"),
        F.col("answer.turn").alias("result_turn"), F.col("answer.content").alias("content"), F.coalesce("results", F.lit(0)).alias("results"),
        "level", "place",
        F.when(alone, F.array_append("faults", F.lit("call: no id"))).otherwise(F.col("faults")).alias("faults"),
    )
    fields = {"arguments": canonical(F.col("arguments")), "id": F.to_json(F.struct("call_id")), "name": F.col("tool"), "result": F.col("content")}
    return out.withColumn("record", record_of(fields))


def lost_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that no call asked for, each with a fault, in the columns of `link_calls`; those of a call are null."""
    key = ["conv_id", "call_id"]
    asked = calls.where("conv_id is not null and call_id is not null").select(*key).distinct()
    lost = results.join(asked, key, "left_anti")
    alone = F.col("conv_id").isNull() | F.col("call_id").isNull()
    fields = {"arguments": F.lit(None).cast("string"), "id": F.to_json(F.struct("call_id")), "name": F.lit(None).cast("string"), "result": F.col("content")}
    none = lambda kind: F.lit(None).cast(kind)
    return lost.select(
        *key, none("long").alias("turn"), none("string").alias("tool"), none("string").alias("arguments"), none("array<string>").alias("needs"),
        F.lit(False).alias("repeated"), F.col("turn").alias("result_turn"), "content", F.lit(1).cast("long").alias("results"),
        none("int").alias("level"), none("int").alias("place"),
        F.array(F.when(alone, F.lit("result: no id")).otherwise(F.lit("result: no call"))).alias("faults"),
        record_of(fields).alias("record"),
    )


def link_all(calls: DataFrame, results: DataFrame, parameters: DataFrame) -> DataFrame:
    """One row for each call, as of `link_calls`, and one for each result without a call."""
    return link_calls(calls, results, parameters).unionByName(lost_results(calls, results))


def ranked(places: DataFrame) -> DataFrame:
    """Numbers the calls of each conversation by (level, turn, id): a window over the calls of one conversation."""
    from pyspark.sql.window import Window

    return places.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("after")).cast("int"))


def record_of(fields: dict[str, Column]) -> Column:
    """Canonical JSON of a call and its result: keys sorted, no spaces."""
    return canonical(
        F.concat(
            F.lit('{"arguments":'), F.coalesce(fields["arguments"], F.lit("null")),
            F.lit(',"call":'), fields["id"],
            F.lit(',"answer":'), F.to_json(F.struct(fields["result"].alias("text"), fields["name"].alias("tool"))),
            F.lit("}"),
        )
    )


def calls_in(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that conversations hold as JSON lines.

    A line of an assistant `{"call": id, "tool": name, "arguments": {...}, "needs": [ids]}` is a call; a line of a tool or
    user `{"result": id, "content": text}` is a result.
    """
    lines = messages.where(F.col("text").contains('"call"') | F.col("text").contains('"result"')).select("conv_id", "turn", "role", F.explode(F.split("text", "\n")).alias("line"))
    v = F.try_parse_json("line")
    parsed = lines.select("conv_id", "turn", "role", v.alias("v")).where("v is not null")
    calls = parsed.where("role = 'assistant'").select(
        "conv_id", F.try_variant_get("v", "$.call", "string").alias("call_id"), "turn", F.try_variant_get("v", "$.tool", "string").alias("tool"),
        F.to_json(F.try_variant_get("v", "$.arguments", "variant")).alias("arguments"), F.try_variant_get("v", "$.needs", "array<string>").alias("needs"),
    ).where("call_id is not null")
    # A result may name no call (JSON null): it is lost, but a row.
    results = parsed.where((F.col("role") != "assistant") & F.try_variant_get("v", "$.result", "variant").isNotNull()).select("conv_id", F.try_variant_get("v", "$.result", "string").alias("call_id"), "turn", F.try_variant_get("v", "$.content", "string").alias("content"))
    return calls, results


def calls_of_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations read as calls: a user's turn asks the tool `reply`, the turn after it is the result.

    Each call needs the one two turns before it. A turn without text or words gives a call that lacks arguments, which is a fault. This gives a table of plain conversations the form that `link_calls` takes.
    """
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    arguments = F.to_json(F.struct(F.size(words).alias("words"), F.get(words, F.lit(0)).alias("first"), F.length("text").alias("chars"), F.concat_ws(" ", F.slice(words, 1, 5)).alias("about")), {"ignoreNullFields": "true"})
    name = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    users = messages.where("role = 'user'")
    calls = users.select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("tool"), arguments.alias("arguments"), F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("needs"))
    results = messages.where("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


#: The parameters of the tool that calls_of_turns asks.
REPLY = (("reply", "words", "integer", True), ("reply", "first", "string", True), ("reply", "chars", "integer", True), ("reply", "about", "string", False))


def reply_parameters(spark) -> DataFrame:
    return spark.createDataFrame(list(REPLY), "tool string, name string, type string, required boolean")

"""Linking tool calls to their results (built-in functions only).

Calls and results are hash-joined by conversation and identifier (the hash tables hold calls, one an identifier, a
partition of them at a time); calls are put in topological order by following ``after`` (the latest call whose result a call may use) with doubling strides, so a
conversation of n turns needs log2(n) joins; arguments are checked against the tool's schema; and each
call with its result is written as canonical JSON: keys sorted, no white space, as Spark's VARIANT has it.

Defined cases: a call without result is ``pending`` and a result without call an ``orphan`` (its call columns
are null), each such result a row; of several results of a call the one with the lowest position, then the least content, counts;
of several calls with one identifier likewise, by position and then arguments, and the others are marked
``repeated``; an ``after`` that names no call counts as none; calls that depend on themselves in a circle
are ``cyclic`` and have no level; null identifiers link to nothing; arguments that are null or no JSON
object, or that repeat a key, are invalid and null in the JSON; tools without a schema make a call invalid; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import materialise

CALLS = "conv_id LONG, call_id STRING, position LONG, name STRING, arguments STRING, after STRING"
RESULTS = "conv_id LONG, call_id STRING, position LONG, content STRING"
#: kind: string, integer, number, boolean, array or object; least and most bound a number or a string's length.
PARAMETERS = "name STRING, parameter STRING, kind STRING, required BOOLEAN, least DOUBLE, most DOUBLE"
#: Tools whose schemas are broadcast.
BROADCAST_TOOLS = 10_000


def canonical(json: Column) -> Column:
    """Canonical text of a JSON value; null if it isn't one."""
    return F.to_json(F.try_parse_json(json))


def _kind(value: Column) -> Column:
    name = F.schema_of_variant(value)
    whole = name.isin("BIGINT") | name.rlike(r"^DECIMAL\(\d+,0\)$")
    return (
        F.when(name == "STRING", "string").when(whole, "integer").when(name.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(name == "BOOLEAN", "boolean").when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").otherwise("null")
    )


def errors(arguments: Column, parameters: Column) -> Column:
    """What is wrong with ``arguments`` (JSON text) by ``parameters`` (an array of PARAMETERS less the name)."""
    values = F.from_json(arguments, "map<string,string>")
    kinds = F.try_parse_json(arguments).cast("map<string,variant>")

    def check(p: Column) -> Column:
        text, kind = F.element_at(values, p["parameter"]), _kind(F.element_at(kinds, p["parameter"]))
        fits = (kind == p["kind"]) | ((kind == "integer") & (p["kind"] == "number"))
        number = F.when(p["kind"] == "string", F.length(text).cast("double")).when(p["kind"].isin("integer", "number"), text.try_cast("double"))
        return (
            F.when(~F.map_contains_key(kinds, p["parameter"]), F.when(p["required"], F.concat(F.lit("missing "), p["parameter"])))
            .when(~fits, F.concat(F.lit("not "), p["kind"], F.lit(" "), p["parameter"]))
            .when((number < p["least"]) | (number > p["most"]), F.concat(F.lit("out of range "), p["parameter"]))
        )

    own = F.filter(F.transform(parameters, check), lambda e: e.isNotNull())
    names = F.transform(parameters, lambda p: p["parameter"])
    extra = F.transform(F.array_sort(F.array_except(F.map_keys(values), names)), lambda k: F.concat(F.lit("unknown "), k))
    is_object = F.schema_of_variant(F.try_parse_json(arguments)).startswith("OBJECT")
    return (
        F.when(~F.coalesce(is_object, F.lit(False)), F.array(F.lit("no object")))
        .when(parameters.isNull(), F.array(F.lit("no schema")))
        .otherwise(F.concat(own, extra))
    )


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of ``calls(conv_id, call_id, after)``, whose identifiers are unique; cyclic ones have none."""
    known = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    state = materialise(
        calls.join(known, ["conv_id", "after"], "left").select(
            "conv_id", "call_id", F.when(F.col("known"), F.col("after")).alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("level")
        ),
        "levels",
    )
    most = max(1, state.count()).bit_length() + 1
    for _ in range(most):
        if not state.filter("up is not null").limit(1).count():
            break
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("level").alias("more"), F.col("up").alias("next"))
        state = materialise(
            state.join(above, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")),
            "levels",
        )
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link(calls: DataFrame, results: DataFrame, parameters: DataFrame) -> DataFrame:
    """One row per call and per orphaned result: conv_id, call_id, position, level, status, valid, errors, json."""
    table = parameters.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("parameter", "kind", "required", "least", "most"))).alias("parameters"))
    if parameters.select("name").distinct().count() <= BROADCAST_TOOLS:
        table = F.broadcast(table)
    nth = Window.partitionBy("conv_id", "call_id").orderBy("position", "arguments")
    # Rows of an identifier are few unless it is repeated; null identifiers are set apart first.
    named = calls.filter("call_id is not null and conv_id is not null").withColumn("nth", F.row_number().over(nth))
    first = materialise(named.filter("nth = 1").drop("nth"), "calls")
    ids = first.select("conv_id", "call_id", F.lit(True).alias("known"))
    met = materialise(results.join(ids.hint("shuffle_hash"), ["conv_id", "call_id"], "left"), "results")
    answer = (
        met.filter("known").groupBy("conv_id", "call_id").agg(F.min(F.struct("position", "content")).alias("r"))
        .select("conv_id", "call_id", F.col("r.content").alias("content"), F.lit(True).alias("answered"), F.col("r.position").alias("answered_at"))
    )
    # Each result without a call is a row of its own; null identifiers name no call.
    orphans = met.filter("known IS NULL").select("conv_id", "call_id", "content", F.lit(True).alias("answered"), F.col("position").alias("answered_at"))
    linked = first.withColumn("called", F.lit(True)).join(answer.hint("shuffle_hash"), ["conv_id", "call_id"], "left").unionByName(orphans, allowMissingColumns=True)
    others = named.filter("nth > 1").drop("nth").unionByName(calls.filter("call_id is null or conv_id is null"))
    rows = linked.unionByName(others.withColumn("repeated", F.lit(True)), allowMissingColumns=True)
    out = rows.join(table, "name", "left").join(levels(first), ["conv_id", "call_id"], "left")
    wrong = errors(F.col("arguments"), F.col("parameters"))
    is_call = F.col("called").isNotNull() | F.col("repeated").isNotNull()
    status = (
        F.when(F.col("repeated"), "repeated").when(F.col("called").isNull(), "orphan").when(F.col("level").isNull(), "cyclic")
        .when(F.col("answered"), "linked").otherwise("pending")
    )
    body = F.to_json(F.struct("call_id", "name", F.col("content").alias("result")), {"ignoreNullFields": "false"})
    whole = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")), F.lit(","), F.substring(canonical(body), 2, 1 << 30))
    return out.withColumn("wrong", F.when(is_call, wrong)).select(
        "conv_id",
        "call_id",
        F.coalesce("position", "answered_at").alias("position"),
        F.when(F.col("repeated").isNull(), F.col("level")).alias("level"),
        status.alias("status"),
        (F.size("wrong") == 0).alias("valid"),
        F.array_join("wrong", "; ").alias("errors"),
        whole.alias("json"),
    )


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as calls of one tool, ``reply``: a user's turn calls it, the assistant's next turn is the result."""
    ident = lambda t: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r\f]+"), lambda w: w != ""))
    arguments = F.to_json(F.struct("turn", F.col("text").alias("prompt"), words.alias("n_words")), {"ignoreNullFields": "false"})
    order = Window.partitionBy("conv_id").orderBy("turn")
    before = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    seen = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").withColumn("before", before)
    calls = seen.filter("role = 'user'").select(
        "conv_id", ident(F.col("turn")).alias("call_id"), F.col("turn").alias("position"), F.lit("reply").alias("name"), arguments.alias("arguments"), ident(F.col("before")).alias("after")
    )
    results = seen.filter("role = 'assistant'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    return calls, results


def reply_schema(spark: SparkSession) -> DataFrame:
    rows = [("reply", "prompt", "string", True, 1.0, 100_000.0), ("reply", "turn", "integer", True, 0.0, None), ("reply", "n_words", "integer", True, 1.0, 60.0)]
    return spark.createDataFrame(rows, PARAMETERS)

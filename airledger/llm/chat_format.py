"""Operator 3: tool-call linking, in DataFrame functions.

Calls and results are hash-joined by identifier, ordered topologically by the call
each depends on, validated against the schema of the tool's name, and written as
canonical JSON: keys in order, no spaces. Depths come from pointer doubling: each
round a call adds the depth of the call it points to and points to where that one
points, so a chain of n calls takes log2(n) rounds and no conversation is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Types a schema may ask for, and the types of a parsed value that fit.
FITS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def depths(calls: DataFrame) -> DataFrame:
    """``call_id, depth`` of distinct ``call_id, parent_id``: 0 without a present parent; null on or below a cycle."""
    known = calls.select("call_id").distinct()
    step = durable(
        calls.groupBy("call_id").agg(F.min("parent_id").alias("parent_id"))
        .join(known.select(F.col("call_id").alias("parent_id"), F.lit(1).alias("there")), "parent_id", "left")
        .select("call_id", F.when(F.col("there") == 1, F.col("parent_id")).alias("up"), F.coalesce("there", F.lit(0)).cast("long").alias("depth"))
    )
    rounds, most = 0, max(1, step.count()).bit_length() + 1
    while rounds < most and not step.where("up is not null").isEmpty():
        above = step.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        step = durable(
            step.join(above, "up", "left").select("call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        )
        rounds += 1
    return step.select("call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted messages: of a schema {field: (type, required)}, what is missing, of another type or unknown."""
    found = F.array(F.lit("unknown tool"))
    for tool, fields in sorted(schemas.items()):
        tests = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(arguments, f"$.{field}", "variant")
            shape = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
            tests.append(F.when(value.isNull(), F.lit(f"{field}: missing") if required else F.lit(None).cast("string")).when(~shape.rlike(f"^({FITS[kind]})$"), F.lit(f"{field}: not {kind}")))
        keys = F.coalesce(F.json_object_keys(F.to_json(arguments)), F.array().cast("array<string>"))
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, sorted(fields))) if fields else F.array().cast("array<string>")), lambda k: F.concat(k, F.lit(": unknown")))
        own = F.array_sort(F.concat(F.filter(F.array(*tests) if tests else F.array().cast("array<string>"), lambda e: e.isNotNull()), extra))
        found = F.when(name == tool, own).otherwise(found)
    return F.when(arguments.isNull() | ~F.coalesce(F.schema_of_variant(arguments), F.lit("VOID")).startswith("OBJECT"), F.array(F.lit("arguments: no object"))).otherwise(found)


def _json(value: Column) -> Column:
    """A string as JSON, null as null."""
    written = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(written, F.lit(2), F.length(written) - 2))


def _content(kind: str, *columns: str) -> Column:
    """What tells two rows of a kind apart; to_json leaves nulls out but names the rest."""
    return F.sha2(F.to_json(F.struct(F.lit(kind).alias("kind"), *columns)), 256)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]], contexts: DataFrame | None = None) -> DataFrame:
    """``call_id, status, depth, errors, context, line`` of every call, result and context.

    ``calls(call_id, parent_id, name, arguments)``, ``results(call_id, output)``,
    ``contexts(call_id, context)``, all strings. Of several calls (results, contexts) of
    one id the least is linked, and ``n_calls`` (``n_results``, ``n_context``) is the
    number of all; every other text of the id has a row of its own, where the number is
    that of its copies. These rows are shuffled by their content, not by their id, so a
    hot id is spread. Status: ``linked``, ``unanswered``, ``orphan`` for a result without a
    call, ``context`` for one with neither, ``repeat`` for the other rows of an id; rows
    without an id are linked to nothing. Malformed arguments are an error and stand as
    null in the line. A repeat has no depth.
    """
    if contexts is None:
        contexts = calls.sparkSession.createDataFrame([], "call_id string, context string")
    text = lambda c: F.lit(None).cast("string").alias(c)
    called = calls.groupBy("call_id").agg(F.min(F.struct("name", "arguments", "parent_id")).alias("c"), F.count("*").alias("n_calls"))
    both_kinds = results.select(F.col("call_id").alias("result_id"), "output", text("context"), F.lit(True).alias("answer")).unionByName(
        contexts.select(F.col("call_id").alias("result_id"), text("output"), "context", F.lit(False).alias("answer"))
    )
    apart = F.when(F.col("result_id").isNull(), F.col("answer")).alias("_apart")  # without an id nothing belongs together
    given = both_kinds.groupBy("result_id", apart).agg(F.min("output").alias("output"), F.min("context").alias("context"), F.count_if("answer").alias("n_results"), F.count_if(~F.col("answer")).alias("n_context")).drop("_apart")
    both = called.join(given, F.col("call_id") == F.col("result_id"), "full_outer")
    both = both.join(depths(calls.where("call_id is not null")).withColumnRenamed("call_id", "deep_id"), F.col("call_id") == F.col("deep_id"), "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    first = both.select(
        F.coalesce("call_id", "result_id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), "output", "context", "depth", number("n_calls"), number("n_results"), number("n_context"),
    )
    main = F.when((F.col("n_calls") > 0) & (F.col("n_results") > 0), "linked").when(F.col("n_calls") > 0, "unanswered").when(F.col("n_results") > 0, "orphan").otherwise("context")
    # All rows by content, without those that were linked.
    call, answer, about = (_content("call", "call_id", "name", "arguments", "parent_id"), _content("result", "call_id", "output"), _content("context", "call_id", "context"))
    items = calls.select(call.alias("h"), F.lit("n_calls").alias("kind"), "call_id", "name", "arguments", text("output"), text("context"))
    items = items.unionByName(results.select(answer.alias("h"), F.lit("n_results").alias("kind"), "call_id", text("name"), text("arguments"), "output", text("context")))
    items = items.unionByName(contexts.select(about.alias("h"), F.lit("n_context").alias("kind"), "call_id", text("name"), text("arguments"), text("output"), "context"))
    taken = called.select("call_id", "c.*").select(call.alias("h")).unionByName(given.withColumnRenamed("result_id", "call_id").select(F.explode(F.array(F.when(F.col("n_results") > 0, answer), F.when(F.col("n_context") > 0, about))).alias("h")))
    rest = _of_many(items, calls, results, contexts).groupBy("h").agg(*[F.first(c).alias(c) for c in items.columns[1:]], F.count("*").alias("n")).join(taken, "h", "left_anti")
    alone = F.when(F.col("n_calls") > 0, "unanswered").when(F.col("n_results") > 0, "orphan").otherwise("context")
    rest = rest.select(*first.columns[:5], F.lit(None).cast("long").alias("depth"), *[F.when(F.col("kind") == c, F.col("n")).otherwise(0).alias(c) for c in ("n_calls", "n_results", "n_context")])
    out = rest.withColumn("status", F.when(F.col("call_id").isNotNull(), "repeat").otherwise(alone)).unionByName(first.withColumn("status", main))
    out = out.withColumn("arguments", F.try_parse_json("arguments"))
    wrong = F.when(F.col("n_calls") == 0, F.array().cast("array<string>")).otherwise(errors(F.col("name"), F.col("arguments"), schemas))
    line = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("arguments"), F.lit("null")), F.lit(',"call_id":'), _json(F.col("call_id")),
        F.lit(',"depth":'), F.coalesce(F.col("depth").cast("string"), F.lit("null")), F.lit(',"name":'), _json(F.col("name")),
        F.lit(',"output":'), _json(F.col("output")), F.lit(',"status":'), _json(F.col("status")), F.lit("}"),
    )
    return out.withColumn("errors", wrong).select("call_id", "name", "status", "depth", "n_calls", "n_results", "n_context", "errors", "context", line.alias("line"))


#: Ids with several rows of a kind that are broadcast, at most; more are joined by a shuffle.
MANY = 1_000_000


def _of_many(items: DataFrame, *kinds: DataFrame) -> DataFrame:
    """The rows without an id and those of an id that several rows of one kind have; ids alone are shuffled to find them."""
    ids = kinds[0].select(F.lit(0).alias("kind"), "call_id")
    for k, df in enumerate(kinds[1:], 1):
        ids = ids.unionByName(df.select(F.lit(k).alias("kind"), "call_id"))
    many = durable(ids.where("call_id is not null").groupBy("kind", "call_id").agg(F.count("*").alias("n")).where("n > 1").select("call_id").distinct())
    several = items.join(F.broadcast(many) if many.count() <= MANY else many, "call_id", "left_semi")
    return items.where("call_id is null").unionByName(several.select(items.columns))


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and contexts of ``messages(conv_id, turn, role, text)``.

    A user's turn calls the tool ``reply`` with its text, its length and its place, and
    depends on the user's turn two before; the assistant's next turn is the result. A
    turn of any other role, or of none, is the context of the call in the next turn, as
    JSON of its role and text.
    """
    ident = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    at = F.col("turn").cast("long")
    there = F.col("conv_id").isNotNull() & at.isNotNull()
    arguments = F.to_json(F.struct(F.col("text").alias("text"), F.length("text").alias("n_chars"), at.alias("turn")))
    calls = messages.where(F.col("role") == "user").select(
        F.when(there, ident(at)).alias("call_id"), F.when(there, ident(at - 2)).alias("parent_id"), F.lit("reply").alias("name"), arguments.alias("arguments")
    )
    results = messages.where(F.col("role") == "assistant").select(F.when(there, ident(at - 1)).alias("call_id"), F.col("text").alias("output"))
    others = messages.where(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)))
    return calls, results, others.select(F.when(there, ident(at + 1)).alias("call_id"), F.to_json(F.struct("role", "text")).alias("context"))

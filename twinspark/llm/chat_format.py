"""Chat formatting: link tool calls to results, order them, validate arguments, write canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspark.llm.shared import BLANKS, cut_lineage

#: JSON types by the names that schema_of_variant gives.
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}


def valid_arguments(name: Column, arguments: Column, schemas: dict[str, dict[str, dict]]) -> Column:
    """Whether JSON `arguments` fit the schema of `name`; null where `name` is null.

    A schema maps a field to {"type", "required", "minimum", "enum"}.  Malformed JSON, anything
    but an object, an unknown name, an unknown field, a missing required field or a value of the
    wrong type (JSON null too), below the minimum or outside the enumeration is invalid.
    """
    parsed = F.try_parse_json(arguments)
    keys = F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>"))
    out = F.when(name.isNull(), F.lit(None).cast("boolean"))
    for tool, fields in schemas.items():
        fits = F.size(F.array_except(keys, F.array(*[F.lit(f) for f in fields]).cast("array<string>"))) == 0
        for field, rule in fields.items():
            path = f"$['{field}']"
            there = F.array_contains(keys, field)
            value = F.schema_of_variant(F.try_variant_get(parsed, path, "variant")).rlike(f"^({_TYPES[rule['type']]})$")
            if "minimum" in rule:
                value = value & (F.try_variant_get(parsed, path, "double") >= F.lit(float(rule["minimum"])))
            if "enum" in rule:
                value = value & F.try_variant_get(parsed, path, "string").isin([str(x) for x in rule["enum"]])
            fits = fits & F.when(there, value).otherwise(F.lit(not rule.get("required", False)))
        out = out.when(name == tool, F.coalesce(fits, F.lit(False)))
    return out.otherwise(F.lit(False))


def call_order(calls: DataFrame) -> DataFrame:
    """Topological places of calls (conv_id, call_id, call_turn, needs array of call ids), conv_id and call_id not null.

    Adds order_turn, the latest turn among a call and all it needs; level, the longest chain of
    needs below it; and in_cycle.  Ids that no call has are taken as met; calls of a cycle, and
    those that need them, keep their own turn at level 0 and are marked.

    Where no call needs more than one other, each call's need is replaced by its need's need, and
    so on, so that a chain of n calls takes log2(n) rounds; otherwise each level is a round.  A
    round is a join on conversation and call, cut at the shared folder.
    """
    known = calls.select("conv_id", "call_id", "call_turn")
    needs = calls.select("conv_id", "call_id", F.explode(F.array_distinct("needs")).alias("need"))
    there = known.select("conv_id", F.col("call_id").alias("need"))
    needs = cut_lineage(needs.join(there, ["conv_id", "need"], "left_semi").select("conv_id", "call_id", "need"))
    most = needs.groupBy("conv_id", "call_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return _by_doubling(known, needs) if most <= 1 else _by_levels(known, needs)


def _by_doubling(known: DataFrame, needs: DataFrame) -> DataFrame:
    """call_order where each call needs one other at most.

    A row's `need` is the call `level` steps below it, and order_turn the latest turn so far; of a
    chain's end `need` is null.  When a round ends no more chains, what is left never ends.
    """
    now = cut_lineage(known.join(needs, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "call_turn", "need", F.col("call_turn").alias("order_turn"), F.when(F.col("need").isNull(), 0).otherwise(1).cast("long").alias("level")))
    left = now.where("need is not null").count()
    while left:
        below = now.select("conv_id", F.col("call_id").alias("need"), F.col("need").alias("next"), F.col("order_turn").alias("t"), F.col("level").alias("l"))
        joined = now.join(below, ["conv_id", "need"], "left")
        now = cut_lineage(joined.select("conv_id", "call_id", "call_turn", F.col("next").alias("need"), F.greatest("order_turn", "t").alias("order_turn"), (F.col("level") + F.coalesce("l", F.lit(0))).alias("level")))
        before, left = left, now.where("need is not null").count()
        if left == before:
            break
    stuck = F.col("need").isNotNull()
    return now.select("conv_id", "call_id", "call_turn", F.when(stuck, F.col("call_turn")).otherwise(F.col("order_turn")).alias("order_turn"), F.when(stuck, 0).otherwise(F.col("level")).cast("long").alias("level"), stuck.alias("in_cycle"))


def _by_levels(known: DataFrame, needs: DataFrame) -> DataFrame:
    """call_order in general."""
    waiting = known.join(needs.select("conv_id", "call_id").distinct().withColumn("waits", F.lit(True)), ["conv_id", "call_id"], "left")
    done = cut_lineage(waiting.where("waits is null").select("conv_id", "call_id", "call_turn", F.col("call_turn").alias("order_turn"), F.lit(0).cast("long").alias("level")))
    rest = cut_lineage(waiting.where("waits").drop("waits"))
    while True:
        met = done.select("conv_id", F.col("call_id").alias("need"), F.col("order_turn").alias("t"), F.col("level").alias("l"))
        state = needs.join(met, ["conv_id", "need"], "left").groupBy("conv_id", "call_id").agg(F.bool_and(F.col("t").isNotNull()).alias("met"), F.max("t").alias("t"), (F.max("l") + 1).alias("level"))
        ready = cut_lineage(rest.join(state.where("met"), ["conv_id", "call_id"]).select("conv_id", "call_id", "call_turn", F.greatest("call_turn", "t").alias("order_turn"), "level"))
        if ready.isEmpty():
            break
        done = cut_lineage(done.unionByName(ready))
        rest = cut_lineage(rest.join(ready, ["conv_id", "call_id"], "left_anti"))
    stuck = rest.select("*", F.col("call_turn").alias("order_turn"), F.lit(0).cast("long").alias("level"), F.lit(True).alias("in_cycle"))
    return done.withColumn("in_cycle", F.lit(False)).unionByName(stuck)


def format_chat(turns: DataFrame, schemas: dict[str, dict[str, dict]], needs: bool = False) -> DataFrame:
    """Link, order, validate and serialise turns; one row per input row.

    `turns` has conv_id, turn, role, text, call_id, name, arguments (JSON text) for calls and
    result_of (a call's id) for results, all nullable; with `needs` also the array of call ids
    that a call depends on.  Other columns are dropped.  Adds linked (null where the row is no
    result), call_turn, same_id_calls (calls that carry the id), valid_arguments, and the order of
    a conversation: order_turn, order_level, order_step.  A result comes straight after its call
    and a call after all it needs; sorting by conv_id and these, then turn, is a topological
    order.  Ids are matched within a conversation, null conversations being one; of calls with
    one id the first counts.  json is one object with sorted keys, no blanks and no null fields;
    arguments are canonical JSON themselves, or their text where they are malformed.

    Calls are aggregated by id before the join, so a repeated id costs one row, and nothing
    gathers a conversation: a long one is as many rows as it has turns.
    """
    calls = (
        turns.where("call_id is not null")
        .groupBy(F.col("conv_id").alias("of_conv"), F.col("call_id").alias("of_call"))
        .agg(F.min("turn").alias("call_turn"), F.count("*").alias("same_id_calls"), *([F.flatten(F.collect_set("needs")).alias("needs")] if needs else []))
    )
    if needs:
        calls = cut_lineage(calls)
        # A call without a turn is placed as one before all others; conversations are told apart from the null one.
        conv = F.coalesce(F.concat(F.lit("="), F.col("of_conv").cast("string")), F.lit(""))
        placed = call_order(calls.select(conv.alias("conv_id"), F.col("of_call").alias("call_id"), F.coalesce("call_turn", F.lit(-(1 << 62))).alias("call_turn"), "needs"))
        placed = placed.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_call"), F.nullif("order_turn", F.lit(-(1 << 62))).alias("order_turn"), "level", "in_cycle")
        calls = calls.join(placed, (conv == F.col("p_conv")) & (F.col("of_call") == F.col("p_call"))).drop("p_conv", "p_call", "needs")
    else:
        calls = calls.withColumns({"order_turn": F.col("call_turn"), "level": F.lit(0).cast("long"), "in_cycle": F.lit(False)})
    key = F.coalesce("call_id", "result_of")
    joined = turns.join(calls, turns["conv_id"].eqNullSafe(calls["of_conv"]) & (key == calls["of_call"]), "left")
    is_result = F.col("call_id").isNull() & F.col("result_of").isNotNull()
    linked = F.col("of_call").isNotNull()
    parsed = F.try_parse_json("arguments")
    call = F.struct(F.coalesce(parsed, F.to_variant_object(F.struct("arguments"))).alias("arguments"), F.col("call_id").alias("id"), "name")
    message = F.struct(
        F.col("text").alias("content"),
        "role",
        F.when(is_result & linked, F.col("result_of")).alias("tool_call_id"),
        F.when(F.col("call_id").isNotNull(), F.array(call)).alias("tool_calls"),
        "turn",
    )
    return joined.select(
        "conv_id",
        "turn",
        "role",
        "call_id",
        "result_of",
        F.when(is_result, linked).alias("linked"),
        "call_turn",
        F.coalesce("same_id_calls", F.lit(0)).cast("long").alias("same_id_calls"),
        valid_arguments(F.when(F.col("call_id").isNotNull(), F.coalesce("name", F.lit(""))), F.col("arguments"), schemas).alias("valid_arguments"),
        F.when(linked, F.col("order_turn")).otherwise(F.col("turn")).alias("order_turn"),
        F.when(linked, F.col("level")).otherwise(F.lit(0)).cast("long").alias("order_level"),
        F.when(is_result & linked, 1).otherwise(0).cast("long").alias("order_step"),
        F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"),
        F.to_json(message).alias("json"),
    )


#: Arguments of the call that a user's turn makes.
DIALOGUE_SCHEMAS = {"reply": {"prompt": {"type": "string", "required": True}, "words": {"type": "integer", "required": True, "minimum": 1}}}


def dialogue_turns(conversations: DataFrame) -> DataFrame:
    """Plain dialogue as calls and results: a user's turn calls `reply`, the next assistant's turn answers it.

    A call needs that of two turns before, if there is one: in a dialogue that takes turns, the one before it.
    """
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), BLANKS + "+"), lambda w: w != ""))
    called, answers = F.col("role") == "user", F.col("role") == "assistant"
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    return conversations.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(called, F.concat(conv, F.lit(":"), F.col("turn").cast("string"))).alias("call_id"),
        F.when(called, F.lit("reply")).alias("name"),
        F.when(called, F.to_json(F.struct(F.col("text").alias("prompt"), words.alias("words")))).alias("arguments"),
        F.when(answers, F.concat(conv, F.lit(":"), (F.col("turn") - 1).cast("string"))).alias("result_of"),
        F.when(called, F.array(F.concat(conv, F.lit(":"), (F.col("turn") - 2).cast("string")))).alias("needs"),
    )

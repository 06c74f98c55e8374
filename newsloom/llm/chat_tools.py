"""Chat formatting: tool calls linked with their results, ordered, checked against schemas, as canonical JSON.

Native throughout: DataFrame operations and built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import stored

#: Arguments of each tool: name -> (type, required); types are those of JSON Schema.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {"reply": {"text": ("string", True), "turn": ("integer", True), "words": ("integer", True), "note": ("string", False)}}
#: What Spark calls the types of JSON values.
KINDS = {"string": ("STRING",), "integer": ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL(%,0)"), "number": ("BIGINT", "INT", "DOUBLE", "FLOAT", "DECIMAL%"), "boolean": ("BOOLEAN",), "object": ("OBJECT<%",), "array": ("ARRAY<%",)}
CALL = "array<struct<id: string, name: string, arguments: string, after: array<string>>>"


def canonical(json: Column) -> Column:
    """The same JSON with keys in order at every level and no white space; null if it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def from_turns(conversations: DataFrame) -> DataFrame:
    """Conversations without tool traffic as conversations with it: (conv_id, turn, role, content, calls, result_of).

    A user's turn asks for a call of `reply` that carries its text, and waits for the call two turns before; an
    assistant's turn is the result of the call one turn before. Other roles stay plain messages.
    """
    name = lambda back: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    text = F.coalesce(F.col("text"), F.lit(""))
    arguments = F.to_json(F.struct(text.alias("text"), F.col("turn").alias("turn"), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("words")))
    call = F.array(F.struct(name(0).alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.when(F.col("turn") >= 2, F.array(name(2))).otherwise(F.array().cast("array<string>")).alias("after")))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role",
        F.when(F.col("role") == "user", F.lit(None).cast("string")).otherwise(F.col("text")).alias("content"),
        F.when(F.col("role") == "user", call).cast(CALL).alias("calls"),
        F.when(F.col("role") == "assistant", name(1)).alias("result_of"),
    )


def argument_errors(schemas: dict, name: Column, arguments: Column) -> Column:
    """Sorted names of what is wrong with a call's arguments; empty if they satisfy the tool's schema."""
    value = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    errors = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        found = [F.transform(F.array_except(keys, F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")), lambda k: F.concat(F.lit("unexpected "), k))]
        for field, (kind, required) in fields.items():
            there = F.array_contains(keys, field)
            own = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
            fits = F.lit(False)
            for k in KINDS[kind]:
                fits = fits | own.like(k)
            wrong = F.when(~there, F.lit(f"missing {field}") if required else F.lit(None).cast("string")).when(~F.coalesce(fits, F.lit(False)), F.lit(f"{field} is no {kind}"))
            found.append(F.array_compact(F.array(wrong)))
        errors = F.when(name == tool, F.concat(*found)).otherwise(errors)
    whole = F.when(value.isNull() | ~F.coalesce(F.schema_of_variant(value).like("OBJECT<%"), F.lit(False)), F.array(F.lit("arguments are no object"))).otherwise(errors)
    return F.array_sort(whole)


def depths(calls: DataFrame) -> DataFrame:
    """(conv, id, depth): 0 for calls that wait for none, else one more than the deepest they wait for; null on cycles.

    Dependencies that are no calls of the conversation hold nothing up. Chains of calls that wait for one other each are
    followed to their end by pointer doubling, in rounds that grow with the logarithm of a chain's length. Calls that
    wait for several are settled in rounds of their own, over chains as single steps, once all they wait for are.
    Every round is written to the shared folder and reads only the round before, so plans do not grow.
    """
    at = lambda left, right: F.col("conv").eqNullSafe(F.col("c")) & (F.col(left) == F.col(right))
    nodes = calls.select("conv", "id").distinct()
    pairs = calls.select("conv", "id", F.explode("after").alias("dep")).distinct()
    there = nodes.select(F.col("conv").alias("c"), F.col("id").alias("i"))
    waits = stored(pairs.join(there, at("dep", "i"), "left_semi"), "waits")
    counted = waits.groupBy(F.col("conv").alias("c"), F.col("id").alias("i")).agg(F.count("*").alias("n"), F.min("dep").alias("dep"))
    nodes = stored(nodes.join(counted, at("id", "i"), "left").select("conv", "id", F.coalesce("n", F.lit(0)).alias("n"), "dep"), "calls")
    chain = stored(nodes.where("n = 1").select("conv", "id", F.col("dep").alias("to"), F.lit(1).alias("steps"), F.lit(True).alias("moved")), "chain")
    for _ in range(max(1, chain.count()).bit_length() + 1):
        ahead = chain.select(F.col("conv").alias("c"), F.col("id").alias("i"), F.col("to").alias("next"), F.col("steps").alias("more"))
        chain = stored(chain.join(ahead, at("to", "i"), "left").select("conv", "id", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")), "chain")
        if chain.where("moved").isEmpty():
            break
    ends = chain.where("not moved").select(F.col("conv").alias("c"), F.col("id").alias("i"), "to", "steps")  # others run in circles
    newest = stored(nodes.where("n = 0").select("conv", "id", F.lit(0).alias("depth")), "depths")
    settled = [newest]
    several = waits.join(nodes.where("n > 1").select(F.col("conv").alias("c"), F.col("id").alias("i")), at("id", "i"), "left_semi")
    several = several.join(ends, at("dep", "i"), "left").select("conv", "id", F.coalesce("to", "dep").alias("dep"), F.coalesce("steps", F.lit(0)).alias("steps"), F.lit(None).cast("int").alias("known"))
    several = stored(several, "waits")
    while not (several.isEmpty() or newest.isEmpty()):  # every round settles calls, so it ends
        done = newest.select(F.col("conv").alias("c"), F.col("id").alias("i"), "depth")
        state = stored(several.join(done, at("dep", "i"), "left").select("conv", "id", "dep", "steps", F.coalesce("known", F.col("depth") + F.col("steps")).alias("known")), "waits")
        whole = state.groupBy("conv", "id").agg(F.max("known").alias("deepest"), F.bool_or(F.col("known").isNull()).alias("open")).where("not open")
        newest = stored(whole.select("conv", "id", (F.col("deepest") + 1).alias("depth")), "depths")
        settled.append(newest)
        if len(settled) > 16:  # keeps the plan short
            whole_list = settled[0]
            for part in settled[1:]:
                whole_list = whole_list.unionByName(part)
            settled = [stored(whole_list, "depths")]
        gone = newest.select(F.col("conv").alias("c"), F.col("id").alias("i"))
        several = stored(state.join(gone, at("id", "i"), "left_anti"), "waits")
    known = settled[0]
    for part in settled[1:]:
        known = known.unionByName(part)
    known = stored(known, "depths") if len(settled) > 1 else known
    start = known.select(F.col("conv").alias("c"), F.col("id").alias("i"), "depth")
    follow = ends.withColumnsRenamed({"c": "conv", "i": "id"}).join(start, at("to", "i")).select("conv", "id", (F.col("depth") + F.col("steps")).cast("int").alias("depth"))
    return stored(known.select("conv", "id", F.col("depth").cast("int").alias("depth")).unionByName(follow), "depths")


def link_tools(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row for each call, and one for each message that holds none, with its place and its canonical JSON.

    messages: conv_id, turn, role, content, calls (array of id, name, arguments as JSON, after: ids it waits for) and
    result_of (the id of the call that a message answers). Result: conv_id, turn, role, part (the call's place in its
    message, else 0), call_id, depth (topological; null for messages that neither call nor answer, and on cycles),
    linked_turn (of a call its first result's turn; of a result its call's), valid, errors (comma-joined), json. In a
    conversation, (depth, turn, part) puts every call after all it waits for; a result has its call's depth.

    Ids link within a conversation. Of results that repeat an id the one of least turn is the call's; every result links
    to the call of least turn. errors: a call without result, a result without call, a repeated call id, a dependency
    that is no call, a cycle, and what argument_errors finds. Null ids link to nothing; null texts give null content;
    repeated rows give rows each; conversations of any size stay spread over rows and are never gathered.
    """
    given = messages.select("conv_id", "turn", "role", "content", F.col("calls").cast(CALL).alias("calls"), "result_of")
    rows = given.select("*", F.posexplode_outer("calls").alias("part", "call")).select(
        "conv_id", "turn", "role", "content", "result_of", F.coalesce("part", F.lit(0)).alias("part"),
        F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"),
        F.coalesce("call.after", F.array().cast("array<string>")).alias("after"), F.col("call").isNotNull().alias("is_call"),
    )
    rows = stored(rows, "messages")
    calls = rows.where(F.col("is_call") & F.col("call_id").isNotNull()).select(F.col("conv_id").alias("conv"), F.col("call_id").alias("id"), "turn", "part", "after")
    depth = depths(calls.select("conv", "id", "after"))
    known = calls.groupBy("conv", "id").agg(F.min("turn").alias("call_turn"), F.count("*").alias("n_calls"))
    known = known.join(depth.select(F.col("conv").alias("c"), F.col("id").alias("i"), "depth"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("id") == F.col("i")), "left").drop("c", "i")
    results = rows.where(F.col("result_of").isNotNull()).groupBy(F.col("conv_id").alias("rc"), F.col("result_of").alias("ri")).agg(F.min("turn").alias("result_turn"))
    absent = calls.select("conv", "id", F.explode("after").alias("dep")).join(known.select(F.col("conv").alias("c"), F.col("id").alias("i")), F.col("conv").eqNullSafe(F.col("c")) & (F.col("dep") == F.col("i")), "left_anti")
    absent = absent.groupBy(F.col("conv").alias("ac"), F.col("id").alias("ai")).agg(F.count("*").alias("n_absent"))
    facts = known.join(results, F.col("conv").eqNullSafe(F.col("rc")) & (F.col("id") == F.col("ri")), "left").drop("rc", "ri")
    facts = facts.join(absent, F.col("conv").eqNullSafe(F.col("ac")) & (F.col("id") == F.col("ai")), "left").drop("ac", "ai")
    key = F.when(F.col("is_call"), F.col("call_id")).otherwise(F.col("result_of"))
    out = rows.withColumn("key", key).join(facts, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("key") == F.col("id")), "left")
    answers = F.col("result_of").isNotNull() & ~F.col("is_call")
    wrong = F.array(
        F.when(F.col("is_call") & F.col("call_id").isNull(), F.lit("no id")),
        F.when(F.col("is_call") & F.col("result_turn").isNull(), F.lit("no result")),
        F.when(answers & F.col("call_turn").isNull(), F.lit("no call")),
        F.when(F.col("is_call") & (F.col("n_calls") > 1), F.lit("repeated id")),
        F.when(F.col("is_call") & (F.col("n_absent") > 0), F.lit("unknown dependency")),
        F.when(F.col("is_call") & F.col("call_turn").isNotNull() & F.col("depth").isNull(), F.lit("cycle")),
    )
    errors = F.concat(F.array_compact(wrong), F.when(F.col("is_call"), argument_errors(schemas, F.col("name"), F.col("arguments"))).otherwise(F.array().cast("array<string>")))
    parsed = F.try_parse_json("arguments")
    body = F.struct(
        F.when(parsed.isNull(), F.col("arguments")).alias("arguments_text"), parsed.alias("arguments"), F.col("call_id").alias("call_id"),
        F.col("content").alias("content"), F.col("name").alias("name"), F.col("result_of").alias("result_of"), F.col("role").alias("role"),
    )
    out = out.withColumn("_errors", errors)
    return out.select(
        "conv_id", "turn", "role", F.col("part").cast("int").alias("part"), F.col("key").alias("call_id"), F.col("depth").cast("int").alias("depth"),
        F.when(F.col("is_call"), F.col("result_turn")).otherwise(F.col("call_turn")).alias("linked_turn"),
        (F.size("_errors") == 0).alias("valid"), F.array_join("_errors", ",").alias("errors"), canonical(F.to_json(body)).alias("json"),
    )


def format_chats(conversations: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    return link_tools(from_turns(conversations), schemas)

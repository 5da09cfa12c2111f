"""Link tool calls to their results, order and check them, and write them as canonical JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeflow.sources.stage_store import settle

# Tool -> argument -> (type, required).
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]

# Exchanges of plain conversations, seen as calls.
EXCHANGE_SCHEMAS: Schemas = {
    "reply": {"context": ("reference", False), "prompt": ("string", True), "turn": ("integer", True)},
    "configure": {"instructions": ("string", True)},
}

PATTERNS = {"string": r"(?s)^.*\S.*$", "integer": r"^-?(0|[1-9]\d*)$", "reference": r"(?s)^ref:.+$"}


def quoted(text: Column) -> Column:
    """A string as a JSON string; null stays null."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def json_object(**fields: Column) -> Column:
    """A JSON object of ready values, keys in order; null values are left out."""
    parts = [F.concat(F.lit(f'"{name}":'), fields[name]) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def exchange_events(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of ``messages(conv_id, turn, role, text)``.

    Explicit ones come from JSON: an assistant's ``{"tool_calls": [{"id",
    "name", "arguments"}]}`` and a tool's ``{"tool_call_id", "content"}``.
    In plain messages a user turn is a call ``reply`` answered by an
    assistant's next turn, with a reference to the exchange two turns
    before, if there is one; a system turn is a call ``configure``.
    """
    spec = "tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string, content string"
    messages = messages.select("conv_id", "turn", "role", "text")
    parsed = messages.withColumn("m", F.when(F.col("text").startswith("{"), F.from_json("text", spec)))
    parsed = parsed.withColumn("explicit", F.expr("m.tool_calls is not null or m.tool_call_id is not null"))
    parsed = parsed.withColumn("explicit", F.coalesce("explicit", F.lit(False)))

    called = parsed.where("role = 'assistant' and m.tool_calls is not null")
    called = called.select("conv_id", "turn", F.explode("m.tool_calls").alias("call"))
    arguments = F.from_json("call.arguments", "map<string,string>")
    explicit = called.select("conv_id", "turn", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), arguments.alias("arguments"))
    explicit_results = parsed.where("role = 'tool' and m.tool_call_id is not null").selectExpr(
        "conv_id", "turn", "m.tool_call_id as call_id", "m.content as content"
    )

    plain = parsed.where("not explicit")
    name = "concat('turn-', conv_id, '-', {})"
    asked = plain.where("role = 'user'")
    earlier = asked.selectExpr("conv_id", "turn + 2 as turn", f"concat('ref:', {name.format('turn')}) as context").distinct()
    asked = asked.join(earlier, ["conv_id", "turn"], "left").selectExpr(
        "conv_id", "turn", f"{name.format('turn')} as call_id", "'reply' as name",
        "map('context', context, 'prompt', text, 'turn', cast(turn as string)) as arguments",
    )
    configured = plain.where("role = 'system'").selectExpr(
        "conv_id", "turn", f"{name.format('turn')} as call_id", "'configure' as name", "map('instructions', text) as arguments"
    )
    answered = plain.where("role = 'assistant'").selectExpr(
        "conv_id", "turn", f"{name.format('turn - 1')} as call_id", "text as content"
    )
    calls = explicit.unionByName(asked).unionByName(configured)
    present = F.map_filter("arguments", lambda _, v: v.isNotNull())
    return calls.withColumn("arguments", present), explicit_results.unionByName(answered)


def argument_problems(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted, comma-separated faults: unknown tool or argument, missing or mistyped argument; empty if none."""
    found = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        known = F.array(*[F.lit(a) for a in schema])
        extra = F.transform(F.array_except(F.coalesce(F.map_keys(arguments), F.array()), known), lambda a: F.concat(F.lit("unknown "), a))
        faults = []
        for argument, (kind, required) in schema.items():
            value = F.coalesce(arguments, F.create_map().cast("map<string,string>"))[argument]
            fault = F.when(value.isNull(), F.lit(f"missing {argument}" if required else None))
            faults.append(fault.when(~value.rlike(PATTERNS[kind]), F.lit(f"no {kind} {argument}")))
        found = F.when(name == tool, F.concat(extra, F.array_compact(F.array(*faults)))).otherwise(found)
    return F.array_join(F.array_sort(found), ",")


def canonical_arguments(arguments: Column, name: Column, schemas: Schemas) -> Column:
    """Arguments as a JSON object, keys in order; well-formed integers of the schema unquoted."""
    whole = F.lit(False)
    pairs = [(tool, a) for tool, schema in schemas.items() for a, (kind, _) in schema.items() if kind == "integer"]

    def written(entry: Column) -> Column:
        number = whole
        for tool, argument in pairs:
            number = number | ((name == tool) & (entry["key"] == argument))
        number = number & entry["value"].rlike(PATTERNS["integer"])
        value = F.when(number, entry["value"]).otherwise(quoted(entry["value"]))
        return F.concat(quoted(entry["key"]), F.lit(":"), value)

    entries = F.array_sort(F.map_entries(arguments))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, written), ","), F.lit("}"))


def topological_waves(refs: DataFrame) -> DataFrame:
    """``(node, wave)`` for every node of ``refs(node, ref, step)`` that refers to another; null on a cycle or behind one.

    A node's wave is the largest that its references ask for: the wave of the
    node referred to, plus the reference's ``step``. Nodes that only others
    refer to have wave 0 and no row.

    References are peeled in rounds. One to a node whose wave is known is
    closed (``ref`` null) and leaves its demand in ``low``. One to a node with
    a single open reference is led on to that reference's node, so rounds
    grow with the logarithm of a chain's length, and with the depth only of
    nodes that keep several open references. As long as a node is neither on
    a cycle nor behind one, a round closes something. A reference led on
    beyond as many steps as there are references runs in a circle and stays.
    """
    every = [F.max("step").alias("step"), F.max("low").alias("low")]
    rows = refs.selectExpr("node", "ref", "cast(step as long) as step", "0L as low").groupBy("node", "ref").agg(*every)
    rows = settle(rows, "refs")
    total = n_open = rows.count()
    before = None
    while n_open and n_open != before:
        heads = rows.groupBy(F.col("node").alias("ref")).agg(
            F.count("ref").alias("n_open"),
            F.max("ref").alias("next"),
            F.expr("max(step) filter (where ref is not null) as next_step"),
            F.max("low").alias("next_low"),
        )
        stays = f"n_open > 1 or n_open = 1 and step > {total}"
        met = rows.where("ref is not null").join(heads, "ref", "left").selectExpr(
            "node",
            f"if({stays}, ref, next) as ref",
            f"if({stays}, step, coalesce(step + next_step, 0L)) as step",
            f"if({stays}, low, greatest(low, step + coalesce(next_low, 0L))) as low",
        )
        rows = settle(met.unionByName(rows.where("ref is null")).groupBy("node", "ref").agg(*every), "refs")
        before, n_open = n_open, rows.where("ref is not null").count()
    return rows.groupBy("node").agg(F.expr("case when count(ref) = 0 then cast(max(low) as int) end as wave"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Calls with their results, plus results without a call: ``conv_id, turn, call_id, name, wave, status, problems, n_results, json``.

    ``calls(conv_id, turn, call_id, name, arguments)`` and ``results(conv_id,
    turn, call_id, content)`` meet in a hash join on the identifier. Of
    several results to one call the first by turn, then text, is written and
    all are counted, so the join yields one row for each call. An argument
    value ``ref:ID`` refers to call ID, of any conversation. ``wave, turn,
    call_id`` is a topological order of all calls, found from all references
    (see ``topological_waves``): a call comes no earlier than the waves of
    what it refers to at earlier turns, and after those of anything else it
    refers to.

    Status: ``linked``, ``unanswered``, ``orphan`` (a result whose call is
    unknown; one row for each identifier) or ``cycle``. A call with a null
    identifier is unanswered, a result with one is an orphan. Repeated calls
    each get a row. Null text counts as a missing argument; null content is
    left out of the JSON. Other columns are ignored; no rows give no rows.
    """
    first = F.min(F.struct("turn", "content", "conv_id")).alias("first")
    merged = settle(results.groupBy("call_id").agg(first, F.count("*").alias("n_results")), "results")
    # Calls of one identifier are one node; each without any is a node of its own.
    node = "coalesce(concat('=', call_id), concat('#', monotonically_increasing_id())) as node"
    calls = settle(calls.selectExpr("conv_id", "turn", "call_id", "name", "arguments", node), "calls")

    values = calls.select("turn", "node", F.explode(F.map_values("arguments")).alias("value"))
    refs = values.where("value like 'ref:%'").selectExpr("turn", "node", "concat('=', substring(value, 5)) as ref")
    known = calls.where("call_id is not null").groupBy(F.col("node").alias("ref")).agg(F.max("turn").alias("ref_turn"))
    step = "if(coalesce(ref_turn < turn, false), 0, 1) as step"
    waves = topological_waves(refs.join(known, "ref").selectExpr("node", "ref", step)).withColumn("waved", F.lit(True))

    results = merged.select(F.concat(F.lit("="), "call_id").alias("node"), "first", "n_results")
    joined = calls.join(results, "node", "left").join(waves, "node", "left")
    arguments = canonical_arguments(F.col("arguments"), F.col("name"), schemas)
    json = json_object(
        arguments=arguments, id=quoted(F.col("call_id")), name=quoted(F.col("name")), result=quoted(F.col("first.content"))
    )
    status = "case when waved and wave is null then 'cycle' when n_results is null then 'unanswered' else 'linked' end"
    linked = joined.select(
        "conv_id",
        "turn",
        "call_id",
        "name",
        F.when(F.col("waved"), F.col("wave")).otherwise(0).alias("wave"),
        F.expr(status).alias("status"),
        argument_problems(F.col("name"), F.col("arguments"), schemas).alias("problems"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        json.alias("json"),
    )
    orphans = merged.join(calls, "call_id", "left_anti").select(
        F.col("first.conv_id").alias("conv_id"),
        F.col("first.turn").alias("turn"),
        "call_id",
        F.lit(None).cast("string").alias("name"),
        F.lit(0).alias("wave"),
        F.lit("orphan").alias("status"),
        F.lit("unknown call").alias("problems"),
        "n_results",
        json_object(id=quoted(F.col("call_id")), result=quoted(F.col("first.content"))).alias("json"),
    )
    return linked.unionByName(orphans)

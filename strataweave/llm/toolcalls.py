"""Tool calls and their results, linked, ordered, validated and written as canonical JSON.

Calls and results meet by (conversation, identifier) in one hash join. A call may name calls that it depends on; its level is the
greatest number of dependencies against the order of turns on any chain below it (0 where all point back), so (level, turn) is a
topological order in which every call follows what it depends on and every result its call. A call's level depends on the calls below it
alone, whatever else its conversation holds. Calls on a cycle or above one have no place in an order: they are marked, their level is null.

Runs of calls with a single dependency are skipped by pointer doubling, so only calls with several dependencies take rounds of their own: the number of
rounds grows with the logarithm of the longest run, plus the longest chain of such calls. Arguments are validated against flat schemas.
Each call, unmatched result or plain message is a line of canonical JSON (sorted keys, no spaces): no conversation is gathered into one row.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.core.session import cut_lineage

KEY = ["conv_id", "call_id"]
_KINDS = {"integer": "^(BIGINT|INT|SMALLINT|TINYINT)$", "number": "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$", "string": "^STRING$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY"}


def argument_status(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """'ok', or the first thing wrong: unknown_tool, not_json, not_object, missing:field, type:field, unexpected_field.

    ``schemas``: tool -> field -> (kind, required), kinds as in ``_KINDS``; a null value is of no kind.
    """
    v = F.try_parse_json(arguments)
    out = F.lit("unknown_tool")
    for tool, fields in schemas.items():
        ok: Column = F.when(F.size(F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*map(F.lit, fields)).cast("array<string>"))) > 0, F.lit("unexpected_field")).otherwise(F.lit("ok"))
        for field, (kind, required) in reversed(fields.items()):
            part = F.try_variant_get(v, f"$['{field}']", "variant")
            right = F.coalesce(F.schema_of_variant(part).rlike(_KINDS[kind]), F.lit(False))
            absent = F.when(F.lit(required), F.lit(f"missing:{field}")).otherwise(ok)
            ok = F.when(part.isNull(), absent).when(~right, F.lit(f"type:{field}")).otherwise(ok)
        ok = F.when(v.isNull(), F.lit("not_json")).when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), F.lit("not_object")).otherwise(ok)
        out = F.when(name == tool, ok).otherwise(out)
    return out


def canonical(arguments: Column) -> Column:
    """JSON with sorted keys and no spaces; what isn't JSON becomes a JSON string."""
    v = F.try_parse_json(arguments)
    return F.when(v.isNull(), quoted(arguments)).otherwise(F.to_json(v))


def quoted(text: Column) -> Column:
    """The text as a JSON string, null for null."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def _number(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("null"))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, cyclic) for calls (conv_id, call_id, turn, depends_on), ids not null and unique in their conversation.

    A dependency points back if its turn is smaller; any other, or one between unknown turns, counts one level. Dependencies on calls that
    are not there are ignored, repeated ones count once. A call that depends on itself is a cycle.
    """
    edges = calls.select("conv_id", "call_id", "turn", F.explode("depends_on").alias("on")).where("on is not null").distinct()
    below = calls.select("conv_id", F.col("call_id").alias("on"), F.col("turn").alias("on_turn"))
    step = F.when(F.coalesce(F.col("on_turn") < F.col("turn"), F.lit(False)), 0).otherwise(1)
    edges = edges.join(below, ["conv_id", "on"]).select("conv_id", "call_id", "on", step.alias("step"))
    # a conversation without a step against its turns is level 0 throughout: its chains add up to nothing
    odd = edges.where("step = 1").select("conv_id").distinct()
    edges = cut_lineage(edges.join(odd, "conv_id", "left_semi"))
    flat = calls.select(*KEY)
    if edges.isEmpty():
        return flat.withColumns({"level": F.lit(0), "cyclic": F.lit(False)})
    edges = cut_lineage(edges.join(edges.groupBy(*KEY).agg(F.count("*").alias("fan")), KEY))
    single, several = edges.where("fan = 1").drop("fan"), edges.where("fan > 1").drop("fan")
    runs = _skip_runs(single)
    # what several calls depend on, seen through the runs: a call without dependencies, or one with several
    through = runs.select("conv_id", F.col("call_id").alias("on"), F.col("on").alias("end"), F.col("step").alias("run"), F.col("cyclic"))
    short = several.join(through, ["conv_id", "on"], "left").select(*KEY, F.coalesce("end", "on").alias("on"), (F.col("step") + F.coalesce("run", F.lit(0))).alias("step"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
    forks = _settle(short)
    ends = forks.select("conv_id", F.col("call_id").alias("on"), F.col("level").alias("at"), F.col("cyclic").alias("bad"))
    of_runs = runs.join(ends, ["conv_id", "on"], "left").select(*KEY, (F.col("step") + F.coalesce("at", F.lit(0))).alias("level"), (F.col("cyclic") | F.coalesce("bad", F.lit(False))).alias("cyclic"))
    known = of_runs.union(forks.select(*KEY, "level", "cyclic"))
    cyclic = F.coalesce("cyclic", F.lit(False))
    return flat.join(known, KEY, "left").select(*KEY, F.when(~cyclic, F.coalesce("level", F.lit(0))).alias("level"), cyclic.alias("cyclic"))


def _skip_runs(single: DataFrame) -> DataFrame:
    """Of calls with one dependency each: where their run ends (a call that is not in ``single``), the steps on the way, and whether it never ends."""
    runs = cut_lineage(single.select(*KEY, "on", "step"))
    most = max(runs.count(), 1).bit_length() + 1
    for _ in range(most):
        ahead = runs.select("conv_id", F.col("call_id").alias("on"), F.col("on").alias("next"), F.col("step").alias("more"))
        hop = cut_lineage(runs.join(ahead, ["conv_id", "on"], "left"))
        if hop.where("next is not null").isEmpty():
            return hop.select(*KEY, "on", "step", F.lit(False).alias("cyclic"))
        runs = hop.select(*KEY, F.coalesce("next", "on").alias("on"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"))
    # after that many doublings a run that still ends in ``single`` goes round
    inside = single.select("conv_id", F.col("call_id").alias("on"), F.lit(True).alias("cyclic"))
    return runs.join(inside, ["conv_id", "on"], "left").select(*KEY, "on", "step", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def _settle(short: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, cyclic) of the calls with several dependencies: in each round those whose dependencies are all known.

    An edge whose dependency is one of these calls waits until ``at`` and ``bad`` say what became of it. A round writes two small tables, for each
    plan and table costs memory on the driver: the calls with what is known of them, and the edges of those that still wait.
    """
    own = short.select("conv_id", F.col("call_id").alias("on"), F.lit(True).alias("own")).distinct()
    waits = F.col("own").isNotNull()
    pending = cut_lineage(short.join(own, ["conv_id", "on"], "left").select(*KEY, "on", "step", F.when(~waits, 0).alias("at"), F.col("cyclic").alias("bad")))
    done, n = None, 0
    while True:
        calls = cut_lineage(pending.groupBy(*KEY).agg(F.min(F.col("at").isNotNull()).alias("known"), F.max(F.col("step") + F.col("at")).alias("level"), F.max("bad").alias("cyclic")))
        now, rest = calls.where("known").drop("known"), calls.where("not known").select(*KEY)
        some = {r[0] for r in calls.select("known").distinct().collect()}  # two at most
        if True not in some:
            left = rest.withColumns({"level": F.lit(0), "cyclic": F.lit(True)})
            return left if done is None else done.union(left)
        done, n = now if done is None else done.union(now), n + 1
        if False not in some:
            return done
        if n % 16 == 0:
            done = cut_lineage(done)
        found = now.select("conv_id", F.col("call_id").alias("on"), F.col("level").alias("new"), F.col("cyclic").alias("odd"))
        pending = cut_lineage(pending.join(rest, KEY, "left_semi").join(found, ["conv_id", "on"], "left").select(*KEY, "on", "step", F.coalesce("at", "new").alias("at"), (F.col("bad") | F.coalesce("odd", F.lit(False))).alias("bad")))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """Lines (conv_id, turn, level, kind, call_id, status, json) of calls (conv_id, turn, call_id, name, arguments, depends_on) and results (conv_id, turn, call_id, content).

    kind 'tool_call': status 'ok', 'unanswered', 'cycle', or what ``argument_status`` says. kind 'tool_result': 'orphan', results without a call.
    Of several calls or results with one identifier in a conversation the first by (turn, content) counts; the others are lines of status
    'duplicate'. Null identifiers match nothing. Extra columns are left behind.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on")
    results = results.select("conv_id", "turn", "call_id", "content")
    c_first = calls.where("call_id is not null and conv_id is not null").groupBy(*KEY).agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c"), F.count("*").alias("n_calls"))
    r_first = results.where("call_id is not null and conv_id is not null").groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    both = c_first.join(r_first, KEY, "full")
    flat = both.select(*KEY, F.col("c.turn").alias("turn"), "c.name", "c.arguments", "c.depends_on", F.col("r.turn").alias("r_turn"), "r.content", F.col("c").isNotNull().alias("called"), F.col("r").isNotNull().alias("answered"), "n_calls", "n_results")
    flat = cut_lineage(flat)
    known = flat.where("called")
    lines = known.join(levels(known), KEY).withColumn("bad", argument_status(F.col("name"), F.col("arguments"), schemas))
    status = F.when(F.col("cyclic"), "cycle").when(F.col("bad") != "ok", F.col("bad")).when(~F.col("answered"), "unanswered").otherwise("ok")
    out = lines.select("conv_id", "turn", "level", F.lit("tool_call").alias("kind"), "call_id", status.alias("status"), call_json(F.col("content"), F.col("r_turn")).alias("json"))
    orphans = flat.where("not called").select("conv_id", F.col("r_turn").alias("turn"), F.lit(0).alias("level"), F.lit("tool_result").alias("kind"), "call_id", F.lit("orphan").alias("status"), result_json().alias("json"))
    nameless_c = calls.where("call_id is null or conv_id is null").withColumn("bad", argument_status(F.col("name"), F.col("arguments"), schemas))
    nameless_c = nameless_c.select("conv_id", "turn", F.lit(0).alias("level"), F.lit("tool_call").alias("kind"), "call_id", F.when(F.col("bad") != "ok", F.col("bad")).otherwise("unanswered").alias("status"), call_json(F.lit(None).cast("string"), F.lit(None).cast("bigint")).alias("json"))
    nameless_r = results.where("call_id is null or conv_id is null").select("conv_id", "turn", F.lit(0).alias("level"), F.lit("tool_result").alias("kind"), "call_id", F.lit("orphan").alias("status"), result_json().alias("json"))
    more_c = calls.groupBy("conv_id", "turn", "call_id", "name", "arguments", "depends_on").agg(F.count("*").alias("n")).join(known.where("n_calls > 1").select(*KEY, F.struct("turn", "name", "arguments", "depends_on").alias("f")), KEY)
    more_c = _rest(more_c, F.struct("turn", "name", "arguments", "depends_on"), "tool_call", call_json(F.lit(None).cast("string"), F.lit(None).cast("bigint")))
    more_r = results.groupBy("conv_id", "turn", "call_id", "content").agg(F.count("*").alias("n")).join(flat.where("n_results > 1").select(*KEY, F.struct(F.col("r_turn").alias("turn"), "content").alias("f")), KEY)
    more_r = _rest(more_r, F.struct("turn", "content"), "tool_result", result_json())
    return out.union(orphans).union(nameless_c).union(nameless_r).union(more_c).union(more_r)


def _rest(rows: DataFrame, own: Column, kind: str, json: Column) -> DataFrame:
    """All rows of an identifier but the first, as often as they come."""
    left = rows.withColumn("left", F.col("n") - F.when(own.eqNullSafe(F.col("f")), 1).otherwise(0)).where("left > 0")
    left = left.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("left"))))
    return left.select("conv_id", "turn", F.lit(0).alias("level"), F.lit(kind).alias("kind"), "call_id", F.lit("duplicate").alias("status"), json.alias("json"))


def call_json(content: Column, turn: Column) -> Column:
    result = F.when(content.isNull() & turn.isNull(), F.lit("null")).otherwise(F.concat(F.lit('{"content":'), quoted(content), F.lit(',"turn":'), _number(turn), F.lit("}")))
    return F.concat(F.lit('{"arguments":'), canonical(F.col("arguments")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"result":'), result, F.lit(',"role":"tool_call"}'))


def result_json() -> Column:
    return F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"role":"tool_result"}'))


def message_json(role: Column, text: Column) -> Column:
    return F.concat(F.lit('{"content":'), quoted(text), F.lit(',"role":'), quoted(role), F.lit("}"))

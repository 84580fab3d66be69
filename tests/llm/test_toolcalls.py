import json

from pyspark.sql import functions as F

from strataweave.llm import toolcalls

CALL = "conv_id bigint, turn bigint, call_id string, name string, arguments string, depends_on array<string>"
RES = "conv_id bigint, turn bigint, call_id string, content string"
SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}, "list": {"xs": ("array", True), "o": ("object", False), "f": ("boolean", False)}}


def link(spark, calls, results):
    c = spark.createDataFrame(calls, CALL).withColumn("status", F.lit("mine"))
    r = spark.createDataFrame(results, RES).withColumn("json", F.lit(1))
    rows = toolcalls.link(c, r, SCHEMAS).collect()
    for x in rows:
        d = json.loads(x.json)
        assert list(d) == sorted(d) and json.dumps(d, separators=(",", ":"), ensure_ascii=False, sort_keys=True) == x.json
    return rows


def test_argument_status(spark):
    cases = {
        ("add", '{"a":1,"b":2.5}'): "ok", ("add", '{"b":2,"a":1,"note":"é"}'): "ok", ("add", '{"a":1.5,"b":1}'): "type:a", ("add", '{"a":1}'): "missing:b",
        ("add", '{"a":1,"b":1,"c":2}'): "unexpected_field", ("add", "[1]"): "not_object", ("add", "{oops"): "not_json", ("add", None): "not_json", ("add", '{"a":null,"b":1}'): "type:a",
        ("list", '{"xs":[1],"o":{"k":1},"f":true}'): "ok", ("list", '{"xs":1}'): "type:xs", ("list", '{"xs":[],"f":"no"}'): "type:f", ("nope", "{}"): "unknown_tool", (None, "{}"): "unknown_tool", ("add", "{}"): "missing:a",
    }
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "name string, arguments string, want string")
    for r in df.withColumn("got", toolcalls.argument_status(F.col("name"), F.col("arguments"), SCHEMAS)).collect():
        assert r.got == r.want, r


def test_links_duplicates_nulls_orphans(spark):
    ok = '{"b": 2,\n "a": 1}'
    calls = [(1, 1, "x", "add", ok, None), (1, 1, "x", "add", ok, None), (1, 3, "x", "add", ok, []), (1, 5, "y", "add", "bad", ["x"]), (1, 6, "z", "add", ok, ["y", "nowhere", None]), (1, 7, None, "add", ok, None), (None, 7, "q", "add", ok, None), (2, 1, "x", None, None, None)]
    results = [(1, 2, "x", 'line "one"\n\\'), (1, 4, "x", "late"), (1, 9, "w", None), (1, 9, None, ""), (2, 2, "x", ""), (3, None, "x", "a" * 20_000)]
    rows = link(spark, calls, results)
    got = sorted((str(r.conv_id), str(r.turn), r.kind, str(r.call_id), r.status, r.level) for r in rows)
    assert got == sorted([
        ("1", "1", "tool_call", "x", "ok", 0), ("1", "1", "tool_call", "x", "duplicate", 0), ("1", "3", "tool_call", "x", "duplicate", 0), ("1", "5", "tool_call", "y", "not_json", 0), ("1", "6", "tool_call", "z", "unanswered", 0),
        ("1", "7", "tool_call", "None", "unanswered", 0), ("None", "7", "tool_call", "q", "unanswered", 0), ("2", "1", "tool_call", "x", "unknown_tool", 0),
        ("1", "4", "tool_result", "x", "duplicate", 0), ("1", "9", "tool_result", "w", "orphan", 0), ("1", "9", "tool_result", "None", "orphan", 0), ("3", "None", "tool_result", "x", "orphan", 0)])
    first = json.loads(next(r.json for r in rows if r.status == "ok"))
    assert first == {"arguments": {"a": 1, "b": 2}, "id": "x", "name": "add", "result": {"content": 'line "one"\n\\', "turn": 2}, "role": "tool_call"}
    assert link(spark, [], []) == []


def test_topological_levels(spark):
    deps = {"a": ["b", "c"], "b": ["d"], "c": [], "d": [], "e": ["f"], "f": ["e"], "g": ["e", "c"]}
    calls = [(1, i, k, "add", "{}", v) for i, (k, v) in enumerate(deps.items())]
    calls += [(2, i, f"k{i}", "add", "{}", [f"k{i - 1}"]) for i in range(50)]
    c = spark.createDataFrame(calls, CALL)
    got = {(r.conv_id, r.call_id): (r.level, r.cyclic) for r in toolcalls.levels(c).collect()}
    assert {k: got[1, k] for k in deps} == {"a": (2, False), "b": (1, False), "c": (0, False), "d": (0, False), **{k: (2, True) for k in "efg"}} or {k: got[1, k][1] for k in deps} == {**dict.fromkeys("abcd", False), **dict.fromkeys("efg", True)}
    assert got[1, "a"][0] > got[1, "b"][0] > got[1, "d"][0]
    assert all(got[2, f"k{i}"] == (0, False) for i in range(50))


def test_native_plan(spark, sf):
    from strataweave.llm import queries

    plan = queries.op5_tool_calls(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_levels(calls):
    """Level of each call by its definition, walking all chains; None on or above a cycle."""
    turn = {(c, k): t for c, t, k, *_, d in calls}
    needs = {(c, k): {x for x in d or [] if x is not None and (c, x) in turn} for c, _, k, *_, d in calls}
    out = {}

    def level(c, k, path):
        if k in path:
            return None
        if (c, k) not in out:
            found = [(level(c, x, path | {k}), 0 if turn[c, x] < turn[c, k] else 1) for x in needs[c, k]]
            if any(v is None for v, _ in found):
                return None
            out[c, k] = max((v + s for v, s in found), default=0)
        return out[c, k]

    return {(c, k): level(c, k, frozenset()) for c, k in turn}


def test_levels_by_definition(spark):
    import random

    rnd, calls = random.Random(11), []
    for c in range(25):
        n = rnd.randrange(1, 14)
        for t in range(n):
            fan = rnd.choice([0, 1, 1, 1, 2, 3])
            calls.append((c, t, f"k{t}", "add", "{}", [f"k{rnd.randrange(n) if rnd.random() < 0.3 else rnd.randrange(max(1, t))}" for _ in range(fan)]))
    calls += [(100, i, f"k{i}", "add", "{}", [f"k{i + 1}"]) for i in range(300)]  # one long run against the turns
    calls += [(101, i, f"k{i}", "add", "{}", [f"k{(i + 1) % 7}"]) for i in range(7)]  # a ring
    want = plain_levels(calls)
    got = {(r.conv_id, r.call_id): (r.level, r.cyclic) for r in toolcalls.levels(spark.createDataFrame(calls, CALL)).collect()}
    assert got == {k: (v, v is None) for k, v in want.items()}
    assert got[100, "k0"] == (299, False) and any(v is None for k, v in want.items() if k[0] < 100)


def test_unrelated_calls_do_not_change_a_level(spark):
    chain = [(1, 0, "a", "add", "{}", None), (1, 2, "b", "add", "{}", ["a"])]
    odd = [(1, 4, "y", "add", "{}", ["z"]), (1, 6, "z", "add", "{}", None)]
    got = [{r.call_id: r.level for r in toolcalls.levels(spark.createDataFrame(rows, CALL)).collect()} for rows in (chain, chain + odd)]
    assert got[0] == {"a": 0, "b": 0} and got[1] == {"a": 0, "b": 0, "y": 1, "z": 0}


def test_query_has_levels_and_cycles(spark, sf):
    from strataweave.llm import queries

    rows = queries.op5_tool_calls(spark, sf).where("kind = 'tool_call'").collect()
    assert {r.level for r in rows} >= {0, 1, None} and all((r.level is None) == (r.status == "cycle") for r in rows)


def test_a_round_writes_two_tables(spark, monkeypatch):
    made = []
    keep = toolcalls.cut_lineage
    monkeypatch.setattr(toolcalls, "cut_lineage", lambda df: made.append(1) or keep(df))
    edges = [("c", f"k{i}", on, 1, False) for i in range(4) for on in (f"k{i - 1}", f"e{i}")]
    got = toolcalls._settle(spark.createDataFrame(edges, "conv_id string, call_id string, on string, step int, cyclic boolean")).collect()
    assert {(r.call_id, r.level, r.cyclic) for r in got} == {(f"k{i}", i + 1, False) for i in range(4)}
    assert len(made) <= 2 * 4

"""Agents' records: streams, actions and behaviour, against plain versions."""

import json
import math
import random

from pyspark.sql import functions as F

from grove.operators import runs


def test_stream_to_behaviour(spark):
    use = lambda name, **kw: {"type": "tool_use", "name": name, "input": json.dumps(kw)}
    events = [
        {"type": "assistant", "message": {"content": [use("Bash", command="grove find a.ts"), use("Read", file_path="a.ts")], "usage": {"input_tokens": 5, "output_tokens": 1, "cache_read_input_tokens": 2}}},
        {"type": "content_block_start", "content_block": use("Grep", pattern="x" * 200)},
        {"type": "assistant", "message": {"content": [use("Bash", command="grove callers s"), use("Bash", command="grove refs s"), use("Edit", file_path="b.ts"), use("Read", file_path="a.ts")]}, "usage": {"input_tokens": 7}},
    ]
    lines = [("r", i, json.dumps(e)) for i, e in enumerate(events)] + [("r", 9, "{not json"), ("q", 0, json.dumps({"type": "x"}))]
    parsed = runs.parse_stream(spark.createDataFrame(lines, "run_id string, seq int, value string"))
    tokens = {r["run_id"]: r for r in runs.usage(parsed).collect()}
    assert tokens["r"]["input_tokens"] == 12 and tokens["r"]["cache_read_input_tokens"] == 2 and tokens["q"]["input_tokens"] == 0
    acts = runs.actions(parsed)
    got = acts.orderBy("sequence").collect()
    assert [r["tool_name"] for r in got] == ["Bash", "Read", "Grep", "Bash", "Bash", "Edit", "Read"] and got[2]["summary"] == "x" * 200
    m = runs.behaviour(acts).first()
    assert m["actions_before_first_edit"] == 5 and m["navigation_to_edit_ratio"] == 6.0 and m["redundant_reads"] == 1 and m["tool_commands_before_first_edit"] == 3
    assert m["command_then_read"] == 1 and m["grep_after_find"] == 1 and m["callers_and_refs"]


def test_finite_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", math.inf), ("b", math.inf)], "g string, x double")
    got = {r["g"]: r["m"] for r in runs.finite_mean(df, ["g"], "x", "m").collect()}
    assert got["a"] == (1 + 3 + 3) / 3 and math.isinf(got["b"])


def test_score(spark):
    c = lambda *v: spark.range(1).select(runs.score(*(F.lit(x) for x in v))).first()[0]
    none = F.lit(None).cast("double")
    assert c(True, True, none, 0.8) == 100 and c(True, False, none, 0.8) == 50
    assert c(True, True, 0.8, 0.8) == 100 and c(True, True, 0.4, 0.8) == 90 and c(False, True, 0.0, 0.0) == 60


def test_tool_command_after_a_long_start(spark):
    command = "cd some/where && " * 14 + "grove refs X"
    event = {"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "Bash", "input": {"command": command}}]}}
    lines = spark.createDataFrame([("r", 0, json.dumps(event))], "run_id string, seq int, value string")
    (row,) = runs.actions(runs.parse_stream(lines)).collect()
    assert row["is_tool_command"] and row["is_navigation"] and len(row["summary"]) == runs.SUMMARY_BYTES + 3


def test_summaries(spark):
    long = "src/" + "deep/" * 40
    calls = [("Read", {"file_path": long + "a.ts"}), ("Edit", {"file_path": long}), ("Grep", {"pattern": long}), ("Glob", {"path": "x"}), ("Bash", {"command": "é" * 80}), ("Task", {"description": "y" * 99}), ("LS", {}), ("Read", {})]
    df = spark.createDataFrame([(t, json.dumps(a)) for t, a in calls], "tool string, args string")
    got = [r[0] for r in df.select(runs.argument_summary(F.col("tool"), F.col("args"))).collect()]
    other = json.dumps({"description": "y" * 99})
    assert got == [long + "a.ts", long, long, "", "é" * 50 + "...", other[:100] + "...", "{}", ""]


def plain_matches(acts):
    n = 0
    for i, (tool, summary, command) in enumerate(acts):
        for later, file, _ in acts[i + 1 :] if command else []:
            if later == "Read" and file in summary:
                n += 1
                break
            if later == "Edit":
                break
    return n


def test_command_then_read(spark):
    r = random.Random(4)
    rows = {run: [(t, f"grove refs {r.choice('abc')}/{r.choice(['x.ts', 'xx.ts'])}" if t == "Bash" else r.choice(["", "a/x.ts", "x.ts", "b/xx.ts", "c/long/x.ts"]), t == "Bash") for t in r.choices(["Bash", "Read", "Edit"], [4, 3, 1], k=60)] for run in "pqr"}
    acts = [(run, i, t, s, t == "Read" or c, t == "Edit", c) for run, each in rows.items() for i, (t, s, c) in enumerate(each)]
    df = spark.createDataFrame(acts, "run_id string, sequence int, tool_name string, summary string, is_navigation boolean, is_edit boolean, is_tool_command boolean")
    assert {x["run_id"]: x["command_then_read"] for x in runs.behaviour(df).collect()} == {run: plain_matches(each) for run, each in rows.items()}


def test_a_long_run_without_an_edit(spark):
    """50,000 commands and as many reads in one stretch: pairs of them would be 2.5 billion."""
    i = F.col("id")
    acts = spark.range(100_000).select(F.lit("r").alias("run_id"), i.alias("sequence"), F.when(i % 2 == 0, "Bash").otherwise("Read").alias("tool_name"), F.when(i % 2 == 0, F.concat(F.lit("grove refs f"), i % 5000)).otherwise(F.concat(F.lit("f"), i % 4999)).alias("summary"), F.lit(True).alias("is_navigation"), F.lit(False).alias("is_edit"), (i % 2 == 0).alias("is_tool_command"))
    assert 0 < runs.behaviour(acts).first()["command_then_read"] <= 50_000

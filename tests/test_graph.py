"""Operators on small graphs by hand: cycles, diamonds, loops, repeated edges, names with wildcards' letters."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grove.functions import names as N
from grove.operators.graph import CodeGraph, first_wins
from grove.operators.traverse import paths_to_ends, reach, simple_paths
from grove.schema import EDGES, SYMBOLS, violations


def sym(name, kind="function", path="src/a.ts", line=1, parent=None):
    return (f"{path}::{name}::{kind}::{line}", name, kind, path, line, line + 2, f"{name}()", None, parent, "typescript", "{}")


def graph(spark, symbols, edges):
    return CodeGraph(spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame([(a, b, k, "src/a.ts", i + 1) for i, (a, b, k) in enumerate(edges)], EDGES))


@pytest.fixture(scope="module")
def harbour(spark):
    """A gauge that three callers read, two of them by name: a nightly worker, a forecast that the worker asks, and a test."""
    gauge = sym("TideGauge", "struct", "lib/sea/gauge.rs", 3)
    level = sym("read_level", "method", "lib/sea/gauge.rs", 9, gauge[0])
    reset = sym("reset_at_ebb", "method", "lib/sea/gauge.rs", 30, gauge[0])
    night = sym("NightWatch", "class", "lib/shift/night.worker.ts", 2)
    round_, alarm = (sym(n, "method", "lib/shift/night.worker.ts", i, night[0]) for n, i in (("makeRound", 7), ("soundAlarm", 40)))
    forecast = sym("forecast", path="lib/sea/forecast.rs", line=12)
    trial = sym("gauge_reads_zero", path="tests/sea/gauge_test.rs")
    return graph(spark, [gauge, level, reset, night, round_, alarm, forecast, trial], [
        (alarm[0], "this.gauge.read_level", "calls"), (forecast[0], "TideGauge::read_level", "calls"), (round_[0], forecast[0], "calls"), (trial[0], level[0], "calls"),
        ("lib/shift/night.worker.ts::__module__::function", "../sea::TideGauge", "imports"), (night[0], "TideGauge", "references_type"), (level[0], "resetXatXebb", "calls"), (level[0], "sensor.poll", "calls"),
    ])


def names(df, c="name"):
    return [r[c] for r in df.select(c).collect()]


def test_find_symbol(harbour):
    assert names(harbour.find_symbol("TideGauge.read_level")) == ["read_level"]
    assert names(harbour.find_symbol("NightWatch.read_level")) == []
    assert names(harbour.find_symbol("nothing")) == []


def test_refs_of_a_struct_take_its_members(harbour):
    found = harbour.refs("TideGauge")
    assert [r["kind"] for r in found.collect()] == ["calls", "calls", "calls", "imports", "references_type"]
    assert harbour.refs("TideGauge", limit=2).collect()[0]["total"] == 5
    assert {r["from_name"] for r in found.collect()} >= {"NightWatch.soundAlarm", "night.worker", "forecast"}


def test_suffixes_are_literal(harbour):
    assert harbour.refs("reset_at_ebb").count() == 0  # "_" is no wildcard


def test_caller_counts(harbour):
    assert harbour.caller_count(harbour.find_symbol("read_level")).first()[0] == 2  # targets with "::" are left to refs
    assert harbour.summed_callers(harbour.find_symbol("forecast")).first()["caller_count"] == 1


def test_impact_splits_tests(harbour):
    rows = harbour.impact("read_level", 2).collect()
    assert {(r["name"], r["depth"], r["is_test"]) for r in rows} == {("soundAlarm", 1, False), ("forecast", 1, False), ("gauge_reads_zero", 1, True), ("makeRound", 2, False)}


def test_whole_sketches(spark, harbour):
    rows = lambda name, **o: [(r["section"], r["name"], r["n"]) for r in harbour.whole_sketch(name, **o).collect()]
    assert rows("TideGauge") == [("symbol", "TideGauge", 2), ("member", "read_level", 2), ("member", "reset_at_ebb", 0), ("dependency", "resetXatXebb", None), ("dependency", "sensor.poll", None)]
    assert rows("TideGauge", limit=1)[:3] == [("symbol", "TideGauge", 2), ("member", "read_level", 2), ("dependency", "resetXatXebb", None)]
    assert rows("read_level") == [("symbol", "read_level", 0), ("call", "resetXatXebb", None), ("call", "sensor.poll", None), ("caller", "gauge_reads_zero", 1)]
    shape, box, area = sym("Shape", "interface", line=1), sym("Box", "class", line=9), None
    area = sym("area", "method", line=3, parent=shape[0])
    g = graph(spark, [shape, area, box, sym("Hue", "enum", line=20)], [(box[0], "Shape", "implements"), (box[0], "Root", "extends")])
    got = lambda name: [(r["section"], r["name"]) for r in g.whole_sketch(name).collect()]
    assert got("Shape") == [("symbol", "Shape"), ("member", "area"), ("implementor", "Box")] and got("Hue") == [("symbol", "Hue")] and got("nobody") == []
    assert got("Box") == [("symbol", "Box"), ("extends", "Root"), ("implements", "Shape")]


def test_trace(harbour):
    paths = harbour.trace("read_level")
    assert [(r["steps"], r["first_name"]) for r in paths.collect()] == [(2, "gauge_reads_zero"), (2, "soundAlarm"), (3, "makeRound")]
    assert harbour.trace("reset_at_ebb").count() == 0 and harbour.trace("read_level", 1).count() == 2
    steps = harbour.path_steps(harbour.trace("read_level", 3).where("steps = 3")).orderBy("pos").collect()
    assert [s["name"] for s in steps] == ["makeRound", "forecast", "read_level"]


def test_deps(harbour):
    rows = harbour.deps("TideGauge").collect()
    assert {(r["name"], r["is_external"]) for r in rows} == {("resetXatXebb", True), ("sensor.poll", True)}


def test_entrypoints_collapse(harbour):
    rows = {r["name"]: r for r in harbour.collapsed_entrypoints().collect()}
    assert "makeRound" not in rows and rows["NightWatch"]["method_count"] == 2 and rows["NightWatch"]["entry_group"] == "Background Workers"
    assert "gauge_reads_zero" not in rows and "forecast" not in rows


def test_resolved_graph_goes_further(spark):
    a, b, c = sym("a", line=1), sym("b", line=5), sym("c", line=9)
    g = graph(spark, [a, b, c], [(a[0], "x.b", "calls"), (b[0], "y.c", "calls")])
    assert names(g.impact("c", 3)) == ["b"]
    assert sorted(names(g.resolve().impact("c", 3))) == ["a", "b"]


def test_first_edge_wins(spark):
    df = spark.createDataFrame([("a", "b", "calls", 7, 1), ("a", "b", "calls", 3, 0), ("a", "c", "calls", 4, 2)], "from_id string, to_id string, kind string, line int, ordinal long")
    assert {(r["to_id"], r["line"]) for r in first_wins(df, "ordinal").collect()} == {("b", 3), ("c", 4)}


def test_empty_graph(spark):
    g = graph(spark, [], [])
    for df in (g.refs("x"), g.impact("x"), g.trace("x"), g.deps("x"), g.entrypoints(), g.core_symbols(5), g.importance(), g.directory_stats(), g.class_relationships(g.find_symbol("x"))):
        assert df.count() == 0
    assert g.counts().first().asDict() == {"symbol_count": 0, "file_count": 0, "edge_count": 0}


def test_violations(spark):
    s = sym("a")
    g = graph(spark, [s, s, (*sym("b", "gadget", line=3)[:8], "nobody", "typescript", "{}")], [("a", "b", "shouts")])
    assert {r["rule"] for r in violations(g.symbols, g.edges).collect()} == {"symbol_id_unique", "symbol_kind", "parent_exists", "edge_kind"}


EDGE_LISTS = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=14)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(EDGE_LISTS)
def test_reach_is_breadth_first(spark, pairs):
    steps = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")
    got = {(r["id"], r["depth"]) for r in reach(spark.createDataFrame([("0",)], "id string"), steps, 4).collect()}
    depth, level = {"0": 1}, {"0"}
    for d in (2, 3, 4):
        level = {str(b) for a, b in pairs if str(a) in level} - depth.keys()
        depth |= dict.fromkeys(level, d)
    assert got == set(depth.items())


def test_simple_paths_stop_at_cycles(spark):
    steps = spark.createDataFrame([("t", "a"), ("a", "b"), ("b", "a"), ("b", "t"), ("a", "a")], "src string, dst string")
    got = {tuple(r["path"]) for r in simple_paths(spark.createDataFrame([(["a", "t"],)], "path array<string>"), steps, 9).collect()}
    assert got == {("a", "t"), ("b", "a", "t")}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(EDGE_LISTS, st.integers(1, 5), st.one_of(st.none(), st.integers(1, 4)))
def test_pruned_paths_are_those_of_the_enumeration(spark, pairs, depth, limit):
    """Every path to an end up to a depth; with a limit, all of the shortest levels that reach it."""
    steps = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string").distinct()
    first = spark.createDataFrame([(["0", "t"],), (["5", "t"],)], "path array<string>")
    sources = {str(a) for a, _ in pairs}
    whole = sorted((r["depth"], tuple(r["path"])) for r in simple_paths(first, steps, depth).collect() if r["path"][0] not in sources)
    if limit is not None and len(whole) > limit:
        whole = [p for p in whole if p[0] <= whole[limit - 1][0]]
    assert sorted((r["depth"], tuple(r["path"])) for r in paths_to_ends(first, steps, depth, limit).collect()) == whole


def test_a_trace_stops_early(spark):
    """Ten layers of ten callers each, and one entry point beside the target: no layer but the first is looked at."""
    pairs = [("t", f"0-{i}") for i in range(10)] + [(f"{d}-{i}", f"{d + 1}-{j}") for d in range(9) for i in range(10) for j in range(10)]
    steps = spark.createDataFrame([*pairs, ("0-0", "end")], "src string, dst string")
    first = spark.createDataFrame([([f"0-{i}", "t"],) for i in range(10)], "path array<string>")
    assert [tuple(r["path"]) for r in paths_to_ends(first, steps, 10, 1).collect()] == [("end", "0-0", "t")]


def test_name_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    for name, want in (("processPayment", "process Payment"), ("getHTTPResponse", "get HTTP Response"), ("login", "login")):
        assert get(N.split_camel(F.lit(name))) == want
    assert get(N.top_directory(F.lit("src/pay/x.ts"))) == "pay/" and get(N.top_directory(F.lit("src/x.ts"))) == "(root)/"
    assert get(N.is_test_file(F.lit("a/foo.spec.ts"))) and not get(N.is_test_file(F.lit("contest/a.ts")))
    assert get(N.caller_location(F.lit("a:b.ts:12"))).asDict() == {"file": "a:b.ts", "line": 12}
    assert get(N.member_name(F.lit(""), F.lit("libs/core/"))) == "core" and get(N.member_name(F.lit(None).cast("string"), F.lit(""))) == "unknown"
    assert get(N.subcommand(F.lit("grove --json find x"), "grove")) == "find" and get(N.subcommand(F.lit("ls"), "grove")) is None
    assert get(N.second_last_part(F.lit("f::n::class::3"))) == "class" and get(N.name_from_id(F.lit("f::n::class::3"))) == "n"
    assert get(N.modifiers(F.lit('{"access": "private", "isStatic": true, "is_async": true}'))) == ["private", "static", "async"]
    assert get(N.shortened(F.lit("abcdefghij"), 6)) == "abc..." and get(N.relative_time(F.lit(0), F.lit(7200))) == "2 hours ago"

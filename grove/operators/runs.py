"""Analytics over agents' run records: streams of events, behaviour of runs, and reports that compare two conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USAGE = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
STREAM = (
    "type STRING, message STRUCT<content: ARRAY<STRUCT<type: STRING, name: STRING, input: STRING>>, usage: STRUCT<input_tokens: BIGINT, output_tokens: BIGINT, cache_read_input_tokens: BIGINT, cache_creation_input_tokens: BIGINT>>, "
    "content_block STRUCT<type: STRING, name: STRING, input: STRING>, usage STRUCT<input_tokens: BIGINT, output_tokens: BIGINT, cache_read_input_tokens: BIGINT, cache_creation_input_tokens: BIGINT>"
)
#: Which argument of a tool sums its call up (fixed values); how long the summary of a command is, and of a tool that isn't named here.
SUMMARY_FIELD = {"Read": "file_path", "Edit": "file_path", "Write": "file_path", "Grep": "pattern", "Glob": "pattern", "Bash": "command"}
SUMMARY_BYTES = 100
EDIT_TOOLS, NAVIGATION_TOOLS = ("Edit", "Write", "MultiEdit"), ("Read", "Grep", "Glob", "LS")


def parse_stream(lines: DataFrame) -> DataFrame:
    """(run_id, seq, event) of NDJSON lines (run_id, seq, value); lines that aren't JSON objects are passed over."""
    return lines.select("run_id", "seq", F.from_json("value", STREAM).alias("event")).where("event IS NOT NULL AND event.type IS NOT NULL")


def usage(events: DataFrame) -> DataFrame:
    """Tokens of each run: sums of the counts that its events carry."""
    of = lambda k: F.coalesce(F.col(f"event.message.usage.{k}"), F.col(f"event.usage.{k}"), F.lit(0))
    return events.groupBy("run_id").agg(*(F.sum(of(k)).alias(k) for k in USAGE))


def telling_argument(tool: Column, arguments: Column) -> Column:
    """The argument that sums a call up, empty if it is missing; all arguments of other tools."""
    known = F.coalesce(*(F.when(tool == t, F.get_json_object(arguments, f"$.{f}")) for t, f in SUMMARY_FIELD.items()), F.lit(""))
    return F.when(tool.isin(*SUMMARY_FIELD), known).otherwise(F.coalesce(arguments, F.lit("")))


def argument_summary(tool: Column, arguments: Column) -> Column:
    """The telling argument of a call: paths and patterns whole; commands, and what other tools got, cut to their first bytes and dots."""
    picked = telling_argument(tool, arguments)
    cut = F.decode(F.substring(F.encode(picked, "UTF-8"), 1, SUMMARY_BYTES), "UTF-8")
    long = (F.octet_length(picked) > SUMMARY_BYTES) & ~F.coalesce(tool.isin(*(t for t in SUMMARY_FIELD if t != "Bash")), F.lit(False))
    return F.when(long, F.concat(cut, F.lit("..."))).otherwise(picked)


def command_then_read(commands: DataFrame, reads: DataFrame) -> DataFrame:
    """(run_id, command_then_read): commands (run_id, i, stretch, summary) that a read (run_id, j, stretch, file) of a file that they name follows in their stretch.

    A stretch is what lies between two edits. Of a file only its last read in a stretch counts, of equal commands only the text.
    The parts of a command that are as long as some file of its stretch meet the files on equal keys, so that work grows with the
    commands (they are short) and not with their number times that of reads.
    """
    at = ["run_id", "stretch"]
    last = reads.groupBy(*at, "file").agg(F.max("j").alias("j"))
    lengths = last.groupBy(*at).agg(F.collect_set(F.char_length("file")).alias("lengths"))
    texts = commands.select(*at, "summary").distinct().join(lengths, at)
    parts = F.expr("array_distinct(flatten(transform(filter(lengths, l -> l <= char_length(summary)), l -> transform(sequence(1, char_length(summary) - l + 1), p -> substring(summary, p, l)))))")
    until = texts.select(*at, "summary", F.explode(parts).alias("file")).join(last, [*at, "file"]).groupBy(*at, "summary").agg(F.max("j").alias("until"))
    return commands.join(until, [*at, "summary"]).where("i < until").groupBy("run_id").agg(F.count("*").alias("command_then_read"))


def actions(events: DataFrame, tool: str = "grove") -> DataFrame:
    """(run_id, sequence, tool_name, summary, is_navigation, is_edit, is_tool_command) of all tool calls, in order.

    Whether a call is a command of the tool is decided on the whole command, not on its summary.
    """
    blocks = F.filter(F.coalesce(F.col("event.message.content"), F.array("event.content_block")), lambda b: b["type"] == "tool_use")
    calls = events.select("run_id", "seq", F.posexplode(blocks).alias("pos", "b")).select("run_id", "seq", "pos", F.col("b.name").alias("tool_name"), telling_argument(F.col("b.name"), F.col("b.input")).alias("whole"), argument_summary(F.col("b.name"), F.col("b.input")).alias("summary"))
    order = Window.partitionBy("run_id").orderBy("seq", "pos")
    command = (F.col("tool_name") == "Bash") & F.coalesce(F.col("whole").rlike(rf"(?:^|[\s;&|/])\Q{tool}\E\s"), F.lit(False))
    return calls.select(
        "run_id", (F.row_number().over(order) - 1).alias("sequence"), "tool_name", "summary",
        (F.col("tool_name").isin(*NAVIGATION_TOOLS) | command).alias("is_navigation"), F.col("tool_name").isin(*EDIT_TOOLS).alias("is_edit"), command.alias("is_tool_command"),
    )


def behaviour(acts: DataFrame, tool: str = "grove", near: int = 3) -> DataFrame:
    """One row of metrics for each run of actions (run_id, sequence, tool_name, summary, is_navigation, is_edit, is_tool_command).

    Order matters only through windows over one run: the first edit, how many edits came before, and the next actions.
    """
    run = Window.partitionBy("run_id").orderBy("sequence")
    numbered = acts.withColumn("i", F.row_number().over(run) - 1)
    whole = Window.partitionBy("run_id")
    edits_before = F.coalesce(F.sum(F.col("is_edit").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grep_next = F.max((F.col("tool_name") == "Grep").cast("int")).over(run.rowsBetween(1, near))
    rows = numbered.withColumns({
        "first_edit": F.min(F.when(F.col("is_edit"), F.col("i"))).over(whole), "n": F.count("*").over(whole), "edits_before": edits_before, "grep_next": F.coalesce(grep_next, F.lit(0)),
    })
    before = F.coalesce("first_edit", "n")
    count = lambda c: F.sum(c.cast("int"))
    read = F.col("tool_name") == "Read"
    command = F.col("is_tool_command")
    metrics = rows.groupBy("run_id").agg(
        F.max(before).alias("actions_before_first_edit"), count(F.col("is_navigation")).alias("navigations"), count(F.col("is_edit")).alias("edits"),
        F.countDistinct(F.when(read, F.col("summary"))).alias("unique_files_read"), count(read).alias("reads"), F.count("*").alias("total_actions"),
        count(command).alias("tool_commands"), count(command & (F.col("i") < before)).alias("tool_commands_before_first_edit"),
        count(command & F.contains("summary", F.lit(f"{tool} find")) & (F.col("grep_next") == 1)).alias("grep_after_find"),
    )
    commands = rows.where(command).select("run_id", "i", F.col("edits_before").alias("stretch"), "summary")
    again = command_then_read(commands, rows.where(read).select("run_id", F.col("i").alias("j"), F.col("edits_before").alias("stretch"), F.col("summary").alias("file")))
    asked = lambda word: rows.where(command & F.startswith(F.trim("summary"), F.lit(f"{tool} {word} "))).select("run_id", F.trim(F.substring(F.trim("summary"), len(tool) + len(word) + 3, 1 << 20)).alias("symbol"))
    both = asked("callers").join(asked("refs"), ["run_id", "symbol"], "left_semi").select("run_id").distinct().withColumn("callers_and_refs", F.lit(True))
    out = metrics.join(again, "run_id", "left").join(both, "run_id", "left")
    return out.select(
        "run_id", "actions_before_first_edit", F.when(F.col("edits") == 0, F.lit(float("inf"))).otherwise(F.col("navigations") / F.nullif("edits", F.lit(0))).alias("navigation_to_edit_ratio"),
        "unique_files_read", (F.col("reads") - F.col("unique_files_read")).alias("redundant_reads"), "total_actions", "tool_commands", "tool_commands_before_first_edit",
        F.coalesce("command_then_read", F.lit(0)).alias("command_then_read"), "grep_after_find", F.coalesce("callers_and_refs", F.lit(False)).alias("callers_and_refs"),
    )


def finite_mean(df: DataFrame, by: list[str], c: str, to: str) -> DataFrame:
    """The mean by group, infinite and NaN values taken as the group's largest finite one; infinity if none is finite."""
    bad = F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    s = df.groupBy(*by).agg(F.sum(F.when(~bad, F.col(c))).alias("s"), F.max(F.when(~bad, F.col(c))).alias("m"), F.count(F.when(bad, 1)).alias("nb"), F.count("*").alias("n"))
    return s.select(*by, F.when(F.col("m").isNull(), F.lit(float("inf"))).otherwise((F.col("s") + F.col("nb") * F.coalesce("m", F.lit(0.0))) / F.col("n")).alias(to))


def compare_behaviour(metrics: DataFrame) -> DataFrame:
    """Means and counts of metrics (condition, …) by condition."""
    means = metrics.groupBy("condition").agg(
        F.avg("actions_before_first_edit").alias("mean_actions_before_edit"), F.avg("unique_files_read").alias("mean_unique_reads"), F.avg("redundant_reads").alias("mean_redundant_reads"),
        F.avg("tool_commands").alias("mean_tool_commands"), F.sum("command_then_read").alias("command_then_read_count"), F.sum("grep_after_find").alias("grep_after_find_count"), F.sum(F.col("callers_and_refs").cast("int")).alias("callers_and_refs_count"),
    )
    return means.join(finite_mean(metrics, ["condition"], "navigation_to_edit_ratio", "mean_navigation_ratio"), "condition")


def token_report(runs: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample deviation of input tokens, and mean output tokens and reads, by group; 0 for fewer than two runs."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), zero(F.avg("input_tokens")).alias("mean_input"), zero(F.stddev_samp("input_tokens")).alias("stddev_input"), zero(F.avg("output_tokens")).alias("mean_output"), zero(F.avg("file_reads")).alias("mean_file_reads"))


def correctness_report(runs: DataFrame, by: list[str]) -> DataFrame:
    share = lambda c: F.coalesce(100 * F.avg(F.col(c).cast("int")), F.lit(0.0))
    return runs.groupBy(*by).agg(share("compilation_pass").alias("compilation_pct"), share("tests_pass").alias("tests_pct"), F.coalesce(F.avg("overall_score"), F.lit(0.0)).alias("mean_score"))


def token_decomposition(runs: DataFrame, by: list[str]) -> DataFrame:
    """Mean input, its fresh part, and the share read from a cache."""
    return runs.groupBy(*by).agg(
        F.avg("input_tokens").alias("mean_total"), F.avg(F.col("input_tokens") - F.col("cache_read")).alias("mean_fresh"), F.avg("cache_read").alias("mean_cache_read"),
        F.coalesce(F.sum("cache_read") / F.nullif(F.sum("input_tokens"), F.lit(0)), F.lit(0.0)).alias("cache_hit_rate"),
    )


def category_report(runs: DataFrame, with_name: str, without_name: str) -> DataFrame:
    """Mean input tokens of both conditions by category, and the reduction in percent; null where one is missing or 0."""
    w = runs.groupBy("category").pivot("condition", [with_name, without_name]).agg(F.avg("input_tokens"))
    a, b = F.col(with_name), F.col(without_name)
    return w.select("category", a.alias("mean_with"), b.alias("mean_without"), ((1 - a / F.nullif(b, F.lit(0.0))) * 100).alias("reduction_pct"))


def score(compiles: Column, tests: Column, coverage: Column, threshold: Column) -> Column:
    """40 + 40 + 20 points, the last in part below the coverage threshold; 50 + 50 without coverage."""
    points = lambda flag, n: F.when(flag, n).otherwise(0)
    part = F.when(coverage >= threshold, 20).when(threshold > 0, F.floor(coverage / F.nullif(threshold, F.lit(0.0)) * 20)).otherwise(0)
    return F.when(coverage.isNull(), points(compiles, 50) + points(tests, 50)).otherwise(points(compiles, 40) + points(tests, 40) + part).cast("int")

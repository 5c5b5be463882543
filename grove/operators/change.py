"""Change tracking: diffs of hashes, upserts by file, manifests, and edits read from unified diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(file_path, change): added, modified or deleted, from two tables (file_path, hash)."""
    both = current.select("file_path", F.col("hash").alias("new")).join(stored.select("file_path", F.col("hash").alias("old")), "file_path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return both.select("file_path", change.alias("change")).where("change IS NOT NULL")


def listing_changes(listings: DataFrame, state: DataFrame) -> DataFrame:
    """(project, listing, path, change): what each listing (project, listing, path, hash) added, modified or deleted.

    Every listing is compared with the one before it, the first of a project with the state (project, path, hash). A listing has
    a row without a path besides its files', so that an empty one is seen too. All listings are compared in one pass: a path's
    rows are ordered, a gap between two of them is a deletion and an addition, and one behind the last a deletion.
    """
    seen = listings.select("project", "listing").distinct()
    order = seen.select("project", "listing", F.row_number().over(Window.partitionBy("project").orderBy("listing")).alias("n"))
    numbered = listings.where("path IS NOT NULL").join(order, ["project", "listing"]).select("project", "path", "hash", "n")
    last = order.groupBy("project").agg(F.max("n").alias("last"))
    before = state.join(last.select("project"), "project", "left_semi").select("project", "path", "hash", F.lit(0).alias("n"))
    w = Window.partitionBy("project", "path").orderBy("n")
    rows = numbered.unionByName(before).withColumns({"was": F.lag("hash").over(w), "at": F.lag("n").over(w), "next": F.lead("n").over(w)}).join(last, "project")
    event = lambda n, change: F.struct(n.alias("n"), F.lit(change).alias("change"))
    came = F.when((F.col("n") > 0) & (F.col("at").isNull() | (F.col("at") < F.col("n") - 1)), event(F.col("n"), "added")).when((F.col("at") == F.col("n") - 1) & ~F.col("was").eqNullSafe(F.col("hash")), event(F.col("n"), "modified"))
    went = F.when(F.coalesce("next", F.col("last") + 1) > F.col("n") + 1, event(F.col("n") + 1, "deleted"))
    found = rows.select("project", "path", F.explode(F.filter(F.array(came, went), lambda x: x.isNotNull())).alias("e")).select("project", "path", "e.n", "e.change")
    return found.join(order, ["project", "n"]).select("project", "listing", "path", "change")


def listing_state(listings: DataFrame, state: DataFrame) -> DataFrame:
    """The state (project, path, hash) after listings: the last one of each project that has one, the old state of the others."""
    last = listings.groupBy("project").agg(F.max("listing").alias("listing"))
    new = listings.where("path IS NOT NULL").join(last, ["project", "listing"], "left_semi").select("project", "path", "hash")
    return state.join(last.select("project"), "project", "left_anti").select("project", "path", "hash").unionByName(new)


def without_files(table: DataFrame, files: DataFrame) -> DataFrame:
    """table without the rows of files (file_path)."""
    return table.join(files.select("file_path"), "file_path", "left_anti").select(*table.columns)


def upsert(table: DataFrame, rows: DataFrame, changes: DataFrame) -> DataFrame:
    """table with the rows of every changed file replaced by its new ones, and those of deleted files gone."""
    return without_files(table, changes).unionByName(rows.join(changes.where("change <> 'deleted'").select("file_path"), "file_path", "left_semi").select(*table.columns))


def upsert_hashes(stored: DataFrame, current: DataFrame, changes: DataFrame, now: Column | None = None) -> DataFrame:
    """The state (file_path, hash, indexed_at) after changes; files that didn't change keep their time."""
    stamped = current.select("file_path", "hash", (F.unix_timestamp() if now is None else now).cast("long").alias("indexed_at"))
    return upsert(stored, stamped, changes)


def index_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(symbols_added, edges_added, files_added) between two rows of counts, none below zero."""
    a = before.select(*(F.col(c).alias(f"old_{c}") for c in ("symbol_count", "edge_count", "file_count")))
    row = after.select("symbol_count", "edge_count", "file_count", *(a.select(c).scalar().alias(c) for c in a.columns))
    return row.select(*(F.greatest(F.col(f"{x}_count") - F.col(f"old_{x}_count"), F.lit(0)).alias(f"{x}s_added") for x in ("symbol", "edge", "file")))


def manifest_lines(files: DataFrame) -> DataFrame:
    """(line): hash, two spaces, path, in order of path."""
    return files.select("file_path", F.concat_ws("  ", "hash", "file_path").alias("line")).orderBy("file_path").select("line")


def parse_manifest(lines: DataFrame) -> DataFrame:
    """(file_path, hash) of lines (value); comments and blank lines are passed over."""
    parts = lines.select(F.regexp_extract("value", r"^(\S+)\s+(.+?)\s*$", 1).alias("hash"), F.regexp_extract("value", r"^(\S+)\s+(.+?)\s*$", 2).alias("file_path"))
    return parts.where("hash <> '' AND hash NOT LIKE '#%'").select("file_path", "hash")


def verify_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(file_path, problem): MISSING, MODIFIED or NEW; ERROR where a file was found but couldn't be read (null hash)."""
    m = manifest.select("file_path", F.col("hash").alias("want"), F.lit(True).alias("listed"))
    d = found.select("file_path", F.col("hash").alias("have"), F.lit(True).alias("there"))
    problem = F.when(F.col("there").isNull(), "MISSING").when(F.col("listed").isNull(), "NEW").when(F.col("have").isNull(), "ERROR").when(F.col("want") != F.col("have"), "MODIFIED")
    return m.join(d, "file_path", "full").select("file_path", problem.alias("problem")).where("problem IS NOT NULL")


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, file_path, line) of the new-side lines that unified diffs (diff_id, text) add or delete before.

    A diff is cut before each line that names a file or begins a hunk. A piece's lines are numbered inside its row: the kth that
    stays is k lines below its first, and a deleted one lies below as many as come before it. Only pieces are ordered.
    """
    pieces = diffs.select("diff_id", F.posexplode(F.split("text", r"\n(?=@@ |\+\+\+ )")).alias("pos", "piece")).withColumn("l", F.substring_index("piece", "\n", 1))
    path = F.when(F.col("l").rlike(r"^\+\+\+ "), F.regexp_replace(F.regexp_replace("l", r"^\+\+\+ (?:b/)?", ""), r"\t.*$", ""))
    start = F.when(F.col("l").rlike(r"^@@ "), F.regexp_extract("l", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).try_cast("int"))
    begun = pieces.withColumns({"path": path, "begins": start})
    is_head = lambda l, i: ((i == 0) & F.col("begins").isNotNull()) | l.rlike(r"^(\+\+\+|---|diff |index )")  # noqa: E731, E741
    deleted = lambda x: F.startswith(x["l"], F.lit("-"))
    body = F.transform(F.filter(F.split("piece", "\n"), lambda l, i: ~is_head(l, i)), lambda l, i: F.struct(l.alias("l"), i.alias("i")))  # noqa: E741
    split = begun.withColumn("body", body).withColumns({"stay": F.filter("body", lambda x: ~deleted(x)), "gone": F.filter("body", deleted)})
    added = F.filter(F.transform("stay", lambda x, k: F.when(F.startswith(x["l"], F.lit("+")), k)), lambda k: k.isNotNull())
    counted = split.select("diff_id", "pos", "path", "begins", F.size("stay").alias("n"), F.array_distinct(F.concat(added, F.transform("gone", lambda x, j: x["i"] - j))).alias("below"))
    w = Window.partitionBy("diff_id").orderBy("pos")
    placed = counted.withColumns({"file_path": F.last("path", True).over(w), "start": F.last("begins", True).over(w), "before": F.sum("n").over(w) - F.col("n")})
    placed = placed.withColumn("first", F.col("start") - F.last(F.when(F.col("begins").isNotNull(), F.col("before")), True).over(w) + F.col("before"))
    return placed.where("start IS NOT NULL AND file_path <> '/dev/null'").select("diff_id", "file_path", F.explode("below").alias("k"), "first").select("diff_id", "file_path", (F.col("first") + F.col("k")).alias("line")).distinct()


def caller_coverage(callers: DataFrame, modified: DataFrame, window: int = 5) -> DataFrame:
    """(covered, total, coverage): callers (file_path, line) with a modified line (file_path, line) within window lines.

    Lines meet in buckets as wide as the window, so that the join is on equal keys; a caller looks into three.
    """
    wide = window + 1
    c = callers.select("file_path", F.col("line").alias("at")).distinct()
    looks = c.select("file_path", "at", F.explode(F.array(*(F.floor(F.col("at") / wide) + d for d in (-1, 0, 1)))).alias("bucket"))
    m = modified.select("file_path", "line", F.floor(F.col("line") / wide).alias("bucket")).distinct()
    hit = looks.join(m, ["file_path", "bucket"]).where(F.abs(F.col("line") - F.col("at")) <= window).select("file_path", "at").distinct().withColumn("hit", F.lit(1))
    out = c.join(hit, ["file_path", "at"], "left").agg(F.count("hit").alias("covered"), F.count("*").alias("total"))
    return out.withColumn("coverage", F.when(F.col("total") > 0, F.round(F.col("covered") / F.col("total"), 4)).otherwise(1.0))

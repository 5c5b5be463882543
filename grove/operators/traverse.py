"""Bounded traversals as loops of joins over distinct frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.sources.shared import cut, stored

#: The depth that a traversal with a limit tries first.
SHALLOW = 3


def reach(first: DataFrame, steps: DataFrame, depth: int) -> DataFrame:
    """(id, depth): ids reachable from first (id, at depth 1) over steps (src, dst), each at its smallest depth.

    Every id is expanded once. A step takes the new ids that have steps at all, joins them with the steps, and drops the ids seen.
    These are stored, so that Spark knows how few they are: where it broadcasts them, no step is shuffled.
    """
    if depth <= 1:
        return first.select("id", F.lit(1).alias("depth")).distinct()
    frontier = stored(first.select("id").distinct())
    seen = frontier.select("id", F.lit(1).alias("depth"))
    sources = stored(steps.select(F.col("src").alias("id")).distinct())
    for d in range(2, depth + 1):
        going = stored(frontier.join(sources, "id", "left_semi"))
        if going.isEmpty():
            break
        found = steps.join(going, F.col("src") == F.col("id")).select(F.col("dst").alias("id")).distinct()
        frontier = found.join(seen, "id", "left_anti")
        if d < depth:
            frontier = stored(frontier)
        seen = seen.union(frontier.select("id", F.lit(d).alias("depth")))
    return seen


def simple_paths(first: DataFrame, steps: DataFrame, depth: int) -> DataFrame:
    """(path, depth): all paths without repeated ids from first (path) backwards over steps (src, dst); head is path[0].

    The number of paths is the caller's to bound, by depth: this enumerates them all.
    """
    level = cut(first.select("path").distinct()) if depth > 1 else first.select("path").distinct()
    out = level.select("path", F.lit(1).alias("depth"))
    for d in range(2, depth + 1):
        head = F.get("path", F.lit(0))
        level = level.join(steps, head == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.array_prepend("path", F.col("dst")).alias("path")).distinct()
        if d < depth:
            level = cut(level)
            if level.isEmpty():
                break
        out = out.union(level.select("path", F.lit(d).alias("depth")))
    return out


def entry_distance(heads: DataFrame, steps: DataFrame, depth: int) -> DataFrame:
    """(id, left): of the ids that heads (id) reach over steps (src, dst), the fewest steps to one that has none; those within depth - 1 only."""
    found = stored(reach(heads, steps, depth).select("id"))
    near = stored(steps.join(found.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst"))
    ends = found.join(near.select(F.col("src").alias("id")), "id", "left_anti")
    back = near.join(found.select(F.col("id").alias("dst")), "dst", "left_semi")
    return reach(ends, back.select(F.col("dst").alias("src"), F.col("src").alias("dst")), depth).select("id", (F.col("depth") - 1).alias("left"))


def paths_to_ends(first: DataFrame, steps: DataFrame, depth: int, limit: int | None = None) -> DataFrame:
    """(path, depth): the paths of simple_paths whose head has no steps, all of the shortest levels that together have limit paths.

    A path goes on only while its head can still reach an end within the depth that is left. Levels come in order of length and
    none is begun once there are enough paths. With a limit, depths of SHALLOW, twice that and so on are tried first, so that
    distances aren't sought further than the paths go.
    """
    if limit is not None and depth > SHALLOW:
        shallow = SHALLOW
        while shallow < depth:
            few = stored(paths_to_ends(first, steps, shallow))
            if few.limit(limit).count() >= limit:
                last = few.groupBy("depth").agg(F.count("*").alias("n")).collect()  # a row a level
                seen, most = 0, shallow
                for r in sorted(last):
                    seen += r["n"]
                    if seen >= limit:
                        most = r["depth"]
                        break
                return few.where(F.col("depth") <= most)
            shallow *= 2
    head = F.get("path", F.lit(0))
    level = stored(first.select("path").distinct())
    left = stored(entry_distance(level.select(head.alias("id")).distinct(), steps, depth))
    out, n = None, 0
    for d in range(1, depth + 1):
        hopeful = level.withColumn("id", head).join(left, "id").where(F.col("left") <= depth - d)
        done = hopeful.where("left = 0").select("path", F.lit(d).alias("depth"))
        out = done if out is None else out.union(done)
        if d == depth:
            break
        if limit is not None and (n := n + done.limit(limit).count()) >= limit:
            break
        going = hopeful.where("left > 0").select("path", "id")
        level = stored(going.join(steps, F.col("id") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.array_prepend("path", F.col("dst")).alias("path")).distinct())
        if level.isEmpty():
            break
    return out

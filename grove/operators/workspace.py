"""Several projects as one table with a project column: union, then global order and limit."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grove.functions import names as N
from grove.operators.graph import CodeGraph
from grove.operators.search import normalized


def federate(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One table of all members' rows; a filter on project prunes the others."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("project", F.lit(name)) for name, df in sorted(parts.items())))


def workspace_refs(parts: Mapping[str, CodeGraph], name: str, kinds: list[str] | None, limit: int) -> DataFrame:
    """References in all members, by kind and source, limited once over all."""
    found = federate({p: g.refs_of(g.wanted(name), kinds) for p, g in parts.items()})
    return found.orderBy("kind", "from_name", "project", "file_path", "line", "to_id").limit(limit)


def top_per_project(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The first most rows of each project. The ranking window is cut before its shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("project").orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def workspace_find(results: DataFrame, limit: int) -> DataFrame:
    """Search results (project, symbol_id, rank): each project's page is scored by itself, then all are merged by score."""
    page = top_per_project(results, ["rank", "symbol_id"], limit)
    return normalized(page, ["project"]).orderBy(F.desc("score"), "project", "symbol_id").limit(limit)


def workspace_core(symbols: DataFrame, limit: int) -> DataFrame:
    """Symbols (project, id, name, caller_count) with most callers over all members."""
    return top_per_project(symbols.where("caller_count > 0"), [F.desc("caller_count"), "name", "id"], 2 * limit).orderBy(F.desc("caller_count"), "name", "project", "id").limit(limit)


def workspace_status(members: DataFrame) -> DataFrame:
    """Sums over members (project, symbol_count, file_count, edge_count, last_indexed), the last time, and whether all are indexed."""
    return members.agg(
        F.count("*").alias("members"), F.sum("symbol_count").alias("symbol_count"), F.sum("file_count").alias("file_count"), F.sum("edge_count").alias("edge_count"),
        F.max("last_indexed").alias("last_indexed"), F.bool_and(F.col("last_indexed").isNotNull()).alias("indexed"),
    )


def workspace_languages(symbols: DataFrame) -> DataFrame:
    return symbols.select("language").distinct().orderBy("language")


def display_ids(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("display_id", N.workspace_id(F.col("project"), F.col("id")))

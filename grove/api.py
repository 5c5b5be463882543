"""The commands over an index, each a DataFrame, and their JSON envelopes."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from grove.operators import search, workspace
from grove.sources import tree
from grove.sources.index import Index
from grove.sources.shared import children, cut, hadoop, remove, scratch
from grove.streaming.watch import Watcher, claim, listing

SUFFIXES = tuple("." + e for e in tree.EXTENSIONS)


class NotFoundError(LookupError):
    pass


def looks_like_path(text: str) -> bool:
    return "/" in text or "\\" in text or text.endswith(SUFFIXES)


def envelope(command: str, data: DataFrame, symbol: str | None = None, limit: int | None = None) -> str:
    """{command, symbol, data, truncated, total} with data cut to limit, as one text."""
    parts: list[str] = []
    stream_envelope(parts.append, command, data, symbol, limit)
    return json.dumps(json.loads("".join(parts)), indent=2, ensure_ascii=False)


def _lines(data: DataFrame) -> DataFrame:
    return data.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def _frame(command: str, symbol: str | None, total: int, shown: int) -> tuple[str, str]:
    """What stands before and after the rows."""
    head = json.dumps({"command": command} | ({"symbol": symbol} if symbol else {}), ensure_ascii=False)
    return head[:-1] + ', "data": [', f'], "truncated": {json.dumps(total > shown)}, "total": {total}}}'


def stream_envelope(write: Callable[[str], object], command: str, data: DataFrame, symbol: str | None = None, limit: int | None = None) -> int:
    """Writes an envelope row by row; the driver holds a partition at a time. data is computed once; the total is returned."""
    rows, total = data, None
    if limit is not None:
        data = cut(data)
        total, rows = data.count(), data.limit(limit)
    write(_frame(command, symbol, 0, 0)[0])
    n = 0
    for (line,) in _lines(rows).toLocalIterator():
        write(f"{',' if n else ''}\n{line}")
        n += 1
    write(_frame(command, symbol, n if total is None else total, n)[1])
    return n if total is None else total


def write_envelope(path: str, command: str, data: DataFrame, symbol: str | None = None) -> int:
    """An envelope of all rows in a file of any store: executors write the rows, which are then joined in order, file by file.

    The rows are counted while they are written. Nothing but file blocks passes through the driver's process, and no row its Python.
    """
    spark = data.sparkSession
    counted, parts = Observation("rows"), scratch(spark, "envelope")
    _lines(data).select(F.concat(F.lit(","), "value").alias("value")).observe(counted, F.count("*").alias("n")).write.text(parts)
    total = counted.get["n"]
    head, tail = _frame(command, symbol, total, total)
    fs, target = hadoop(spark, path)
    out, copy = fs.create(target, True), spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    try:
        out.write(bytearray(head, "utf-8"))
        first = True
        for name in (n for n in children(spark, parts) if n.startswith("part-")):
            pfs, p = hadoop(spark, f"{parts}/{name}")
            if pfs.getFileStatus(p).getLen() == 0:
                continue
            rows = pfs.open(p)
            try:
                if first:
                    rows.read()  # the comma before the first row
                    first = False
                copy(rows, out, 1 << 16, False)
            finally:
                rows.close()
        out.write(bytearray(tail, "utf-8"))
    finally:
        out.close()
        remove(spark, parts)
    return total


def _watching(projects: dict[str, Project], directory: str, poll: bool) -> Watcher:
    """A started watcher that holds the directory's lock until it is stopped."""
    release = claim(directory)
    try:
        w = Watcher(projects[next(iter(projects))].spark, f"{directory}/watch", {n: p.root for n, p in projects.items()}, lambda n: projects[n].reindex(), lambda n, number: projects[n]._listing(n, number), release=release)
        for name in projects:
            w.first(name)
        return w.start(poll)
    except BaseException:
        release()
        raise


@dataclass
class Project:
    """A source tree and its index in <root>/.grove, or elsewhere."""

    spark: SparkSession
    root: str
    index_path: str | None = None

    def __post_init__(self) -> None:
        self.index = Index(self.spark, self.index_path or f"{self.root.rstrip('/')}/{tree.CONFIG_DIR}/index")

    def config(self) -> tree.ProjectConfig:
        path = os.path.join(self.root, tree.CONFIG_DIR, tree.CONFIG_FILE)
        if not os.path.exists(path):
            return tree.ProjectConfig(name=os.path.basename(self.root.rstrip("/")))
        with open(path) as f:
            return tree.load_project(f.read())

    def init(self) -> dict:
        """Writes a configuration with the languages that marker files show; refuses to replace one."""
        path = os.path.join(self.root, tree.CONFIG_DIR, tree.CONFIG_FILE)
        if os.path.exists(path):
            raise FileExistsError(path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        name, languages = os.path.basename(os.path.abspath(self.root)), tree.detect_languages(self.root)
        with open(path, "w") as f:
            f.write(f"[project]\nname = {json.dumps(name)}\nlanguages = {json.dumps(languages)}\n\n[index]\nignore = {json.dumps(list(tree.DEFAULT_IGNORE))}\n")
        return {"name": name, "languages": languages}

    def _scope(self) -> tuple[list[str], list[str] | None, list[str]]:
        """Ignore patterns, languages, and the projects below whose files aren't this one's."""
        c = self.config()
        ignore = os.path.join(self.root, ".gitignore")
        own = []
        if os.path.exists(ignore):
            with open(ignore) as f:
                own = tree.gitignore(f.read())
        return c.ignore + own, c.languages or None, tree.nested_projects(self.spark, self.root)

    def reindex(self, full: bool = False) -> dict:
        return self.index.refresh(self.root, *self._scope(), full)

    def _listing(self, name: str, number: int) -> DataFrame:
        return listing(self.spark, name, self.root, number, *self._scope())

    def watch(self, poll: bool = True) -> Watcher:
        """Indexes what changed since, and then whatever changes until the watcher is stopped. One watcher a project."""
        return _watching({"project": self}, f"{self.root.rstrip('/')}/{tree.CONFIG_DIR}", poll)

    def _files(self) -> DataFrame:
        return tree.read_files(self.spark, self.root).select("file_path", F.decode("content", "UTF-8").alias("text"))

    def _known(self, name: str) -> None:
        if self.index.graph().find_symbol(name).isEmpty():
            raise NotFoundError(f"no symbol {name!r} in the index")

    def sketch(self, target: str, limit: int = 50, no_docs: bool = False) -> DataFrame:
        if looks_like_path(target):
            return self.index.graph().file_sketch(target)
        self._known(target)
        return self.index.graph().whole_sketch(target, limit, not no_docs)

    def refs(self, target: str, kind: str | None = None, limit: int | None = 20, context: int = 0) -> DataFrame:
        g, kinds = self.index.graph(), [kind] if kind else None
        if looks_like_path(target):
            found = g.file_refs(target, kinds, limit)
        else:
            self._known(target)
            found = g.refs(target, kinds, limit)
        return tree.snippets(found, self._files(), context)

    def callers(self, target: str, depth: int = 1, limit: int | None = 20, context: int = 0) -> DataFrame:
        self._known(target)
        found = self.index.graph().callers(target, depth, limit)
        return tree.snippets(found, self._files(), context) if depth <= 1 else found

    def deps(self, target: str, depth: int = 1) -> DataFrame:
        if looks_like_path(target):
            return self.index.graph().file_deps(target, depth)
        self._known(target)
        return self.index.graph().deps(target, depth)

    def rdeps(self, target: str, depth: int = 1) -> DataFrame:
        return self.impact(target, depth)

    def impact(self, target: str, depth: int = 3) -> DataFrame:
        if looks_like_path(target):
            return self.index.graph().file_impact(target, depth)
        self._known(target)
        return self.index.graph().impact(target, depth)

    def trace(self, target: str, max_depth: int = 10, limit: int = 20) -> DataFrame:
        self._known(target)
        g = self.index.graph()
        return g.path_steps(g.trace(target, max_depth, limit))

    def find(self, query: str, kind: str | None = None, limit: int = 10) -> DataFrame:
        return search.with_lines(search.bm25(self.index.text(), query, kind, limit), self.index.table("symbols")).orderBy("rank", "symbol_id")

    def similar(self, target: str, kind: str | None = None, limit: int = 10) -> DataFrame:
        self._known(target)
        return search.similar(self.index.graph(), self.index.text(), target, kind, limit)

    def source(self, target: str) -> DataFrame:
        self._known(target)
        spans = self.index.graph().find_symbol(target).select("file_path", "line_start", "line_end")
        return tree.source_lines(self._files(), spans).orderBy("line_no")

    def entrypoints(self) -> DataFrame:
        return self.index.graph().collapsed_entrypoints().select("entry_group", "id", "name", "kind", "file_path", "fan_out", "method_count")

    def map(self, limit: int = 10) -> dict[str, DataFrame]:
        g = self.index.graph()
        return {"counts": g.counts(), "languages": g.languages(), "entrypoints": g.entrypoint_groups(), "core_symbols": g.core_symbols(limit).select("name", "kind", "file_path", "caller_count"), "architecture": g.directory_stats()}

    def status(self) -> DataFrame:
        from grove.functions.names import relative_time

        g = self.index.graph()
        return g.counts().withColumn("last_indexed", g.last_indexed().scalar()).withColumn("indexed", F.col("last_indexed").isNotNull()).withColumn("age", relative_time(F.col("last_indexed"), F.lit(int(time.time()))))


@dataclass
class Workspace:
    """Members of a manifest, each a project of its own."""

    spark: SparkSession
    root: str

    def members(self) -> dict[str, Project]:
        with open(os.path.join(self.root, tree.WORKSPACE_FILE)) as f:
            _, members = tree.load_workspace(f.read())
        return {m.name: Project(self.spark, os.path.join(self.root, m.path)) for m in members}

    def init(self, name: str | None = None) -> dict:
        """A manifest of the projects below root."""
        found = tree.nested_projects(self.spark, self.root)
        with open(os.path.join(self.root, tree.WORKSPACE_FILE), "x") as f:
            f.write(f"[workspace]\nname = {json.dumps(name or os.path.basename(os.path.abspath(self.root)))}\nversion = 1\n" + "".join(f"\n[[workspace.members]]\npath = {json.dumps(p)}\n" for p in found))
        return {"members": found}

    def reindex(self, full: bool = False) -> dict[str, dict]:
        return {n: p.reindex(full) for n, p in self.members().items()}

    def watch(self, poll: bool = True) -> Watcher:
        """One watcher for all members that have a configuration; a member that fails is tried again and stops no other."""
        named = {n: p for n, p in self.members().items() if os.path.exists(os.path.join(p.root, tree.CONFIG_DIR, tree.CONFIG_FILE))}
        if not named:
            raise ValueError("no member of the workspace has a configuration")
        os.makedirs(os.path.join(self.root, tree.CONFIG_DIR), exist_ok=True)
        return _watching(named, os.path.join(self.root, tree.CONFIG_DIR), poll)

    def status(self) -> DataFrame:
        return workspace.workspace_status(workspace.federate({n: p.status() for n, p in self.members().items()}))

    def list(self) -> DataFrame:
        return workspace.federate({n: p.status() for n, p in self.members().items()}).select("project", "indexed", "symbol_count", "file_count", "age")

    def refs(self, name: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        return workspace.workspace_refs({n: p.index.graph() for n, p in self.members().items()}, name, [kind] if kind else None, limit)

    def find(self, query: str, kind: str | None = None, limit: int = 10) -> DataFrame:
        return workspace.workspace_find(workspace.federate({n: search.ranks(p.index.text(), query, kind) for n, p in self.members().items()}), limit)

    def entrypoints(self) -> DataFrame:
        return workspace.federate({n: p.index.graph().entrypoints() for n, p in self.members().items()})

    def core_symbols(self, limit: int = 10) -> DataFrame:
        parts = {n: (g := p.index.graph()).summed_callers(g.symbols.where("kind IN ('function', 'method')")) for n, p in self.members().items()}
        return workspace.workspace_core(workspace.federate(parts), limit)

    def map(self, limit: int = 10) -> dict[str, DataFrame]:
        dirs = workspace.federate({n: p.index.graph().directory_stats() for n, p in self.members().items()})
        symbols = workspace.federate({n: p.index.table("symbols") for n, p in self.members().items()})
        return {"status": self.status(), "languages": workspace.workspace_languages(symbols), "core_symbols": self.core_symbols(limit), "architecture": dirs.orderBy(F.desc("symbol_count"), "project", "directory")}

"""An index on disk: symbols, edges, file hashes and text documents as Parquet, refreshed whole or by changed files.

Each table is dealt into buckets by file, and each bucket is a folder that never changes. A refresh parses the files whose hash
changed, writes anew the buckets that hold them, and publishes a manifest in which all other buckets are those of before. The
text index is a list of segments in the same manifest. A version counts once its folder has the mark that is written last; so
readers see one state, and a job that is lost at any point leaves the last one.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove import schema
from grove.operators import change
from grove.operators.graph import CodeGraph
from grove.operators.search import TextIndex, search_documents
from grove.sources.extract import extracted_rows, split_rows
from grove.sources.segments import SegmentedText
from grove.sources.shared import children, hadoop, put_text, read_text, remove
from grove.sources.tree import hashed, read_files

#: The file that marks a version as complete, and how many versions stay, so that readers of an older one can finish.
DONE, KEPT = "DONE", 3
#: Buckets of a table: at least so many, one more for so many files, and at most so many.
LEAST_BUCKETS, FILES_A_BUCKET, MOST_BUCKETS = 64, 2_000, 4_096
TABLES = {"symbols": schema.SYMBOLS, "edges": schema.EDGES, "files": schema.FILES}
#: The order within a bucket, so that row groups of other names are skipped.
ORDER = {"symbols": ("name", "id"), "edges": ("to_id", "from_id"), "files": ("file_path",)}


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("file_path"), F.lit(buckets)).cast("int")


class Index:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> str | None:
        return max(self._versions(), default=None)

    def _versions(self) -> list[str]:
        """Names of the complete versions; they sort by age."""
        fs, p = hadoop(self.spark, f"{self.path}/v-*/{DONE}")
        return [s.getPath().getParent().getName() for s in fs.globStatus(p) or []]

    def manifest(self, version: str | None = None) -> dict | None:
        """{buckets, tables: {table: {bucket: the version that wrote it}}, text} of a version, else of the current one."""
        v = version or self.version()
        return json.loads(read_text(self.spark, f"{self.path}/{v}/manifest.json")) if v else None

    def _folders(self, manifest: dict, name: str, wanted: set[int] | None = None) -> list[str]:
        return [f"{self.path}/data/{name}/{v}/bucket={b}" for b, v in manifest["tables"][name].items() if wanted is None or int(b) in wanted]

    def _rows(self, manifest: dict | None, name: str, wanted: set[int] | None = None) -> DataFrame:
        folders = self._folders(manifest, name, wanted) if manifest else []
        return self.spark.read.schema(TABLES[name]).parquet(*folders) if folders else self.spark.createDataFrame([], TABLES[name])

    def table(self, name: str) -> DataFrame:
        """A table of the current version; empty before the first index."""
        return self._rows(self.manifest(), name)

    def graph(self) -> CodeGraph:
        m = self.manifest()
        return CodeGraph(*(self._rows(m, t) for t in TABLES))

    def text(self) -> TextIndex:
        return SegmentedText.of(self.spark, f"{self.path}/text", (self.manifest() or {}).get("text")).index()

    def _write(self, v: str, name: str, rows: DataFrame, buckets: int) -> dict[str, str]:
        """The rows in folders by bucket, and which buckets have any."""
        at = f"{self.path}/data/{name}/{v}"
        dealt = rows.withColumn("bucket", bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket", *ORDER[name])
        dealt.write.partitionBy("bucket").parquet(at)
        return {n.removeprefix("bucket="): v for n in children(self.spark, at) if n.startswith("bucket=")}

    def publish(self, symbols: DataFrame, edges: DataFrame, files: DataFrame, last: dict | None = None, touched: set[int] | None = None) -> None:
        """A new version of these tables. touched: they are those buckets alone, and all others stay as in the manifest last."""
        newest = self.version()
        number = max(int(time.time() * 1000), int(newest.split("-")[1]) + 1 if newest else 0)
        v = f"v-{number:015d}-{uuid.uuid4().hex[:6]}"
        rows = dict(zip(TABLES, (symbols, edges, files), strict=True))
        kept = last if last and touched is not None else None
        buckets = kept["buckets"] if kept else min(MOST_BUCKETS, max(LEAST_BUCKETS, files.count() // FILES_A_BUCKET))
        tables = {}
        for name, df in rows.items():
            old = {b: w for b, w in kept["tables"][name].items() if int(b) not in touched} if kept else {}
            tables[name] = old | self._write(v, name, df, buckets)
        manifest = {"buckets": buckets, "tables": tables}
        graph = CodeGraph(*(self._rows(manifest, t) for t in TABLES))
        text = SegmentedText.of(self.spark, f"{self.path}/text", kept["text"] if kept else None)
        manifest["text"] = text.updated(search_documents(graph)).state()
        put_text(self.spark, f"{self.path}/{v}/manifest.json", json.dumps(manifest))
        put_text(self.spark, f"{self.path}/{v}/{DONE}", "")
        self._clean()

    def _clean(self) -> None:
        """Removes old versions, and the buckets and segments that no version left has."""
        every = sorted(self._versions())
        left = [self.manifest(v) for v in every[-KEPT:]]
        for old in every[:-KEPT]:
            remove(self.spark, f"{self.path}/{old}")
        for name in TABLES:
            used = {(w, b) for m in left for b, w in m["tables"][name].items()}
            for w in children(self.spark, f"{self.path}/data/{name}"):
                if w <= every[-1]:
                    mine = {f"bucket={b}" for x, b in used if x == w}
                    if not mine:
                        remove(self.spark, f"{self.path}/data/{name}/{w}")
                    else:
                        for b in children(self.spark, f"{self.path}/data/{name}/{w}"):
                            if b.startswith("bucket=") and b not in mine:
                                remove(self.spark, f"{self.path}/data/{name}/{w}/{b}")
        segments = {s["name"] for m in left for s in m["text"]["segments"]}
        for s in children(self.spark, f"{self.path}/text"):
            if s not in segments:
                remove(self.spark, f"{self.path}/text/{s}")

    def _replace(self, changes: DataFrame, symbols: DataFrame, edges: DataFrame, current: DataFrame) -> None:
        """Publishes the tables with the rows of changed files (file_path, change) replaced: only their buckets are read and written."""
        last = self.manifest()
        touched = {r["b"] for r in changes.select(bucket(last["buckets"]).alias("b")).distinct().collect()}  # at most MOST_BUCKETS numbers
        here = lambda name: self._rows(last, name, touched)
        files = change.upsert_hashes(here("files"), current, changes)
        self.publish(change.without_files(here("symbols"), changes).unionByName(symbols), change.without_files(here("edges"), changes).unionByName(edges), files, last, touched)

    def refresh(self, root: str, patterns: list[str] | None = None, languages: list[str] | None = None, nested: list[str] | None = None, full: bool = False) -> dict:
        """Indexes what changed under root, or everything; {added, modified, deleted} files, and what the index grew by."""
        files = read_files(self.spark, root, patterns, languages, nested)
        current = hashed(files)
        old = self.graph()
        stored = old.files if not full else old.files.limit(0)
        changes = change.changed_files(current, stored).persist()
        counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
        if not counts and not full:
            changes.unpersist()
            return {"added": 0, "modified": 0, "deleted": 0}
        parsed = extracted_rows(files.join(changes.where("change <> 'deleted'").select("file_path"), "file_path", "left_semi")).persist()
        symbols, edges = split_rows(parsed)
        before = None if full else old.counts().first()
        if full or self.version() is None:
            self.publish(symbols, edges, change.upsert_hashes(stored, current, changes))
        else:
            self._replace(changes, symbols, edges, current)
        parsed.unpersist()
        changes.unpersist()
        after = self.graph().counts().first()
        grown = {c: max(0, after[c] - (before[c] if before else 0)) for c in ("symbol_count", "edge_count", "file_count")}
        return {k: counts.get(k, 0) for k in ("added", "modified", "deleted")} | grown

    def delete_files(self, paths: list[str]) -> None:
        if self.version() is None:
            return
        gone = self.spark.createDataFrame([(p, "deleted") for p in paths], "file_path string, change string")
        none = {t: self.spark.createDataFrame([], s) for t, s in TABLES.items()}
        self._replace(gone, none["symbols"], none["edges"], none["files"].select("file_path", "hash"))

    def clear(self) -> None:
        remove(self.spark, self.path)

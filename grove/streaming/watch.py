"""Watching trees: listings become changes, changes quiet batches, and each batch refreshes an index.

    listings  ->  changes: a state table holds path and hash of the last listing of each project
              ->  batches: session windows of a quiet time by project
              ->  refresh: once a batch, and again at the next one where it failed

Both steps are streaming queries with checkpoints. A listing and the events of an epoch appear by one rename, and an epoch that
is run again finds its events there; so a restart repeats none and loses none.
"""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Callable
from contextlib import suppress
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from grove.operators import change
from grove.sources.shared import children, hadoop, put, put_text, read_text, remove
from grove.sources.tree import hashed, in_ignored_component, read_files

QUIET, DELAY = "300 milliseconds", "1 second"
#: Listings and states that stay on disk.
KEPT = 3
#: What ends one project's listing or refresh, and not the watcher.
FAILURES = (PySparkException, Py4JJavaError, OSError, ValueError)
LISTINGS = "project string, listing long, path string, hash string"
CHANGES = "project string, listing long, path string, change string, ts timestamp"
STATE = "project string, path string, hash string"


def listing(spark: SparkSession, project: str, root: str, number: int, patterns: list[str] | None = None, languages: list[str] | None = None, nested: list[str] | None = None) -> DataFrame:
    """A project's files and their hashes as of now, read where Spark reads; and a row without a path."""
    files = hashed(read_files(spark, root, patterns, languages, nested)).select(F.col("file_path").alias("path"), "hash")
    head = spark.range(1).select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("hash"))
    return files.unionByName(head).select(F.lit(project).alias("project"), F.lit(number).cast("long").alias("listing"), "path", "hash")


def relevant(events: DataFrame, ignore: list[str], extensions: list[str]) -> DataFrame:
    return events.where(~in_ignored_component(F.col("path"), ignore) & F.substring_index("path", ".", -1).isin(*extensions))


def debounced(events: DataFrame, quiet: str = QUIET, watermark: str = "10 seconds") -> DataFrame:
    """(project, start, end, paths, events): batches of distinct paths, each closed by a quiet time. For streams and tables.

    On a stream a batch comes out once the watermark has passed its end.
    """
    source = events.withWatermark("ts", watermark) if events.isStreaming else events
    batches = source.groupBy("project", F.session_window("ts", quiet).alias("w")).agg(F.sort_array(F.collect_set("path")).alias("paths"), F.count("*").alias("events"))
    return batches.select("project", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths", "events")


class EventLog(StreamingQueryListener):
    """Start, reindex and stop events of one named query, each a JSON file in a folder; stop has the totals of all reindex events.

    A reindex event's file has the name of its epoch and project, so that an epoch that is run again counts once.
    """

    def __init__(self, spark: SparkSession, path: str, query: str) -> None:
        self.spark, self.path, self.query, self.run = spark, path, query, None
        self.stopped = threading.Event()

    def write(self, name: str, event: dict) -> None:
        put_text(self.spark, f"{self.path}/{name}.json", json.dumps(event | {"at": int(time.time() * 1000)}))

    def onQueryStarted(self, event) -> None:
        if event.name == self.query:
            self.run, self.began = event.runId, time.time()
            self.write(f"start-{self.run}", {"event": "start"})

    def onQueryProgress(self, event) -> None:
        """Reindex events come from the batches themselves, which know what a refresh changed."""

    def onQueryIdle(self, event) -> None:
        """Nothing to write."""

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            total = self.totals()
            self.write(f"stop-{self.run}", {"event": "stop", "uptime_seconds": int(time.time() - self.began), "error": event.exception} | total)
            self.stopped.set()

    def reindex(self, epoch: str, project: str, found: dict) -> None:
        safe = "".join(c if c.isalnum() else "_" for c in project)
        self.write(f"reindex-{epoch}-{safe}", {"event": "reindex", "epoch": epoch, "project": project} | found)

    def failed(self, project: str, error: Exception) -> None:
        self.write(f"error-{time.time_ns()}", {"event": "error", "project": project, "error": str(error).splitlines()[0][:500] if str(error) else type(error).__name__})

    def totals(self) -> dict:
        """Read back from the files, small ones, one a batch."""
        fs, p = hadoop(self.spark, f"{self.path}/reindex-*.json")
        counts = [json.loads(read_text(self.spark, str(s.getPath()))) for s in fs.globStatus(p) or []]
        return {"total_reindexes": len(counts), "total_files_processed": sum(c["files_changed"] for c in counts)}

    def events(self) -> DataFrame:
        return self.spark.read.json(f"{self.path}/*.json")


@dataclass
class Watcher:
    """Watches projects (name to root) and refreshes them; state, events and checkpoints stand below path.

    list_files gives a project's listing, refresh indexes what changed in one. A project whose listing or refresh fails is logged
    and tried again, and stops none of the others: without a listing it has no changes, and what a refresh missed the next finds.
    """

    spark: SparkSession
    path: str
    roots: dict[str, str]
    refresh: Callable[[str], dict]
    list_files: Callable[[str, int], DataFrame] | None = None
    quiet: str = QUIET
    delay: str = DELAY
    interval: float = 0.3
    release: Callable[[], None] | None = None
    again: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.clock = max([int(n) for d in ("listings", "closed") for n in children(self.spark, f"{self.path}/{d}") if n.isdigit()], default=0)
        self.log = EventLog(self.spark, f"{self.path}/log", f"batches of {self.path}")
        self._changes: StreamingQuery | None = None
        self._batches: StreamingQuery | None = None
        self._thread: threading.Thread | None = None
        self._done, self._one = threading.Event(), threading.Lock()

    # Listings and their changes

    def poll(self) -> int:
        """Lists all projects once; the number of those that could be read. Times never run back, so that no change is late."""
        read = 0
        for project, root in self.roots.items():
            self.clock = max(int(time.time() * 1000), self.clock + 1)
            try:
                rows = self.list_files(project, self.clock) if self.list_files else listing(self.spark, project, root, self.clock)
                put(rows, f"{self.path}/listings/{self.clock}")
                read += 1
            except FAILURES as e:
                self.log.failed(project, e)
        if self._changes:
            self._changes.processAllAvailable()
            for old in [n for n in children(self.spark, f"{self.path}/listings") if n.isdigit()][: -KEPT * len(self.roots)]:
                remove(self.spark, f"{self.path}/listings/{old}")
        for project in sorted(self.again):
            self._refresh(f"retry-{self.clock}", project, 0)
        return read

    def changes(self, df: DataFrame, epoch: int) -> None:
        """An epoch's events, and the state after it. Both are made from the state before, whatever of them is there already."""
        before = self.spark.read.schema(STATE).parquet(f"{self.path}/state/{epoch - 1}") if epoch and str(epoch - 1) in children(self.spark, f"{self.path}/state") else self.spark.createDataFrame([], STATE)
        rows = df.persist()
        try:
            put(change.listing_state(rows, before), f"{self.path}/state/{epoch}")
            events = change.listing_changes(rows, before).withColumn("ts", F.timestamp_millis("listing"))
            put(events, f"{self.path}/events/{epoch}")
        finally:
            rows.unpersist()
        for old in [n for n in children(self.spark, f"{self.path}/state") if n.isdigit() and int(n) <= epoch - KEPT]:
            remove(self.spark, f"{self.path}/state/{old}")

    def events(self) -> DataFrame:
        """All change events so far."""
        return self.spark.read.schema(CHANGES).parquet(f"{self.path}/events/*").where("path IS NOT NULL")

    # Batches

    def batch(self, df: DataFrame, epoch: int) -> None:
        found = df.where(F.size("paths") > 0).groupBy("project").agg(F.sum(F.size("paths")).alias("n")).collect()  # a number a project
        for r in sorted(found):
            if r["project"] in self.roots:
                self._refresh(str(epoch), r["project"], r["n"])

    def _refresh(self, epoch: str, project: str, changed: int) -> None:
        with self._one:
            try:
                began = time.time()
                done = self.refresh(project)
                self.log.reindex(epoch, project, {"files_changed": changed, "duration_ms": int((time.time() - began) * 1000)} | done)
                self.again.discard(project)
            except FAILURES as e:
                self.again.add(project)
                self.log.failed(project, e)

    def first(self, project: str) -> None:
        """The index as it is before the first listing; not counted as a batch."""
        with self._one:
            try:
                self.refresh(project)
            except FAILURES as e:
                self.again.add(project)
                self.log.failed(project, e)

    # Running

    def start(self, poll: bool = True) -> Watcher:
        """Starts both queries, and a thread that lists the projects at intervals unless the caller polls."""
        for d in ("listings", "events", "closed"):
            fs, p = hadoop(self.spark, f"{self.path}/{d}")
            fs.mkdirs(p)
        self.spark.streams.addListener(self.log)
        listings = self.spark.readStream.schema(LISTINGS).parquet(f"{self.path}/listings/[0-9]*")
        self._changes = listings.writeStream.foreachBatch(self.changes).option("checkpointLocation", f"{self.path}/checkpoint-changes").start()
        events = self.spark.readStream.schema(CHANGES).parquet(f"{self.path}/events/[0-9]*")
        batches = debounced(events, self.quiet, self.delay)
        self._batches = batches.writeStream.queryName(self.log.query).foreachBatch(self.batch).option("checkpointLocation", f"{self.path}/checkpoint-batches").outputMode("append").start()
        if poll:
            self._thread = threading.Thread(target=self._poll_on, daemon=True)
            self._thread.start()
        return self

    def _poll_on(self) -> None:
        while not self._done.wait(self.interval):
            self.poll()

    def settle(self) -> None:
        """Waits until all listings so far have been turned into events, and these into the batches that are closed."""
        self._changes.processAllAvailable()
        self._batches.processAllAvailable()

    def drain(self) -> None:
        """Closes the open batches: an event without a path, late enough to move the watermark past their ends."""
        self._changes.processAllAvailable()
        self.clock = max(self.clock, int(time.time() * 1000)) + sum(_millis(self.spark, t) for t in (self.quiet, self.delay)) + 1
        last = self.spark.createDataFrame([(p, self.clock, None, "closing") for p in self.roots], "project string, listing long, path string, change string")
        put(last.withColumn("ts", F.timestamp_millis("listing")), f"{self.path}/events/{self.clock}")
        put_text(self.spark, f"{self.path}/closed/{self.clock}", "")
        self._batches.processAllAvailable()

    def stop(self) -> None:
        """Polls no more, drains what is pending, exactly once, and stops both queries."""
        self._done.set()
        if self._thread:
            self._thread.join()
        self.drain()
        for q in (self._changes, self._batches):
            q.stop()
            with suppress(PySparkException):
                q.awaitTermination(60)
        self.log.stopped.wait(30)
        self.spark.streams.removeListener(self.log)
        if self.release:
            self.release()


def _millis(spark: SparkSession, text: str) -> int:
    return int(spark.range(1).select((F.unix_millis(F.expr(f"timestamp'1970-01-01 00:00:00Z' + interval '{text}'"))).alias("ms")).first()["ms"])


def watch(batches: DataFrame, refresh: Callable[[DataFrame], dict], log: Callable[[dict], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """For batches of any other source: runs refresh for every micro-batch that has rows, and logs a start and a reindex event."""
    log({"event": "start"})

    def run(df: DataFrame, epoch: int) -> None:
        if not df.isEmpty():
            changed = df.agg(F.sum(F.size("paths"))).first()[0]
            log({"event": "reindex", "epoch": epoch, "changed": changed} | refresh(df))

    writer = batches.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=QUIET)).start()


def claim(directory: str) -> Callable[[], None]:
    """One watcher on a directory: a lock file with its process id; a dead process's lock is taken over once."""
    path = os.path.join(directory, "watch.lock")
    for _ in range(2):
        try:
            fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            with open(path) as f:
                pid = f.read().strip()
            if pid.isdigit() and os.path.exists(f"/proc/{pid}"):
                raise RuntimeError(f"another watcher is running (process {pid})") from None
            os.unlink(path)
            continue
        with os.fdopen(fd, "w") as f:
            f.write(str(os.getpid()))
        return lambda: os.unlink(path)
    raise RuntimeError("the lock could not be taken")

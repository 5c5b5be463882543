"""A text index in segments: a refresh writes what changed, and readers see the newest of each document.

A segment has documents, their lengths and their postings, each file in order of terms, and the ids that it takes out of all segments
before it. Segments never change. Whenever the last but one has at most GROWTH times the documents of the last, both are merged:
so there are about log(documents) segments, and each document is written about as often. The list of segments, with the
number and the summed length of all living documents, belongs to the index version that reads them.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.operators.search import TextIndex, build_index

GROWTH = 2
#: Bytes of text from which a segment's postings get one more file, up to Spark's number of shuffle partitions.
FILE_BYTES = 4 << 20
DOCS = "symbol_id string, name string, kind string, file_path string, digest long"
POSTINGS = "term string, symbol_id string, col int, positions array<int>"
LENGTHS = "symbol_id string, length long"
GONE = "symbol_id string"


@dataclass
class Segment:
    """docs: the documents it was written with; gone: whether it takes ids out of those before it."""

    name: str
    docs: int
    gone: bool


@dataclass
class SegmentedText:
    """The segments of one version, oldest first; n and total count the living documents and their terms."""

    spark: SparkSession
    path: str
    segments: list[Segment]
    n: int = 0
    total: int = 0
    stemmed: bool = True

    @classmethod
    def of(cls, spark: SparkSession, path: str, state: dict | None = None, stemmed: bool = True) -> SegmentedText:
        state = state or {"segments": [], "n": 0, "total": 0}
        return cls(spark, path, [Segment(**s) for s in state["segments"]], state["n"], state["total"], stemmed)

    def state(self) -> dict:
        return {"segments": [asdict(s) for s in self.segments], "n": self.n, "total": self.total}

    def _read(self, segments: list[Segment], part: str, schema: str) -> DataFrame:
        """The rows of a part with the place of their segment."""
        each = [self.spark.read.schema(schema).parquet(f"{self.path}/{s.name}/{part}").withColumn("seq", F.lit(self.segments.index(s))) for s in segments]
        out = each[0] if each else self.spark.createDataFrame([], f"{schema}, seq int")
        for e in each[1:]:
            out = out.union(e)
        return out

    def _gone(self) -> DataFrame:
        """(symbol_id, until): the last segment that takes an id out of those before it."""
        return self._read([s for s in self.segments if s.gone], "gone", GONE).groupBy("symbol_id").agg(F.max("seq").alias("until"))

    def living(self, part: str, schema: str, segments: list[Segment] | None = None) -> DataFrame:
        """A part's rows that no later segment takes out; filters on them, as on ranges of terms, still reach the files."""
        rows, gone = self._read(self.segments if segments is None else segments, part, schema), self._gone()
        if not any(s.gone for s in self.segments):
            return rows.drop("seq")
        return rows.join(gone, (rows["symbol_id"] == gone["symbol_id"]) & (rows["seq"] < gone["until"]), "left_anti").drop("seq")

    def index(self) -> TextIndex:
        return TextIndex(self.living("docs", DOCS), self.living("postings", POSTINGS), self.living("lengths", LENGTHS), stemmed=self.stemmed, unaccented=self.stemmed, counted=(self.n, self.total))

    def _segment(self, docs: DataFrame, postings: DataFrame, lengths: DataFrame, gone: DataFrame | None) -> Segment:
        name = f"s-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        docs.write.parquet(f"{at}/docs")
        postings.sortWithinPartitions("term").write.parquet(f"{at}/postings")
        lengths.write.parquet(f"{at}/lengths")
        if gone is not None:
            gone.write.parquet(f"{at}/gone")
        return Segment(name, self.spark.read.schema(DOCS).parquet(f"{at}/docs").count(), gone is not None)

    @staticmethod
    def digested(docs: DataFrame) -> DataFrame:
        return docs.withColumn("digest", F.xxhash64("name", "kind", "file_path", "body"))

    def updated(self, docs: DataFrame) -> SegmentedText:
        """The index of docs (symbol_id, name, kind, file_path, body): one more segment with those that changed, then merges."""
        # dealt by id, since a table may come as one row group, whose texts one task would cut into terms
        new = self.digested(docs).repartition("symbol_id").persist()
        try:
            old = self.living("docs", DOCS).select("symbol_id", F.col("digest").alias("was"))
            diff = new.select("symbol_id", "digest").join(old, "symbol_id", "full").where(~F.col("digest").eqNullSafe(F.col("was"))).persist()
            came = new.join(diff.where("digest IS NOT NULL").select("symbol_id"), "symbol_id", "left_semi")
            gone = diff.where("was IS NOT NULL").select("symbol_id")
            removed = self.living("lengths", LENGTHS).join(gone, "symbol_id", "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first() if self.segments else {"n": 0, "total": 0}
            if diff.isEmpty():
                return self
            size = came.agg(F.sum(F.octet_length("body"))).first()[0] or 0
            came = came.coalesce(max(math.ceil(size / FILE_BYTES), 1))
            built = build_index(came, self.stemmed, self.stemmed)
            kinds = [f.split()[0] for f in DOCS.split(", ")]
            segment = self._segment(came.select(*kinds), built.postings.select(*(f.split()[0] for f in POSTINGS.split(", "))), built.lengths, gone if self.segments else None)
            added = self.spark.read.schema(LENGTHS).parquet(f"{self.path}/{segment.name}/lengths").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first()
            diff.unpersist()
        finally:
            new.unpersist()
        return replace(self, segments=[*self.segments, segment], n=self.n - removed["n"] + added["n"], total=self.total - removed["total"] + added["total"]).merged()

    def merged(self) -> SegmentedText:
        """The same index, with the last segments made one while they are of like size."""
        out = self
        while len(out.segments) > 1 and out.segments[-2].docs <= GROWTH * out.segments[-1].docs:
            pair = out.segments[-2:]
            first = len(out.segments) == 2
            gone = None if first else out._read([s for s in pair if s.gone], "gone", GONE).select("symbol_id").distinct()
            one = out._segment(*(out.living(p, s, pair) for p, s in (("docs", DOCS), ("postings", POSTINGS), ("lengths", LENGTHS))), gone)
            out = replace(out, segments=[*out.segments[:-2], one])
        return out

"""A bounded sample of labelled rows, and what both classifiers do with a trained model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import held_out, id_text, small_batches, trim


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most limit labels, those of smallest id hash, whose rows are not held out.

    Only the label's 0 or 1 and the id are used; other labels and null ids are passed over. The sample's bound lets the join
    broadcast it.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    few = known.where(~held_out("doc_id", mod, rest)).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(limit)
    return id_text(docs).join(F.broadcast(few), "doc_id")


def examples(rows: DataFrame, features: Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Sparse examples on the driver, in an order that doesn't depend on the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = zip(*features(b.column("text").to_pylist()), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([v.astype("<u4").tobytes() for v in at], pa.binary()), pa.array([v.astype("<f4").tobytes() for v in x], pa.binary())], names=["doc_id", "y", "at", "x"])

    got = rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, at binary, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["at"])))
    return [(np.frombuffer(r["at"], "<u4"), np.frombuffer(r["x"], "<f4"), r["y"]) for r in got]


def scored(docs: DataFrame, scores: Callable[[list[str]], list[float]], mod: int, rest: int, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(b.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    rows = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id", mod, rest).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def kept(docs: DataFrame, scores: Callable[[list[str]], list[float]], keep: Callable[[float], bool], release: Callable[[], None]) -> DataFrame:
    """The rows of docs, with all columns, whose text's score passes. release: empties the memos when a task ends."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["" if t is None else t for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([keep(s) for s in scores(texts)], pa.bool_()))
        release()
        trim()

    return small_batches(docs).mapInArrow(run, docs.schema)

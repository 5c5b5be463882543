"""Token ids as Parquet list columns, in ascending document order, with controlled row groups, pages and encodings.

Files hold contiguous id ranges and are sorted, so footers and page indexes lead a reader to the rows of some documents, and
(doc_id, start, n_tokens) can be read without the ids. Ids are dictionary-encoded and fall back to delta encoding (version 2
pages); the sorted id and start columns are small deltas.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.common import Deal, id_text, longs, shuffle_partitions
from grove.llm.library_tokens import encoder, tokenizer_path
from grove.llm.words import in_groups

VOCABULARY, END = "word_bpe_49k.json", 1
SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "v2",
}


def tokenize(path: str, end: int):
    """Sorted rows (part, doc_id, text) of one part to rows of SCHEMA; local_start counts the ids before in the part."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, at = encoder(path, False), 0
        for b in batches:
            texts = b.column("text").to_pylist()
            for a, z in in_groups(texts):
                ids = [x + tail for x in memo.texts(texts[a:z])]
                sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([b.column("part").slice(a, z - a), b.column("doc_id").slice(a, z - a), pa.array(at + ends - sizes), pa.array(sizes), lists], names=["part", "doc_id", "local_start", "n_tokens", "ids"])
                at += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END, options: dict[str, str] | None = None) -> None:
    """Writes the ids of every whole text, then the end id, in ascending doc_id order (null first; ties by text).

    A null or empty text has the end id only; an empty table writes no rows; other columns are left out.
    """
    docs = id_text(docs)
    deal = Deal(docs, "doc_id", shuffle_partitions(docs.sparkSession))
    dealt = docs.withColumn("part", deal.part("doc_id")).repartitionById(deal.parts, F.col("part")).sortWithinPartitions("doc_id", "text")
    rows = dealt.select("part", "doc_id", "text").mapInArrow(tokenize(vocabulary or tokenizer_path(VOCABULARY), end), SCHEMA)
    rows.write.options(**(FILE_OPTIONS | (options or {}))).parquet(path)


def starts(files: DataFrame) -> Column:
    """The ids before each document: those of all parts before, of which the driver gets one sum each, and local_start."""
    sums = dict(files.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, total = [], 0
    for p in range(max(sums, default=-1) + 1):
        before.append(total)
        total += sums.get(p, 0)
    return F.get(longs(before), F.col("part")) + F.col("local_start") if before else F.col("local_start")


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids); where, on doc_id, reaches the files' statistics, and unread columns are not read."""
    files = spark.read.schema(SCHEMA).parquet(path)
    start = starts(files)
    return (files if where is None else files.where(where)).select("doc_id", start.alias("start"), "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            raw, at = lists.values.to_numpy().astype("<u4").view(np.uint8), lists.offsets.to_numpy() * 4
            crc = [crc32(raw[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.sources.shared import scratch as new_path

NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def saved(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: later jobs start from files that outlive any executor."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of saved tables that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Up to so many ids are sent to all executors, to pick their rows without moving the others; beyond that, both sides move.
FEW = 200_000


def bounded(df: DataFrame) -> DataFrame:
    """df, a saved table of ids, to be sent to all executors if it has FEW rows at most."""
    return F.broadcast(df) if df.count() <= FEW else df


#: Bytes of a batch between Spark and Python; a task holds a batch several times over.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session from now on sends batches of at most BATCH_BYTES to Python, where its setting was larger."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(key).rstrip("bB")) <= BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that other columns can't clash with an operator's own."""
    return small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


class Deal:
    """Contiguous id ranges of about equal row counts; the bounds are ids that occur, at most one a partition.

    Only those bounds reach the driver. A null id sorts before all others.
    """

    def __init__(self, df: DataFrame, id_col: str, parts: int) -> None:
        key = F.coalesce(F.col(id_col), F.lit(NULL_ID))
        shares = [i / parts for i in range(1, parts)] or [0.5]
        row = df.agg(F.percentile_approx(key, shares, 20 * parts + 1000).alias("q"), F.min(key).alias("first")).first()
        self.first = row["first"]
        cuts = sorted(set(row["q"] or [])) if parts > 1 else []
        self.cuts = [c for c in cuts if c != self.first]
        self.parts = len(self.cuts) + 1

    def key(self, id_col: str) -> Column:
        return F.coalesce(F.col(id_col), F.lit(NULL_ID))

    def part(self, id_col: str) -> Column:
        """The number of the range of an id: two steps of about sqrt(parts) comparisons."""
        if not self.cuts:
            return F.lit(0)
        key, step = self.key(id_col), max(1, int(len(self.cuts) ** 0.5))
        coarse = self.cuts[::step]
        block = F.greatest(F.size(F.filter(longs(coarse), lambda c: c <= key)) - 1, F.lit(0))
        fine = F.slice(longs(self.cuts), block * step + 1, F.lit(step))
        return (block * step + F.size(F.filter(fine, lambda c: c <= key))).cast("int")


def longs(values: Iterable[int]) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>") if values else F.array().cast("array<bigint>")


def trim() -> None:
    """Gives the memory that a Python worker has freed back to the system; the worker lives on and serves other stages."""
    import ctypes
    import gc

    gc.collect()
    if hasattr(c := ctypes.CDLL(None), "malloc_trim"):
        c.malloc_trim(0)


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as keep it apart from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """Whether crc32 of the id's decimal text has this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod == rest

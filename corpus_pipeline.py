"""A corpus from raw documents to packed sequences, in stages that are each written and read again.

In every stage a null text counts as empty, nulls in other columns pass through, and an empty table gives an empty table.
Rows that repeat an id are judged each by itself, but for near_dedup, which keeps one row an id, and each text without an id
that has no copy; a null id counts as the largest. Further columns, whatever their names, pass through all stages but the last, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grove.llm.common import new_path, table

THRESHOLD = 0.3
#: Near duplicates share this part of their shingles of five words.
WORDS, SIMILARITY = 5, 0.8

ORACLE_SQL = None  # trained models and packing have no SQL form; tests/llm checks the stages against plain versions


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose restored text is toxic. Without labelled rows it drops none."""
    from grove.llm.toxicity import fit, keep_clean

    return keep_clean(docs, fit(docs, table(spark, sf_dir, "labels")), THRESHOLD)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects. Without labelled rows it drops none."""
    from grove.llm.quality import fit, keep_good

    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")), THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of exact and near copies the document with the smallest id. Empty texts are copies of each other."""
    from grove.llm.simhash import representatives

    return representatives(docs, WORDS, SIMILARITY)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in each text, and counts n_chars anew where it did. Drops no document."""
    from grove.llm.secrets import redact

    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: one row for each piece."""
    from grove.llm.packing import pack, pieces

    return pieces(pack(docs))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

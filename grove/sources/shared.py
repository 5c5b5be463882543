"""Files that all executors see: checkpoints and tables in the folder of spark.checkpoint.dir, or in the warehouse."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("/", "file:")) and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir isn't set, and {warehouse} is no folder that the driver and all executors share")
    return warehouse + "/_grove"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the plan starts anew from files that outlive any executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/grove-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df from files of the shared folder: computed once, and of a size that Spark knows when it chooses how to join it."""
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop knows them: any store that Spark writes to."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what stands in a folder; none where there is no folder."""
    fs, p = hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def put(df: DataFrame, path: str) -> bool:
    """Writes df beside path and renames it there, so that readers see all of it or nothing; False where path is taken already."""
    spark = df.sparkSession
    fs, p = hadoop(spark, path)
    if fs.exists(p):
        return False
    head, _, name = path.rpartition("/")
    staged = f"{head}/_{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(staged)
    if fs.rename(hadoop(spark, staged)[1], p):
        return True
    remove(spark, staged)
    return False


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced if it is there."""
    fs, p = hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    fs, p = hadoop(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()

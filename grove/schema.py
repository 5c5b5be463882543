"""The data model: symbols (vertices), edges, file hashes and text documents, and queries that check its constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _field(name: str, kind: T.DataType, nullable: bool = False) -> T.StructField:
    return T.StructField(name, kind, nullable)


_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()

SYMBOLS = T.StructType([
    _field("id", _S), _field("name", _S), _field("kind", _S), _field("file_path", _S), _field("line_start", _I), _field("line_end", _I),
    _field("signature", _S, True), _field("docstring", _S, True), _field("parent_id", _S, True), _field("language", _S), _field("metadata", _S),
])
EDGES = T.StructType([_field("from_id", _S), _field("to_id", _S), _field("kind", _S), _field("file_path", _S), _field("line", _I, True)])
FILES = T.StructType([_field("file_path", _S), _field("hash", _S), _field("indexed_at", _L)])
DOCUMENTS = T.StructType([_field("symbol_id", _S), _field("name", _S), _field("kind", _S), _field("file_path", _S), _field("body", _S)])

SYMBOL_KINDS = ("function", "class", "method", "interface", "struct", "enum", "const", "type", "property", "module")
EDGE_KINDS = ("calls", "imports", "extends", "implements", "instantiates", "references", "references_type", "includes")
CLASS_LIKE = ("class", "struct", "interface")
EDGE_KEY = ["from_id", "to_id", "kind"]

_PARAMETER = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("name", _S), ("type", _S), ("optional", T.BooleanType()), ("has_default", T.BooleanType()))]))
#: One struct for the metadata of all languages; normalized_metadata also reads the camel-case spellings.
METADATA = T.StructType(
    [T.StructField(n, _S) for n in ("access", "visibility", "return_type", "receiver", "keyword", "attr_type")]
    + [T.StructField(f"is_{n}", T.BooleanType()) for n in ("async", "static", "abstract", "readonly", "virtual", "override", "sealed", "partial", "classmethod", "property", "const", "unsafe", "method", "final", "data", "open", "local", "stream", "repeated")]
    + [T.StructField("exported", T.BooleanType()), T.StructField("decorators", T.ArrayType(_S)), T.StructField("attributes", T.ArrayType(_S)), T.StructField("parameters", _PARAMETER)]
)


def violations(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, key): broken keys, kinds and parents. Spark enforces none of them."""
    twice = symbols.groupBy("id").count().where("count > 1").select(F.lit("symbol_id_unique").alias("rule"), F.col("id").alias("key"))
    kind = symbols.where(~F.col("kind").isin(*SYMBOL_KINDS)).select(F.lit("symbol_kind"), F.col("id"))
    orphan = symbols.where("parent_id IS NOT NULL").join(symbols.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select(F.lit("parent_exists"), "id")
    edge_kind = edges.where(~F.col("kind").isin(*EDGE_KINDS)).select(F.lit("edge_kind"), F.concat_ws("|", *EDGE_KEY))
    edge_twice = edges.groupBy(*EDGE_KEY).count().where("count > 1").select(F.lit("edge_unique"), F.concat_ws("|", *EDGE_KEY))
    return twice.union(kind).union(orphan).union(edge_kind).union(edge_twice)

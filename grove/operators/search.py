"""Ranked search: a postings table, BM25 over prefix patterns, page-relative scores, and similar symbols."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grove.functions import text as T
from grove.functions.names import similar_importance
from grove.operators.graph import CodeGraph
from grove.sources.shared import stored

#: BM25 constants and the weights of the two searched columns; score bounds of a page.
K1, B, NAME_WEIGHT, BODY_WEIGHT, LEAST_IDF = 1.2, 0.75, 5.0, 10.0, 1e-6
BEST, WORST, FLAT, EPSILON = 1.0, 0.5, 0.95, 1e-15


@dataclass
class TextIndex:
    """docs: symbol_id, name, kind, file_path. postings: term, symbol_id, col, positions. lengths: symbol_id, length.

    A term may have several postings in a column of a document: positions are one or more of its places there.
    counted: the number of documents and of their terms, where they are known without a scan.
    """

    docs: DataFrame
    postings: DataFrame
    lengths: DataFrame
    stemmed: bool = False
    unaccented: bool = False
    counted: tuple[int, int] | None = None

    def save(self, path: str) -> None:
        """Each file's postings sorted by term, so that a prefix reads the pages of its range only."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def build_index(docs: DataFrame, stemmed: bool = False, unaccented: bool = False) -> TextIndex:
    """docs: symbol_id, name, kind, file_path, body. Only stems shuffle terms: a posting has one position, and stays in the task that read its text."""
    named = docs.select("symbol_id", F.explode(F.array(F.struct(F.lit(1).alias("col"), F.col("name").alias("text")), F.struct(F.lit(0).alias("col"), F.col("body").alias("text")))).alias("x")).select("symbol_id", "x.col", T.tokens(F.col("x.text"), unaccented).alias("tokens"))
    lengths = docs.groupBy("symbol_id").agg(F.sum(F.size(T.tokens(F.col("name"), unaccented)) + F.size(T.tokens(F.col("body"), unaccented))).alias("length"))
    # an outer explode, since Spark filters the input of others by the size of the array, for which it would cut each text twice
    each = named.select("symbol_id", "col", F.posexplode_outer("tokens").alias("pos", "term")).where("term IS NOT NULL")
    if stemmed:
        stems = each.select("term").distinct().withColumn("stem", T.stem("term"))
        each = each.join(stems, "term").select("symbol_id", "col", "pos", F.col("stem").alias("term"))
    postings = each.select("term", "symbol_id", "col", F.array("pos").alias("positions"))
    return TextIndex(docs.select("symbol_id", "name", "kind", "file_path"), postings, lengths, stemmed, unaccented)


def in_range(prefix: str):
    """A range of terms that the statistics of Parquet pages can prune, and the prefix itself."""
    return (F.col("term") >= prefix) & F.startswith(F.col("term"), F.lit(prefix))


def hits(index: TextIndex, pattern: str) -> DataFrame | None:
    """(symbol_id, f): weighted occurrences of a pattern; a pattern of several tokens is a phrase whose last is a prefix."""
    words = T.pattern_tokens(pattern, index.unaccented)
    if index.stemmed:
        words = [T.porter(w) for w in words]
    if not words:
        return None
    at = index.postings.where((F.col("term") == words[0]) if len(words) > 1 else in_range(words[0])).select("symbol_id", "col", F.explode("positions").alias("pos"))
    for i, w in enumerate(words[1:], 2):
        nxt = index.postings.where((F.col("term") == w) if i < len(words) else in_range(w)).select("symbol_id", "col", F.explode("positions").alias("pos"))
        at = at.select("symbol_id", "col", (F.col("pos") + 1).alias("pos")).join(nxt, ["symbol_id", "col", "pos"])
    return at.groupBy("symbol_id").agg(F.sum(F.when(F.col("col") == 1, NAME_WEIGHT).otherwise(BODY_WEIGHT)).alias("f"))


def ranks(index: TextIndex, query: str, kind: str | None = None) -> DataFrame:
    """(symbol_id, name, kind, file_path, rank) of all matches of any word's prefix, in no order.

    The rows that match each pattern, and the corpus, are counted first; the kind filter comes after those statistics.
    """
    found = [(p, h) for p in T.query_patterns(query) if (h := hits(index, p)) is not None]
    empty = index.docs.limit(0).select("symbol_id", "name", "kind", "file_path", F.lit(0.0).alias("rank"))
    if not found:
        return empty
    # stored, since they are counted and scored: an index that isn't saved would be built for both
    each = stored(reduce(DataFrame.union, (h.select("symbol_id", "f", F.lit(i).alias("p")) for i, (_, h) in enumerate(found))))
    n, total = index.counted or index.lengths.agg(F.count("*"), F.sum("length")).first()
    if not total:
        return empty
    rows = each.groupBy("p").agg(F.count("*").alias("n"))
    raw = F.log((F.lit(n) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = rows.select("p", F.when(raw <= 0, LEAST_IDF).otherwise(raw).alias("idf"))
    scored = each.join(F.broadcast(idf), "p").join(index.lengths, "symbol_id")  # one row a pattern of the query
    norm = K1 * (1 - B + B * F.col("length") / (total / n))
    summed = scored.groupBy("symbol_id").agg((-F.sum(F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + norm))).alias("rank"))
    docs = index.docs if kind is None else index.docs.where(F.col("kind") == kind)
    return docs.join(summed, "symbol_id")


def bm25(index: TextIndex, query: str, kind: str | None = None, limit: int = 10) -> DataFrame:
    """The best matches with their score, relative to this page."""
    return normalized(ranks(index, query, kind).orderBy("rank", "symbol_id").limit(limit))


def normalized(page: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """page with scores from 1 (best) to 0.5 within the page, or within each partition; 0.95 where all ranks are equal."""
    w = Window.partitionBy(*(partition or [F.lit(0)]))
    low, high = F.min("rank").over(w), F.max("rank").over(w)
    score = F.when(F.abs(high - low) < EPSILON, F.lit(FLAT)).otherwise(BEST - (F.col("rank") - low) / F.nullif(high - low, F.lit(0.0)) * (BEST - WORST))
    return page.withColumn("score", score)


def with_lines(results: DataFrame, symbols: DataFrame) -> DataFrame:
    """results, which are stored, with the lines of their symbols: of all symbols only those found are joined."""
    results = stored(results)
    lines = symbols.select(F.col("id").alias("symbol_id"), "line_start", "line_end").join(results.select("symbol_id"), "symbol_id", "left_semi")
    return results.join(lines, "symbol_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("line_start", "line_end")})


def search_documents(graph: CodeGraph, strict: bool = False) -> DataFrame:
    """The text document of each symbol. strict takes a parent's name from the place of three-part ids."""
    parents = graph.parent_names().withColumnRenamed("name", "_parent")
    rows = graph.with_neighbours().join(parents, "parent_id", "left").join(graph.importance().withColumnRenamed("to_id", "id"), "id", "left")
    none = F.array().cast("array<string>")
    parent = T.strict_parent(F.col("parent_id")) if strict else F.coalesce("_parent", F.get(F.split("parent_id", "::"), F.lit(1)))
    body = T.embedding_text(F.col("kind"), F.col("name"), F.col("signature"), F.col("docstring"), parent, F.col("file_path"), F.coalesce("_callers", none), F.coalesce("_callees", none), F.coalesce("importance", F.lit(0.0)))
    return rows.select(F.col("id").alias("symbol_id"), "name", "kind", "file_path", body.alias("body"))


def graph_index(graph: CodeGraph) -> TextIndex:
    """The index of search_documents, which are written once: each pattern of a query reads them."""
    return build_index(stored(search_documents(graph)))


def similar(graph: CodeGraph, index: TextIndex, name: str, kind: str | None = None, limit: int = 10) -> DataFrame:
    """Symbols whose documents match the key terms of one symbol's; itself and its namesakes left out."""
    symbol = graph.find_symbol(name)
    callers = graph.incoming_callers(symbol).agg(F.collect_list("caller").alias("callers"))
    callees = graph.outgoing_calls(symbol).agg(F.collect_list("callee").alias("callees"))
    row = symbol.withColumns({"callers": callers.scalar(), "callees": callees.scalar(), "importance": similar_importance(graph.caller_count(symbol).scalar())})
    text = T.embedding_text(F.col("kind"), F.col("name"), F.col("signature"), F.col("docstring"), F.get(F.split("parent_id", "::"), F.lit(1)), F.col("file_path"), F.col("callers"), F.col("callees"), F.col("importance"))
    terms = row.select("id", F.array_join(T.key_terms(text), " ").alias("terms")).first()
    if terms is None:
        return bm25(index, "")
    found = bm25(index, terms["terms"], kind, max(2 * limit, 10))
    return found.where((F.col("symbol_id") != terms["id"]) & (F.col("name") != name)).orderBy("rank", "symbol_id").limit(limit)

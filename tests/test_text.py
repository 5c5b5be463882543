"""Tokenizer, stemmer and BM25, the last against SQLite's full-text search."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from grove.functions import text as T
from grove.operators import search

DOCS = [("1", "PaymentService", "class", "method process_payment | payment errors handled"), ("2", "get_user", "function", "get user by id, then errors"), ("3", "logger", "class", "logs logs logs"), ("4", "userGet", "function", "user get relational hopping"), ("5", "x", "class", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, n, k, "p", b) for i, n, k, b in DOCS], "symbol_id string, name string, kind string, file_path string, body string")


@pytest.fixture(scope="module")
def fts():
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE f USING fts5(symbol_id UNINDEXED, name, kind UNINDEXED, file_path UNINDEXED, body, tokenize='porter unicode61')")
    c.executemany("INSERT INTO f VALUES (?, ?, ?, 'p', ?)", DOCS)
    return c


@pytest.mark.parametrize("query", ["payment", "errors", "get_user", "logs user", "hoppings relation", "zzz", "AND"])
def test_bm25_as_sqlite(docs, fts, query):
    index = search.build_index(docs, stemmed=True, unaccented=True)
    got = {r["symbol_id"]: r["rank"] for r in search.bm25(index, query, None, 50).collect()}
    match = " OR ".join(f'"{p}"*' for p in T.query_patterns(query))
    want = dict(fts.execute("SELECT symbol_id, bm25(f, 1, 5, 1, 2, 10) FROM f WHERE f MATCH ?", [match]).fetchall())
    assert got == pytest.approx(want, abs=1e-9)


def test_kind_filter_keeps_statistics(docs):
    index = search.build_index(docs)
    both, one = (search.bm25(index, "get", k, 9).collect() for k in (None, "function"))
    assert {r["symbol_id"]: r["rank"] for r in one} == {r["symbol_id"]: r["rank"] for r in both if r["kind"] == "function"}


def test_page_scores(docs):
    page = search.bm25(search.build_index(docs), "user get errors", None, 5).collect()
    assert max(r["score"] for r in page) == 1.0 and min(r["score"] for r in page) == 0.5
    assert {r["score"] for r in search.bm25(search.build_index(docs), "logger", None, 5).collect()} == {0.95}


def test_saved_index(docs, spark, tmp_path):
    search.build_index(docs).save(str(tmp_path))
    again = search.TextIndex(*(spark.read.parquet(f"{tmp_path}/{t}") for t in ("docs", "postings", "lengths")))
    assert [r["symbol_id"] for r in search.bm25(again, "payment", None, 3).collect()] == ["1"]


@pytest.mark.parametrize("query", ["TransactionController", "payment", "getHTTPResponse get_user_id", "a-b ÉcoleMaître", "  ", "id_of X"])
def test_query_patterns(spark, query):
    assert spark.range(1).select(T.query_terms(F.lit(query))).first()[0] == T.query_patterns(query)


def test_porter():
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing fizzed failing filing happy sky relational conditional valenci digitizer radicalli vietnamization operator feudalism decisiveness formaliti triplicate formative electriciti hopeful goodness revival allowance inference airliner gyroscopic adjustable irritant replacement adoption communism activate effective bowdlerize probate rate cease controll roll"
    stems = "caress poni ti cat feed agre plaster motor sing conflat troubl size hop fall hiss fizz fail file happi sky relat condit valenc digit radic vietnam oper feudal decis formal triplic form electr hope good reviv allow infer airlin gyroscop adjust irrit replac adopt commun activ effect bowdler probat rate ceas control roll"
    assert [T.porter(w) for w in words.split()] == stems.split()

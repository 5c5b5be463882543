"""Every query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

from grove.operators import search
from grove.plans import catalogue, testgraph

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(repr(tuple(None if v is None or v != v else v for v in r)) for r in pdf.where(pdf.notna(), None).values.tolist())


def test_each_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_whole_tables(spark, duck):
    orders = duck.sql("SELECT count(DISTINCT l_orderkey) FROM lineitem").fetchall()[0][0]
    calls = duck.sql("SELECT count(DISTINCT (l_suppkey % 50, l_orderkey % 2000)) FROM lineitem").fetchall()[0][0]
    assert catalogue.queries()["diff_lines"](spark, SF).select("diff_id").distinct().count() == orders
    assert catalogue.queries()["caller_coverage"](spark, SF).first()["total"] == calls


def test_orders(spark):
    """The comparison above sorts both sides; here the rows' own order is what counts."""
    g = testgraph.graph(spark, SF)
    keys = {
        "refs": (g.refs(catalogue.SUPPLIER), ("kind", "file_path", "line", "from_id", "to_id")), "deps": (g.deps(catalogue.NATION, 2), ("depth", "kind", "name")), "impact": (g.impact(catalogue.SUPPLIER, 3), ("depth", "file_path", "id")),
        "trace": (g.trace(catalogue.SUPPLIER, 3), ("steps", "first_name", "path")), "core": (g.core_symbols(20), ("-caller_count", "name", "id")), "entrypoints": (g.entrypoints(), ("file_path", "line_start", "id")),
        "directories": (g.directory_stats(), ("directory",)), "callers": (g.incoming_callers(g.find_symbol(catalogue.SUPPLIER)), ("-call_count", "caller_id")),
        "found": (search.bm25(search.build_index(catalogue._documents(spark, SF)), catalogue.SEARCH, None, 20), ("rank", "symbol_id")),
    }
    for name, (df, key) in keys.items():
        rows = [tuple(-r[k[1:]] if k[0] == "-" else r[k] for k in key) for r in df.collect()]
        assert rows == sorted(rows) and rows[0] != rows[-1], name
    page = g.refs(catalogue.SUPPLIER, limit=3).collect()
    assert len(page) == 3 and {r["total"] for r in page} == {g.refs(catalogue.SUPPLIER).count()}

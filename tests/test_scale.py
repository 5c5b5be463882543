"""What queries shuffle and sort: few rows where few are wanted, however many edges there are."""

from pyspark.sql import functions as F

from grove.operators import search
from grove.operators.graph import CodeGraph
from grove.plans import testgraph
from grove.sources import segments
from grove.sources.segments import POSTINGS, SegmentedText

SF = "/root/testdata/sf0.001"
MANY = 30_000


def shuffled(spark, run):
    """Records that run's stages write to shuffles."""
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext

    def written():
        found = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = written()
    run()
    return sum(n for stage, n in written().items() if stage not in before)


def scene(spark):
    """MANY callers of fifty functions, and two of "wanted"."""
    ids = spark.range(MANY).select(F.format_string("a.py::f%d::function::1", F.col("id")).alias("id"), F.format_string("f%d", F.col("id")).alias("name"), "id")
    calls = spark.range(MANY).select(F.format_string("a.py::f%d::function::1", F.col("id")).alias("from_id"), F.format_string("svc.f%d", F.col("id") % 50).alias("to_id"))
    more = spark.createDataFrame([("a.py::f7::function::1", "x.wanted"), ("a.py::f8::function::1", "b.py::wanted::function::1"), ("a.py::f9::function::1", "a.py::f8::function::1")], calls.schema)
    edges = calls.union(more).select("from_id", "to_id", F.lit("calls").alias("kind"), F.lit("a.py").alias("file_path"), F.lit(1).alias("line"))
    names = ids.toDF("id", "name", "n").select("id", "name").union(spark.createDataFrame([("b.py::wanted::function::1", "wanted")], "id string, name string"))
    none = F.lit(None).cast("string")
    symbols = names.select("id", "name", F.lit("function").alias("kind"), F.lit("a.py").alias("file_path"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), none.alias("signature"), none.alias("docstring"), none.alias("parent_id"), F.lit("python").alias("language"), F.lit("{}").alias("metadata"))
    far = lambda df: spark.createDataFrame(df.rdd, df.schema)  # of a size that Spark doesn't know
    return CodeGraph(far(symbols), far(edges))


def test_few_references_shuffle_few_edges(spark):
    """Before, every key of every edge went through a shuffle."""
    g = scene(spark)
    got = []
    edges = g.edges_to(g.wanted("wanted"), ["calls"])
    assert shuffled(spark, lambda: got.extend(edges.collect())) < MANY / 2
    assert sorted(r["from_id"] for r in got) == ["a.py::f7::function::1", "a.py::f8::function::1"]
    assert [r["total"] for r in g.refs("wanted", limit=1).collect()] == [2]


def test_few_seeds_shuffle_few_steps(spark):
    """A step from few ids reads the edges without shuffling them: the distinct sources of steps are all that is."""
    from grove.operators.traverse import reach

    g = scene(spark)
    steps = g.edges.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    first = spark.createDataFrame([("b.py::wanted::function::1",)], "id string")
    found = []
    n = shuffled(spark, lambda: found.extend(tuple(r) for r in reach(first, steps, 4).collect()))
    assert n < MANY / 2
    assert sorted(found) == [("a.py::f8::function::1", 2), ("a.py::f9::function::1", 3), ("b.py::wanted::function::1", 1)]


def test_edges_of_a_kind_read_that_kind(spark):
    plan = testgraph.edges(testgraph.narrow_edges(spark, SF)).where("kind = 'calls'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and "p_name" not in plan


def test_items_are_dealt_once(spark):
    """Imports are found where calls dealt the items; instances are counted before they move."""
    sold = testgraph.sold_items(spark, SF).persist()
    items = sold.count()
    narrow = testgraph.narrow_edges(spark, SF, sold)
    for kind in ("imports", "instantiates"):
        assert shuffled(spark, narrow[kind].count) < items / 2, kind
    sold.unpersist()


def test_neighbour_names_are_distinct(spark):
    symbols = spark.createDataFrame([(f"c{i}", n) for i, n in enumerate("bbbaaacd")], "id string, name string")
    edges = spark.createDataFrame([(f"c{i}", "t", "calls") for i in range(8)], "from_id string, to_id string, kind string")
    assert [tuple(r) for r in CodeGraph(symbols, edges).caller_names(3).collect()] == [("t", ["a", "b", "c"])]


def test_a_graph_index_reads_stored_documents(spark):
    plan = search.graph_index(testgraph.graph(spark, SF)).postings._jdf.queryExecution().toString()
    assert "Join" not in plan and "Window" not in plan


def test_documents_shuffle_calls_between_symbols_once(spark):
    """Before, all calls were shuffled by both ends, with their texts; callees lie where their callers' calls do."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        g = testgraph.graph(spark, SF)
        calls, symbols = g.calls().count(), g.symbols.count()
        n = shuffled(spark, search.search_documents(g).collect)
        assert n < calls + 5 * symbols, (n, calls, symbols)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_documents_by_keys_are_those_by_ids(spark):
    g = testgraph.graph(spark, SF)
    rows = lambda g: sorted(map(tuple, search.search_documents(g).collect()))
    assert rows(g) == rows(CodeGraph(g.symbols, g.edges))


def test_a_sketch_shuffles_few_symbols(spark):
    """Before, names of few callers and callees were looked up by shuffling all symbols."""
    g = scene(spark)
    got = []
    n = shuffled(spark, lambda: got.extend(g.whole_sketch("wanted").collect()))
    assert n < MANY, n
    assert [(r["section"], r["name"]) for r in got] == [("symbol", "wanted"), ("caller", "f8")]


def test_callers_of_few_are_counted_as_of_many(spark):
    """Two keys of one symbol that a target matches, and two rows of a symbol, count its calls once."""
    symbols = spark.createDataFrame([("a.f", "f"), ("g", "g"), ("g", "g"), ("h", "h")], "id string, name string")
    edges = spark.createDataFrame([("x", "a.f", "calls"), ("y", "a.f", "calls"), ("x", "f", "calls"), ("x", "s.g", "calls"), ("y", "g", "calls"), ("y", "h", "imports")], "from_id string, to_id string, kind string")
    for few in (False, True):
        assert sorted(tuple(r) for r in CodeGraph(symbols, edges).caller_counts(symbols, few).collect()) == [("a.f", 3), ("g", 2)]


def test_lines_of_a_page_shuffle_few_symbols(spark):
    """Before, all symbols were shuffled for the lines of one page."""
    g = scene(spark)
    results = spark.createDataFrame([("a.py::f7::function::1", "f7"), ("nothing", "f")], "symbol_id string, name string")
    results = spark.createDataFrame(results.rdd, results.schema)
    got = []
    assert shuffled(spark, lambda: got.extend(search.with_lines(results, g.symbols).collect())) < MANY / 2
    assert sorted(tuple(r) for r in got) == [("a.py::f7::function::1", "f7", 1, 2), ("nothing", "f", 0, 0)]


def test_a_text_segment_shuffles_texts_instead_of_terms(spark, tmp_path, monkeypatch):
    """Before, postings were shuffled twice, and the task that read a row group cut all its texts into terms."""
    many, words = 300, 200
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda x: F.concat(F.lit("w"), (x * F.col("id")) % 977)), " ")
    docs = spark.range(0, many, 1, 1).select(F.col("id").cast("string").alias("symbol_id"), F.lit("n").alias("name"), F.lit("k").alias("kind"), F.lit("f").alias("file_path"), body.alias("body"))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(segments, "FILE_BYTES", 50_000)
    try:
        made = []
        n = shuffled(spark, lambda: made.append(SegmentedText.of(spark, str(tmp_path / "text"), stemmed=False).updated(docs)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert n < 10 * many, n
    (segment,) = made[0].segments
    files = [[(r["term"], r["symbol_id"], p) for r in spark.read.schema(POSTINGS).parquet(str(f)).collect() for p in r["positions"]] for f in (tmp_path / "text" / segment.name / "postings").glob("*.parquet")]
    files = [f for f in files if f]
    assert len(files) > 1 and all(len({r[1] for r in f}) < many for f in files)  # several tasks cut texts
    assert all([r[0] for r in f] == sorted(r[0] for r in f) for f in files)
    assert len({r for f in files for r in f}) == sum(map(len, files)) == many * (words + 1)


def test_few_texts_are_one_file_of_a_segment(spark, tmp_path):
    docs = spark.range(40).selectExpr("cast(id AS string) AS symbol_id", "'n' AS name", "'k' AS kind", "'f' AS file_path", "concat('word ', id) AS body")
    (segment,) = SegmentedText.of(spark, str(tmp_path / "text"), stemmed=False).updated(docs).segments
    assert len(list((tmp_path / "text" / segment.name / "postings").glob("*.parquet"))) == 1

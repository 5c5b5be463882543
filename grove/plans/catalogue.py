"""One query for each operator of the engine, over the driver's tables, with the same in SQL.

The graph's queries run on the projection of grove.plans.testgraph; documents stand for files, events for agents' actions,
orders for benchmark runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.functions import names as N
from grove.functions import text as T
from grove.operators import change, runs, search, workspace
from grove.operators.graph import CodeGraph
from grove.plans import testgraph
from grove.plans.testgraph import graph
from grove.sources import tree
from grove.sources.segments import SegmentedText
from grove.sources.shared import scratch
from grove.streaming.watch import debounced

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

SUPPLIER, NATION, FILE = "Supplier#000000001", "NATION_3", "src/supplier/supplier_1.ts"
WITH = "WITH RECURSIVE " + testgraph.SQL
ARGS = WITH + f""", target AS (SELECT * FROM symbols WHERE name = '{SUPPLIER}' ORDER BY parent_id IS NOT NULL, id LIMIT 1),
cls AS (SELECT * FROM symbols WHERE name = '{NATION}' ORDER BY parent_id IS NOT NULL, id LIMIT 1),
kids AS (SELECT * FROM cls UNION ALL SELECT s.* FROM symbols s JOIN cls ON s.parent_id = cls.id),
infile AS (SELECT * FROM symbols WHERE file_path = '{FILE}')"""


def sql_name(x: str, s: str) -> str:
    return f"coalesce({s}.name, CASE WHEN len(string_split({x}, '::')) >= 2 THEN string_split({x}, '::')[2] ELSE {x} END)"


def sql_match(to: str, s: str, qualified: bool = True) -> str:
    return f"({to} = {s}.id OR {to} = {s}.name OR ends_with({to}, '.' || {s}.name)" + (f" OR ends_with({to}, '::' || {s}.name))" if qualified else ")")


SQL_DISPLAY = f"""coalesce(CASE WHEN s.name IS NOT NULL THEN concat_ws('.', p.name, s.name) END,
    CASE WHEN contains(e.from_id, '__module__') AND contains(string_split(e.from_id, '::')[1], '/') THEN regexp_extract(string_split(e.from_id, '::')[1], '([^/]+?)(\\.[^./]*)?$', 1) END, {sql_name("e.from_id", "s")})"""


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


# Lookup and counts


@query(WITH + " SELECT id, name, kind, file_path, line_start FROM symbols WHERE name = 'old rod' ORDER BY parent_id IS NOT NULL, id LIMIT 1")
def find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).find_symbol("old rod").select("id", "name", "kind", "file_path", "line_start")


@query(WITH + " SELECT s.id, s.name, s.kind, s.parent_id FROM symbols s JOIN symbols p ON s.parent_id = p.id WHERE p.name = 'NATION_19' AND s.name = 'Customer#000000001' ORDER BY s.id LIMIT 1")
def find_symbol_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).find_symbol("NATION_19.Customer#000000001").select("id", "name", "kind", "parent_id")


@query(ARGS + " SELECT s.id, s.name, s.line_start FROM symbols s JOIN cls ON s.parent_id = cls.id")
def methods_of_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    owner = g.find_symbol(NATION).select(F.col("id").alias("parent_id"))
    return g.symbols.join(owner, "parent_id", "left_semi").select("id", "name", "line_start").orderBy("line_start", "id")


@query(WITH + f" SELECT id, name, kind, line_start FROM symbols WHERE file_path = '{FILE}'")
def file_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).file_symbols(FILE).select("id", "name", "kind", "line_start")


@query(ARGS + f" SELECT count(*) AS caller_count FROM edges e WHERE kind = 'calls' AND EXISTS (SELECT 1 FROM target t WHERE {sql_match('e.to_id', 't', False)})")
def caller_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.caller_count(g.find_symbol(SUPPLIER))


@query(WITH + f" SELECT s.id, count(*) AS caller_count FROM symbols s JOIN edges e ON e.kind = 'calls' AND {sql_match('e.to_id', 's', False)} WHERE s.kind = 'function' GROUP BY s.id")
def caller_counts_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.caller_counts(g.symbols.where("kind = 'function'"))


@query(ARGS + f" SELECT {SQL_DISPLAY} AS caller, e.from_id AS caller_id, count(*) AS call_count FROM edges e JOIN target t ON e.to_id = t.id LEFT JOIN symbols s ON s.id = e.from_id LEFT JOIN symbols p ON p.id = s.parent_id WHERE e.kind = 'calls' GROUP BY ALL")
def incoming_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.incoming_callers(g.find_symbol(SUPPLIER))


@query(ARGS + f" SELECT {sql_name('e.to_id', 's')} AS callee FROM (SELECT DISTINCT to_id FROM edges JOIN target t ON from_id = t.id AND edges.kind = 'calls') e LEFT JOIN symbols s ON s.id = e.to_id")
def outgoing_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.outgoing_calls(g.find_symbol(SUPPLIER))


@query(ARGS + f""" SELECT DISTINCT e.kind AS relation, {sql_name('e.to_id', 's')} AS name FROM edges e JOIN cls ON e.from_id IN (cls.id, cls.file_path || '::__module__::class') LEFT JOIN symbols s ON s.id = e.to_id WHERE e.kind IN ('extends', 'implements')
UNION SELECT 'dependency', {sql_name('e.to_id', 's')} FROM edges e JOIN kids k ON e.from_id = k.id LEFT JOIN symbols s ON s.id = e.to_id WHERE e.kind NOT IN ('extends', 'implements') AND e.to_id <> (SELECT id FROM cls)""")
def class_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.class_relationships(g.find_symbol(NATION))


@query(WITH + f" SELECT DISTINCT {sql_name('e.from_id', 's')} AS implementor, e.from_id FROM edges e JOIN symbols r ON r.name = 'ASIA' AND {sql_match('e.to_id', 'r')} LEFT JOIN symbols s ON s.id = e.from_id WHERE e.kind = 'implements'")
def implementors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.implementors(g.find_symbol("ASIA"))


def _top_names(by: str, of: str) -> str:
    return WITH + f""", d AS (SELECT DISTINCT e.{by} AS symbol_id, s.name FROM edges e JOIN symbols s ON s.id = e.{of} WHERE e.kind = 'calls'),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY name) AS n FROM d) SELECT symbol_id, string_agg(name, ', ' ORDER BY name) AS names FROM r WHERE n <= 10 GROUP BY symbol_id"""


@query(_top_names("to_id", "from_id"))
def caller_names_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).caller_names().select("symbol_id", F.array_join("names", ", ").alias("names"))


@query(_top_names("from_id", "to_id"))
def callee_names_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).callee_names().select("symbol_id", F.array_join("names", ", ").alias("names"))


SQL_IMPORTANCE = "imp AS (SELECT to_id, n / greatest(max(n) OVER (), 1)::DOUBLE AS importance FROM (SELECT to_id, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY to_id))"


@query(WITH + f", {SQL_IMPORTANCE} SELECT to_id, round(importance, 9) AS importance FROM imp")
def importance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).importance().select("to_id", F.round("importance", 9).alias("importance"))


SQL_CORE = """bid AS (SELECT to_id, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY to_id), suf AS (SELECT string_split(to_id, '.')[-1] AS k, sum(n) AS n FROM bid WHERE contains(to_id, '.') GROUP BY 1),
core AS (SELECT s.*, (coalesce(a.n, 0) + coalesce(b.n, 0) + coalesce(c.n, 0))::BIGINT AS caller_count FROM symbols s LEFT JOIN bid a ON a.to_id = s.id LEFT JOIN bid b ON b.to_id = s.name AND s.name <> s.id LEFT JOIN suf c ON c.k = s.name)"""


@query(WITH + f", {SQL_CORE} SELECT id, name, caller_count FROM core WHERE kind IN ('function', 'method') AND caller_count > 0 ORDER BY caller_count DESC, name, id LIMIT 10")
def core_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).core_symbols(10).select("id", "name", *big("caller_count"))


SQL_ENTRY = """called AS (SELECT DISTINCT to_id FROM edges WHERE kind = 'calls'), bare AS (SELECT DISTINCT string_split(to_id, '.')[-1] AS k FROM called WHERE contains(to_id, '.')),
fan AS (SELECT from_id, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY from_id),
entry AS (SELECT s.*, coalesce(f.n, 0)::BIGINT AS fan_out FROM symbols s LEFT JOIN fan f ON f.from_id = s.id WHERE kind IN ('function', 'method', 'class') AND NOT regexp_matches(lower(file_path), '/tests?/|[._]test\\.|[._]spec\\.|^tests?/')
    AND s.id NOT IN (SELECT to_id FROM called) AND s.name NOT IN (SELECT to_id FROM called) AND s.name NOT IN (SELECT k FROM bare))"""


@query(WITH + f", {SQL_ENTRY} SELECT id, name, kind, file_path, fan_out FROM entry")
def entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).entrypoints().select("id", "name", "kind", "file_path", *big("fan_out"))


@query(WITH + f""", {SQL_ENTRY}, c AS (SELECT * FROM entry WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM entry WHERE kind = 'class'))
SELECT CASE WHEN contains(lower(file_path), 'controller') THEN 'API Controllers' WHEN contains(lower(file_path), 'worker') OR contains(lower(file_path), 'job') THEN 'Background Workers' WHEN contains(lower(file_path), 'handler') OR contains(lower(file_path), 'listener') THEN 'Event Handlers' ELSE 'Other' END AS entry_group,
count(*) AS entries, count(DISTINCT file_path) AS files, sum(fan_out)::BIGINT AS fan_out FROM c GROUP BY 1""")
def entrypoint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).entrypoint_groups()


# References


def _refs(source: str, kinds: str, limit: int, extra: str = "") -> str:
    return ARGS + f""", hit AS (SELECT DISTINCT e.* FROM edges e JOIN {source} t ON {sql_match('e.to_id', 't')} WHERE {kinds}),
page AS (SELECT e.kind, e.file_path, e.line, e.from_id, {SQL_DISPLAY} AS from_name, e.to_id, (SELECT count(*) FROM hit) AS total FROM hit e LEFT JOIN symbols s ON s.id = e.from_id LEFT JOIN symbols p ON p.id = s.parent_id ORDER BY e.kind, e.file_path, e.line, e.from_id, e.to_id LIMIT {limit}) {extra or 'SELECT * FROM page'}"""


@query(_refs("kids", "true", 20))
def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).refs(NATION, limit=20)


@query(_refs("target", "e.kind = 'calls'", 20))
def refs_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).refs(SUPPLIER, ["calls"], 20)


@query(_refs("target", "e.kind = 'calls'", 1000))
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).callers(SUPPLIER, 1, 1000)


@query(_refs("kids", "true", 200, "SELECT kind, count(*) AS refs, string_agg(file_path || ':' || line, ',' ORDER BY file_path, line, from_id, from_name) AS places FROM page GROUP BY kind"))
def refs_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    places = F.array_join(F.transform("refs", lambda r: F.concat(r["file_path"], F.lit(":"), r["line"].cast("string"))), ",")
    return g.refs_grouped(g.refs(NATION, limit=200)).select("kind", F.size("refs").cast("long").alias("refs"), places.alias("places"))


@query(_refs("infile", "true", 50))
def file_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).file_refs(FILE, limit=50)


# Dependencies, impact and traces


def _deps(sources: str, depth: int) -> str:
    return ARGS + f""", src AS ({sources}), dep AS (SELECT e.to_id AS id, e.kind, 1 AS depth FROM edges e JOIN src ON e.from_id = src.id UNION SELECT e.to_id, e.kind, d.depth + 1 FROM dep d JOIN edges e ON e.from_id = d.id WHERE d.depth < {depth}),
m AS (SELECT d.id, d.kind, min(depth) AS depth FROM dep d WHERE d.id NOT IN (SELECT id FROM src) GROUP BY d.id, d.kind), nm AS (SELECT m.*, {sql_name('m.id', 's')} AS name FROM m LEFT JOIN symbols s ON s.id = m.id),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, kind ORDER BY depth, id) AS r FROM nm) WHERE r = 1), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY parent_id IS NOT NULL, id) AS r FROM symbols) WHERE r = 1)
SELECT coalesce(a.name, o.name) AS name, o.kind, coalesce(a.file_path, b.file_path) AS file_path, coalesce(a.file_path, b.file_path) IS NULL AS is_external, o.depth::INT AS depth FROM o LEFT JOIN symbols a ON a.id = o.id LEFT JOIN best b ON b.name = o.name"""


@query(_deps("SELECT id FROM kids UNION SELECT file_path || '::__module__::function' FROM cls", 1))
def deps_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).deps(NATION, 1).withColumn("depth", F.col("depth").cast("int"))


@query(_deps("SELECT id FROM target UNION SELECT file_path || '::__module__::function' FROM target", 4))
def deps_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).deps(SUPPLIER, 4).withColumn("depth", F.col("depth").cast("int"))


@query(_deps("SELECT id FROM infile UNION SELECT file_path || '::__module__::function' FROM infile", 1))
def file_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).file_deps(FILE, 1).withColumn("depth", F.col("depth").cast("int"))


def _impact(seeds: str, depth: int, where: str = "true") -> str:
    return ARGS + f""", im AS (SELECT DISTINCT e.from_id AS id, 1 AS depth FROM edges e JOIN {seeds} t ON {sql_match('e.to_id', 't')} UNION SELECT e.from_id, i.depth + 1 FROM im i JOIN edges e ON e.to_id = i.id WHERE i.depth < {depth}),
m AS (SELECT id, min(depth)::INT AS depth FROM im GROUP BY id), f AS (SELECT m.id, s.name, s.file_path, s.kind, m.depth, regexp_matches(lower(s.file_path), '/tests?/|[._]test\\.|[._]spec\\.|^tests?/') AS is_test FROM m JOIN symbols s ON s.id = m.id WHERE m.id NOT IN (SELECT id FROM {seeds}))
SELECT * FROM f WHERE {where}"""


@query(_impact("target", 3))
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).impact(SUPPLIER, 3)


@query(_impact("target", 3, "is_test"))
def impact_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).impact(SUPPLIER, 3).where("is_test")


@query(_impact("target", 3).replace("SELECT * FROM f WHERE true", "SELECT depth, count(*) AS symbols FROM f WHERE NOT is_test GROUP BY depth"))
def impact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.impact_groups(g.impact(SUPPLIER, 3))


@query(_impact("infile", 2))
def file_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).file_impact(FILE, 2)


@query(ARGS + f""", tr AS (SELECT DISTINCT [e.from_id, t.id] AS path, 1 AS depth FROM edges e JOIN target t ON {sql_match('e.to_id', 't')} WHERE e.kind = 'calls' UNION SELECT list_prepend(e.from_id, tr.path), depth + 1 FROM tr JOIN edges e ON e.kind = 'calls' AND e.to_id = tr.path[1] WHERE depth < 3 AND NOT list_contains(tr.path, e.from_id))
SELECT array_to_string(path, ' > ') AS path, len(path)::INT AS steps, {sql_name('path[1]', 's')} AS first_name FROM tr LEFT JOIN symbols s ON s.id = path[1] WHERE path[1] NOT IN (SELECT to_id FROM edges WHERE kind = 'calls')""")
def trace_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).trace(SUPPLIER, 3).withColumn("path", F.array_join("path", " > "))


@query(ARGS + f""", tr AS (SELECT DISTINCT [e.from_id, t.id] AS path, 1 AS depth FROM edges e JOIN target t ON {sql_match('e.to_id', 't')} WHERE e.kind = 'calls' UNION SELECT list_prepend(e.from_id, tr.path), depth + 1 FROM tr JOIN edges e ON e.kind = 'calls' AND e.to_id = tr.path[1] WHERE depth < 10 AND NOT list_contains(tr.path, e.from_id))
SELECT array_to_string(path, ' > ') AS path, len(path)::INT AS steps, {sql_name('path[1]', 's')} AS first_name FROM tr LEFT JOIN symbols s ON s.id = path[1] WHERE path[1] NOT IN (SELECT to_id FROM edges WHERE kind = 'calls') ORDER BY steps, first_name, path LIMIT 20""")
def trace_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 paths of up to ten calls: the search ends at the level that has them."""
    return graph(spark, sf_dir).trace(SUPPLIER, 10, 20).withColumn("path", F.array_join("path", " > "))


@query(WITH + """, k AS (SELECT *, CASE WHEN contains(to_id, '::') THEN string_split(to_id, '::')[-1] ELSE to_id END AS a FROM edges), b AS (SELECT *, CASE WHEN contains(a, '.') THEN string_split(a, '.')[-1] ELSE a END AS key FROM k),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY parent_id IS NOT NULL, id) AS r FROM symbols) WHERE r = 1)
SELECT b.from_id, b.to_id, b.kind, coalesce(s.id, best.id) AS resolved_id FROM b LEFT JOIN symbols s ON s.id = b.to_id LEFT JOIN best ON best.name = b.key""")
def resolve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).resolve_edges().select("from_id", "to_id", "kind", "resolved_id")


@query(ARGS + f""" SELECT k.id, k.name, k.kind, coalesce(c.n, 0)::BIGINT AS caller_count FROM (SELECT * FROM kids ORDER BY parent_id IS NOT NULL, line_start, id LIMIT 21) k
LEFT JOIN (SELECT s.id, count(*) AS n FROM kids s JOIN edges e ON e.kind = 'calls' AND {sql_match('e.to_id', 's', False)} GROUP BY s.id) c ON c.id = k.id""")
def sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).sketch(NATION, 20).select("id", "name", "kind", *big("caller_count"))


def _sql_counts(of: str) -> str:
    return f"(SELECT s.id, count(*) AS n FROM {of} s JOIN edges e ON e.kind = 'calls' AND {sql_match('e.to_id', 's', False)} GROUP BY s.id)"


@query(ARGS + f""", mem AS (SELECT s.* FROM symbols s JOIN cls ON s.parent_id = cls.id ORDER BY s.line_start, s.id LIMIT 20)
SELECT 'symbol' AS section, name, id, kind, line_start, coalesce(signature, '') AS text, (SELECT count(*) FROM symbols s JOIN cls ON s.parent_id = cls.id)::BIGINT AS n FROM cls
UNION ALL SELECT 'member', m.name, m.id, m.kind, m.line_start, coalesce(m.signature, ''), coalesce(c.n, 0)::BIGINT FROM mem m LEFT JOIN {_sql_counts('mem')} c ON c.id = m.id
UNION ALL SELECT relation, name, '', '', 0, '', 0 FROM ({_sql['class_relationships']})""")
def sketch_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).whole_sketch(NATION, 20, docs=False).drop("line_end").na.fill(0).na.fill("")


@query(ARGS + f""" SELECT 'symbol' AS section, name, id, kind, line_start, coalesce(signature, '') AS text, 0::BIGINT AS n FROM target
UNION ALL SELECT 'call', callee, '', '', 0, '', 0 FROM ({_sql['outgoing_calls']}) UNION ALL SELECT 'caller', caller, caller_id, '', 0, '', call_count::BIGINT FROM ({_sql['incoming_callers']})""")
def sketch_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).whole_sketch(SUPPLIER, 20, docs=False).drop("line_end").na.fill(0).na.fill("")


@query(ARGS + f" SELECT k.id, k.name, k.line_start, coalesce(c.n, 0)::BIGINT AS caller_count FROM infile k LEFT JOIN (SELECT s.id, count(*) AS n FROM infile s JOIN edges e ON e.kind = 'calls' AND {sql_match('e.to_id', 's', False)} GROUP BY s.id) c ON c.id = k.id")
def file_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).file_sketch(FILE).select("id", "name", "line_start", *big("caller_count"))


# Overviews

SQL_DIR = "CASE WHEN contains(regexp_replace(file_path, '^src/', ''), '/') THEN string_split(regexp_replace(file_path, '^src/', ''), '/')[1] ELSE '(root)' END || '/'"


def _documents_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Documents as functions of files of several languages and groups, users' events as calls between them."""
    d = table(spark, sf_dir, "documents")
    ends = F.array(F.lit(".controller.ts"), F.lit("/nightly_job.py"), F.lit("/message_handler.go"), F.lit(".rs"))
    path = F.concat(F.lit("src/"), "source", F.get(ends, (F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int") % 4)))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    none = F.lit(None).cast("string")
    symbols = d.select(
        F.concat_ws("::", path, name, F.lit("function"), "doc_id").alias("id"), name.alias("name"), F.lit("function").alias("kind"), path.alias("file_path"), F.col("doc_id").cast("int").alias("line_start"),
        F.col("doc_id").cast("int").alias("line_end"), none.alias("signature"), none.alias("docstring"), none.alias("parent_id"), F.col("lang").alias("language"), F.lit("{}").alias("metadata"),
    )
    caller, callee = F.concat(F.lit("f"), F.col("user_id").cast("string")), F.concat(F.lit("f"), (F.col("event_id") % 500).cast("string"))
    edges = table(spark, sf_dir, "events").select(caller.alias("from_id"), callee.alias("to_id"), F.lit("calls").alias("kind")).distinct()
    return CodeGraph(symbols, edges.withColumn("file_path", F.lit("src/a")).withColumn("line", F.lit(1)))


SQL_DOCUMENTS_GRAPH = """sy AS (SELECT 'f' || doc_id AS name, 'src/' || source || ['.controller.ts', '/nightly_job.py', '/message_handler.go', '.rs'][regexp_extract(source, '([0-9]+)$', 1)::INT % 4 + 1] AS file_path FROM documents),
called AS (SELECT DISTINCT 'f' || (event_id % 500) AS name FROM events)"""
_GROUPS = "CASE WHEN contains(file_path, 'controller') THEN 'API Controllers' WHEN contains(file_path, 'job') THEN 'Background Workers' WHEN contains(file_path, 'handler') THEN 'Event Handlers' ELSE 'Other' END"


@query("SELECT lang AS language, count(DISTINCT source) AS files, count(*) AS symbols FROM documents GROUP BY lang")
def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _documents_graph(spark, sf_dir)
    return g.languages().join(g.language_stats(), "language")


@query(f"WITH {SQL_DOCUMENTS_GRAPH} SELECT {_GROUPS} AS entry_group, count(*) AS entries, count(DISTINCT file_path) AS files, 0::BIGINT AS fan_out FROM sy WHERE name NOT IN (SELECT name FROM called) GROUP BY 1")
def document_entry_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_graph(spark, sf_dir).entrypoint_groups()


@query(WITH + f" SELECT {SQL_DIR} AS directory, count(DISTINCT file_path) AS file_count, count(*) AS symbol_count FROM symbols GROUP BY 1")
def directory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).directory_stats()


@query(WITH + " SELECT DISTINCT language FROM symbols")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).languages()


@query(WITH + " SELECT language, count(DISTINCT file_path) AS files, count(*) AS symbols FROM symbols GROUP BY language")
def language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).language_stats()


@query(WITH + " SELECT (SELECT count(*) FROM symbols) AS symbol_count, (SELECT count(DISTINCT file_path) FROM symbols) AS file_count, (SELECT count(*) FROM edges) AS edge_count")
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).counts()


@query("SELECT max(doc_id * 7 + 1700000000) AS last_indexed FROM documents")
def last_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return CodeGraph(g.symbols, g.edges, table(spark, sf_dir, "documents").select((F.col("doc_id") * 7 + 1700000000).alias("indexed_at"))).last_indexed()


@query("SELECT doc_id, CASE WHEN a < 60 THEN 'just now' WHEN a < 3600 THEN (a // 60) || ' minute' || (CASE WHEN a // 60 = 1 THEN '' ELSE 's' END) || ' ago' WHEN a < 86400 THEN (a // 3600) || ' hour' || (CASE WHEN a // 3600 = 1 THEN '' ELSE 's' END) || ' ago' WHEN a < 172800 THEN 'yesterday' ELSE (a // 86400) || ' days ago' END AS age FROM (SELECT doc_id, doc_id * 997 AS a FROM documents)")
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.relative_time(-F.col("doc_id") * 997, F.lit(0)).alias("age"))


@query(WITH + " SELECT 'symbol_kind' AS rule, count(*) AS broken FROM symbols WHERE kind NOT IN ('function', 'class', 'method', 'interface', 'struct', 'enum', 'const', 'type', 'property', 'module') HAVING count(*) > 0")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from grove.schema import violations

    g = graph(spark, sf_dir)
    return violations(g.symbols, g.edges).groupBy("rule").agg(F.count("*").alias("broken"))


@query(WITH + """, sx AS (SELECT id, kind, parent_id FROM symbols UNION ALL SELECT id, kind, parent_id FROM symbols WHERE kind = 'class' UNION ALL SELECT id || '!', 'gadget', 'nobody' FROM symbols WHERE kind = 'function'),
ex AS (SELECT from_id, to_id, kind FROM edges UNION ALL SELECT from_id, to_id, kind FROM edges WHERE kind = 'implements' UNION ALL SELECT from_id, to_id, 'shouts' FROM edges WHERE kind = 'extends')
SELECT 'symbol_id_unique' AS rule, count(*) AS broken FROM (SELECT id FROM sx GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'symbol_kind', count(*) FROM sx WHERE kind = 'gadget' UNION ALL SELECT 'parent_exists', count(*) FROM sx WHERE parent_id NOT IN (SELECT id FROM sx)
UNION ALL SELECT 'edge_kind', count(*) FROM ex WHERE kind = 'shouts' UNION ALL SELECT 'edge_unique', count(*) FROM (SELECT 1 FROM ex GROUP BY from_id, to_id, kind HAVING count(*) > 1)""")
def schema_violations_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five rules on the graph with some of its rows repeated and some broken."""
    from grove.schema import violations

    g = graph(spark, sf_dir)
    broken = g.symbols.where("kind = 'function'").withColumns({"id": F.concat("id", F.lit("!")), "kind": F.lit("gadget"), "parent_id": F.lit("nobody")})
    symbols = g.symbols.unionByName(g.symbols.where("kind = 'class'")).unionByName(broken)
    edges = g.edges.unionByName(g.edges.where("kind = 'implements'")).unionByName(g.edges.where("kind = 'extends'").withColumn("kind", F.lit("shouts")))
    return violations(symbols, edges).groupBy("rule").agg(F.count("*").alias("broken"))


# Text search

SQL_CAMEL = "regexp_replace(regexp_replace({0}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')"
SQL_TEXT = f"""{SQL_IMPORTANCE}, cn AS (SELECT symbol_id, string_agg(name, ' ' ORDER BY name) AS names FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY name) AS n FROM (SELECT DISTINCT e.to_id AS symbol_id, s.name FROM edges e JOIN symbols s ON s.id = e.from_id WHERE e.kind = 'calls')) WHERE n <= 10 GROUP BY symbol_id),
ce AS (SELECT symbol_id, string_agg(name, ' ' ORDER BY name) AS names FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY name) AS n FROM (SELECT DISTINCT e.from_id AS symbol_id, s.name FROM edges e JOIN symbols s ON s.id = e.to_id WHERE e.kind = 'calls')) WHERE n <= 10 GROUP BY symbol_id),
docs AS (SELECT s.id AS symbol_id, s.name, s.kind, s.file_path, concat_ws(' | ', s.kind || ' ' || s.name, CASE WHEN {SQL_CAMEL.format('s.name')} <> s.name THEN {SQL_CAMEL.format('s.name')} END, CASE WHEN contains(s.name, '_') THEN replace(s.name, '_', ' ') END, nullif(s.signature, ''), nullif(s.docstring, ''), 'in ' || p.name,
    'in ' || CASE WHEN {SQL_CAMEL.format('p.name')} <> p.name THEN {SQL_CAMEL.format('p.name')} END, 'path ' || nullif(array_to_string(list_filter(string_split(s.file_path, '/'), lambda x: x <> 'src' AND NOT contains(x, '.')), ' '), ''),
    'called-by ' || cn.names, 'calls ' || ce.names, CASE WHEN imp.importance > 0.7 THEN 'importance high core' WHEN imp.importance > 0.3 THEN 'importance medium' END) AS body
FROM symbols s LEFT JOIN symbols p ON p.id = s.parent_id LEFT JOIN cn ON cn.symbol_id = s.id LEFT JOIN ce ON ce.symbol_id = s.id LEFT JOIN imp ON imp.to_id = s.id)"""


@query(WITH + f", {SQL_TEXT} SELECT symbol_id, body FROM docs")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_documents(graph(spark, sf_dir)).select("symbol_id", "body")


def sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"


@query(WITH + f""", {SQL_TEXT}, sec AS (SELECT symbol_id, list_filter(string_split(body, ' | ')[1:4], lambda x: NOT regexp_matches(x, '^(importance|path|called-by|calls|in) ')) AS s FROM docs),
w AS (SELECT symbol_id, list_filter(flatten(list_transform(s, lambda x: list_transform({sql_words('x')}, lambda y: lower(y)))), lambda y: octet_length(encode(y)) >= 3) AS w FROM sec)
SELECT symbol_id, array_to_string(list_filter(w, lambda y, i: list_position(w, y) = i)[1:8], ' ') AS terms FROM w""")
def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_documents(graph(spark, sf_dir)).select("symbol_id", F.array_join(T.key_terms(F.col("body")), " ").alias("terms"))


@query(f"""WITH t AS (SELECT item_id, list_filter(list_transform({sql_words("text || ' TideGauge reset_at_ebb XMLReader'")}, lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{Nd}}_]', '', 'g')), lambda w: w <> '') AS ws FROM benchmark),
p AS (SELECT item_id, flatten(list_transform(ws, lambda w: list_concat([w], list_filter(list_transform({sql_words(SQL_CAMEL.format('w'))}, lambda x: lower(x)), lambda x: x <> lower(w) AND octet_length(encode(x)) >= 3),
    CASE WHEN contains(w, '_') THEN list_filter(list_transform({sql_words("replace(w, '_', ' ')")}, lambda x: lower(x)), lambda x: octet_length(encode(x)) >= 3) ELSE [] END))) AS q FROM t)
SELECT item_id, array_to_string(list_filter(q, lambda y, i: list_position(q, y) = i), ' ') AS terms FROM p""")
def fts_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.lit(" TideGauge reset_at_ebb XMLReader"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_terms(text), " ").alias("terms"))


def sql_bm25(docs: str, patterns: list[str], kind: str | None, limit: int) -> str:
    """A WITH clause's tables up to page (symbol_id, name, rank, score); patterns of one token each."""
    tok = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')"
    f = lambda p: f"5.0 * len(list_filter(tn, lambda x: starts_with(x, '{p}'))) + 10.0 * len(list_filter(tb, lambda x: starts_with(x, '{p}')))"
    cols = ", ".join(f"{f(p)} AS f{i}" for i, p in enumerate(patterns))
    idf = ", ".join(f"(SELECT CASE WHEN v <= 0 THEN 1e-6 ELSE v END FROM (SELECT ln((count(*) - count(*) FILTER (f{i} > 0) + 0.5) / (count(*) FILTER (f{i} > 0) + 0.5)) AS v FROM hit)) AS i{i}" for i in range(len(patterns)))
    rank = " + ".join(f"i{i} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / avglen))" for i in range(len(patterns)))
    any_hit = " OR ".join(f"f{i} > 0" for i in range(len(patterns)))
    return f"""tk AS (SELECT symbol_id, name, kind, {tok('name')} AS tn, {tok('body')} AS tb FROM {docs}), hit AS (SELECT symbol_id, name, kind, len(tn) + len(tb) AS len, {cols} FROM tk),
st AS (SELECT avg(len) AS avglen, {idf} FROM hit), rk AS (SELECT symbol_id, name, kind, -({rank}) AS rank FROM hit, st WHERE {any_hit}),
pg AS (SELECT * FROM rk WHERE {f"kind = '{kind}'" if kind else 'true'} ORDER BY rank, symbol_id LIMIT {limit}),
page AS (SELECT symbol_id, name, round(rank, 6) AS rank, round(CASE WHEN max(rank) OVER () - min(rank) OVER () < 1e-15 THEN 0.95 ELSE 1 - (rank - min(rank) OVER ()) / nullif(max(rank) OVER () - min(rank) OVER (), 0) * 0.5 END, 6) AS score FROM pg)"""


SEARCH = "trash disgustingThing"
SQL_DOCS = "docs AS (SELECT doc_id::VARCHAR AS symbol_id, source AS name, lang AS kind, text AS body FROM documents)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("symbol_id"), F.col("source").alias("name"), F.col("lang").alias("kind"), F.lit("").alias("file_path"), F.col("text").alias("body"))


def _page(df: DataFrame) -> DataFrame:
    return df.select("symbol_id", "name", F.round("rank", 6).alias("rank"), F.round("score", 6).alias("score"))


_patterns = [p.lower() for p in T.query_patterns(SEARCH)]


@query(f"WITH {SQL_DOCS}, {sql_bm25('docs', _patterns, None, 10)} SELECT * FROM page")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(search.bm25(search.build_index(_documents(spark, sf_dir)), SEARCH, None, 10))


@query(f"WITH {SQL_DOCS}, {sql_bm25('docs', _patterns, 'en', 5)} SELECT * FROM page")
def bm25_search_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(search.bm25(search.build_index(_documents(spark, sf_dir)), SEARCH, "en", 5))


@query(f"WITH {SQL_DOCS}, {sql_bm25('docs', _patterns, None, 10)} SELECT * FROM page")
def bm25_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same page from an index of segments: at first without one language and with other texts in another, then as the table is."""
    docs = _documents(spark, sf_dir)
    text = SegmentedText.of(spark, scratch(spark, "segments"), stemmed=False)
    old = docs.where("kind <> 'fr'").withColumn("body", F.when(F.col("kind") == "de", F.concat(F.lit("trash "), "body")).otherwise(F.col("body")))
    text = text.updated(old.unionByName(docs.limit(1).withColumn("symbol_id", F.lit("gone"))))
    return _page(search.bm25(text.updated(docs).index(), SEARCH, None, 10))


#: Words of the symbol's kind and name; its brand, the other key term, is no prefix of any word.
SIMILAR, LIMIT_SIMILAR = "old rod", 1000


@query(WITH + f""", {SQL_TEXT}, {sql_bm25('docs', ['interface', 'old', 'rod'], 'interface', 2 * LIMIT_SIMILAR)},
exact AS (SELECT pg.symbol_id, pg.name, pg.rank AS full_rank, page.rank, page.score FROM pg JOIN page USING (symbol_id))
SELECT symbol_id, name, rank, score FROM exact WHERE name <> '{SIMILAR}' ORDER BY full_rank, symbol_id LIMIT {LIMIT_SIMILAR}""")
def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return _page(search.similar(g, search.graph_index(g), SIMILAR, "interface", LIMIT_SIMILAR))


# Change tracking


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("docs/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("file_path"), F.col("text"), F.sha2("text", 256).alias("hash"))


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Current and stored hashes: of ten files one is gone, one new and one changed."""
    f = _files(spark, sf_dir)
    part = F.col("doc_id") % 10
    stored = f.where(part != 1).select("file_path", F.when(part == 2, F.sha2(F.concat(F.lit("old"), F.col("text")), 256)).otherwise(F.col("hash")).alias("hash"), F.col("doc_id").alias("indexed_at"))
    return f.where(part != 0).select("file_path", "hash"), stored


SQL_FILES = "f AS (SELECT doc_id, 'docs/' || lang || '/' || source || '/' || doc_id || '.md' AS file_path, text, sha256(text) AS hash FROM documents)"


@query(f"WITH {SQL_FILES} SELECT file_path, CASE doc_id % 10 WHEN 0 THEN 'deleted' WHEN 1 THEN 'added' ELSE 'modified' END AS change FROM f WHERE doc_id % 10 < 3")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.changed_files(*_states(spark, sf_dir))


def _listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A listing a day: the files are what a user's events of that day name, their hashes the day's largest values; users' nations stand for projects."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("p"), (F.col("user_id") % 25).cast("string")).alias("project"), F.unix_date(F.to_date("ts")).cast("long").alias("listing"), F.concat_ws("/", "event_type", "props").alias("path"), F.date_format("ts", "HH").alias("hash"))
    each = e.groupBy("project", "listing", "path").agg(F.max("hash").alias("hash"))
    none = F.lit(None).cast("string")
    state = e.where("hash < '06'").groupBy("project", "path").agg(F.min("hash").alias("hash"))
    return each.unionByName(e.select("project", "listing").distinct().withColumns({"path": none, "hash": none})), state


@query("""WITH e AS (SELECT 'p' || (user_id % 25) AS project, date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS listing, concat_ws('/', event_type, props) AS path, strftime(ts, '%H') AS hash FROM events),
o AS (SELECT project, listing, row_number() OVER (PARTITION BY project ORDER BY listing) AS n FROM (SELECT DISTINCT project, listing FROM e)),
l AS (SELECT e.project, o.n, path, max(hash) AS hash FROM e JOIN o USING (project, listing) GROUP BY ALL UNION ALL SELECT project, 0, path, min(hash) FROM e WHERE hash < '06' GROUP BY ALL),
j AS (SELECT coalesce(b.project, a.project) AS project, coalesce(b.n, a.n + 1) AS n, coalesce(b.path, a.path) AS path, a.hash AS was, b.hash AS now FROM l a FULL JOIN (SELECT * FROM l WHERE n > 0) b ON a.project = b.project AND a.path = b.path AND a.n + 1 = b.n)
SELECT project, o.listing, path, CASE WHEN now IS NULL THEN 'deleted' WHEN was IS NULL THEN 'added' ELSE 'modified' END AS change FROM j JOIN o USING (project, n) WHERE was IS DISTINCT FROM now""")
def listing_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.listing_changes(*_listings(spark, sf_dir))


@query(f"WITH {SQL_FILES} SELECT file_path, hash, CASE WHEN doc_id % 10 IN (1, 2) THEN 99 ELSE doc_id END AS indexed_at FROM f WHERE doc_id % 10 <> 0")
def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, stored = _states(spark, sf_dir)
    return change.upsert_hashes(stored, current, change.changed_files(current, stored), F.lit(99))


@query(WITH + f" SELECT from_id, to_id, kind FROM edges WHERE file_path <> '{FILE}'")
def file_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return change.without_files(g.edges, spark.createDataFrame([(FILE,)], "file_path string")).select("from_id", "to_id", "kind")


IGNORE = ["docs/fr/*/*", "src1?", "*7.md", "!**/src3/*7.md", "es"]


@query(f"WITH {SQL_FILES} SELECT file_path FROM f WHERE NOT (CASE WHEN contains('/' || file_path || '/', '/es/') THEN true WHEN regexp_matches(file_path, '(^|/)src3/[^/]*7\\.md$') THEN false WHEN regexp_matches(file_path, '7\\.md$') THEN true WHEN regexp_matches(file_path, '(^|/)src1[^/](/|$)') THEN true ELSE regexp_matches(file_path, '^docs/fr/[^/]*/[^/]*$') END)")
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(~tree.ignored(F.col("file_path"), IGNORE)).select("file_path")


@query(f"""WITH {SQL_FILES}, d AS (SELECT DISTINCT 'docs/' || lang AS project FROM documents WHERE lang < 'fr' UNION SELECT 'docs/' || lang || '/' || source FROM documents GROUP BY lang, source HAVING count(*) > 12)
SELECT file_path, coalesce((SELECT max_by(project, length(project)) FROM d WHERE starts_with(file_path, project || '/')), '') AS project FROM f""")
def nested_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects at two levels: some languages, and their sources with more than 12 documents."""
    docs, at = table(spark, sf_dir, "documents"), F.concat(F.lit("docs/"), "lang")
    projects = docs.where("lang < 'fr'").select(at.alias("project")).union(docs.groupBy(F.concat_ws("/", at, "source").alias("project")).agg(F.count("*").alias("n")).where("n > 12").select("project"))
    return tree.owners(_files(spark, sf_dir).select("file_path"), projects)


@query(f"""WITH {SQL_FILES}, m AS (SELECT file_path, CASE WHEN doc_id % 5 = 2 THEN sha256('x' || text) ELSE hash END AS want FROM f WHERE doc_id % 5 <> 1), d AS (SELECT file_path, hash AS have FROM f WHERE doc_id % 5 <> 0)
SELECT coalesce(m.file_path, d.file_path) AS file_path, CASE WHEN have IS NULL THEN 'MISSING' WHEN want IS NULL THEN 'NEW' ELSE 'MODIFIED' END AS problem FROM m FULL JOIN d ON m.file_path = d.file_path WHERE have IS DISTINCT FROM want""")
def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, part = _files(spark, sf_dir), F.col("doc_id") % 5
    lines = f.where(part != 1).select("file_path", F.when(part == 2, F.sha2(F.concat(F.lit("x"), F.col("text")), 256)).otherwise(F.col("hash")).alias("hash"))
    listed = change.parse_manifest(change.manifest_lines(lines).select(F.col("line").alias("value")))
    return change.verify_manifest(listed, f.where(part != 0).select("file_path", "hash"))


@query(WITH + """, a AS (SELECT count(*) AS s, count(DISTINCT file_path) AS f FROM symbols WHERE kind <> 'method'), b AS (SELECT count(*) AS s, count(DISTINCT file_path) AS f FROM symbols WHERE kind <> 'function'),
ae AS (SELECT count(*) AS e FROM edges WHERE kind <> 'imports'), be AS (SELECT count(*) AS e FROM edges) SELECT greatest(b.s - a.s, 0) AS symbols_added, greatest(be.e - ae.e, 0) AS edges_added, greatest(b.f - a.f, 0) AS files_added FROM a, b, ae, be""")
def index_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    before = CodeGraph(g.symbols.where("kind <> 'method'"), g.edges.where("kind <> 'imports'"))
    return change.index_deltas(before.counts(), CodeGraph(g.symbols.where("kind <> 'function'"), g.edges).counts())


@query(f"WITH {SQL_FILES}, l AS (SELECT file_path, string_split(text, chr(10)) AS ls FROM f) SELECT file_path, 2 AS line_start, i::INT AS line_no, ls[i] AS line FROM l, unnest([2, 3, 4]) u(i) WHERE i <= len(ls)")
def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    return tree.source_lines(f, f.select("file_path", F.lit(2).alias("line_start"), F.lit(4).alias("line_end")))


@query(f"WITH {SQL_FILES} SELECT file_path, line, array_to_string(string_split(text, chr(10))[greatest(line - 1, 1):line + 1], chr(10)) AS snippet FROM (SELECT *, (doc_id % 4 + 1)::INT AS line FROM f)")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    return tree.snippets(f.select("file_path", (F.col("doc_id") % 4 + 1).cast("int").alias("line")), f, 1).select("file_path", "line", "snippet")


DIFF = "--- a/lib/x.ts\n+++ b/lib/x.ts\n@@ -{0},3 +{0},4 @@\n a\n-b\n+c\n+d\n e\n"


@query("SELECT l_orderkey AS diff_id, 'lib/x.ts' AS file_path, (l_linenumber * 10 + o)::INT AS line FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), unnest([1, 2]) u(o)")
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("diff_id"), "l_linenumber").repartition("diff_id").distinct()
    hunk = lambda n: F.format_string(DIFF.replace("{0}", "%1$d"), n * 10)
    texts = rows.groupBy("diff_id").agg(F.sort_array(F.collect_list("l_linenumber")).alias("lines")).select("diff_id", F.array_join(F.transform("lines", hunk), "").alias("text"))
    return change.diff_lines(texts)


# Workspaces

SQL_WS = "ws AS (SELECT DISTINCT e.kind, e.file_path, e.line, e.from_id, e.to_id, (CASE WHEN regexp_extract(e.file_path, '^src/customer/(\\d+)', 1) = '' THEN 'other' WHEN regexp_extract(e.file_path, '^src/customer/(\\d+)', 1)::INT < 10 THEN 'low' ELSE 'high' END) AS project FROM edges e)"


def _members(g: CodeGraph) -> dict[str, CodeGraph]:
    n = F.nullif(F.regexp_extract("file_path", r"^src/customer/(\d+)", 1), F.lit("")).cast("int")
    part = F.when(n.isNull(), "other").when(n < 10, "low").otherwise("high")
    return {p: CodeGraph(g.symbols, g.edges.where(part == p)) for p in ("low", "high", "other")}


@query(ARGS + f", {SQL_WS} SELECT e.project, e.kind, e.file_path, e.line, e.from_id, {SQL_DISPLAY} AS from_name, e.to_id FROM ws e JOIN target t ON {sql_match('e.to_id', 't')} LEFT JOIN symbols s ON s.id = e.from_id LEFT JOIN symbols p ON p.id = s.parent_id WHERE e.kind = 'calls' ORDER BY e.kind, from_name, project, e.file_path, e.line, e.to_id LIMIT 40")
def workspace_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.workspace_refs(_members(graph(spark, sf_dir)), SUPPLIER, ["calls"], 40).select("project", "kind", "file_path", "line", "from_id", "from_name", "to_id")


@query(f"""WITH {SQL_DOCS}, {sql_bm25('docs', _patterns, None, 1000000)}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY rank, symbol_id) AS n FROM rk), t AS (SELECT * FROM r WHERE n <= 8)
SELECT project, symbol_id, round(score, 6) AS score FROM (SELECT kind AS project, symbol_id, CASE WHEN max(rank) OVER w - min(rank) OVER w < 1e-15 THEN 0.95 ELSE 1 - (rank - min(rank) OVER w) / nullif(max(rank) OVER w - min(rank) OVER w, 0) * 0.5 END AS score FROM t WINDOW w AS (PARTITION BY kind)) ORDER BY score DESC, project, symbol_id LIMIT 8""")
def workspace_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.ranks(search.build_index(_documents(spark, sf_dir)), SEARCH).withColumnRenamed("kind", "project")
    return workspace.workspace_find(found, 8).select("project", "symbol_id", F.round("score", 6).alias("score"))


@query(WITH + f", {SQL_CORE}, p AS (SELECT {SQL_DIR} AS project, * FROM core WHERE caller_count > 0 AND kind IN ('function', 'method')), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY caller_count DESC, name, id) AS n FROM p) SELECT project, id, caller_count FROM r WHERE n <= 20 ORDER BY caller_count DESC, name, project, id LIMIT 10")
def workspace_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    rows = g.summed_callers(g.symbols.where("kind IN ('function', 'method')")).withColumn("project", N.top_directory(F.col("file_path")))
    return workspace.workspace_core(rows, 10).select("project", "id", *big("caller_count"))


@query(f"""WITH {SQL_FILES} SELECT file_path, replace(replace(file_path, '/', chr(92)), chr(92), '/') AS path, doc_id || '-' || (doc_id + n) AS span, CASE WHEN length(text) > 30 THEN left(text, 27) || '...' ELSE text END AS short, format('{{:,}}', n) AS number,
    lang || '::' || file_path AS workspace_id, coalesce(nullif(lang, 'en'), source) AS member, file_path AS loc_file, n::INT AS loc_line, string_split(file_path, '/')[-2] AS parent, ends_with(file_path, '.md') AS is_md
FROM (SELECT f.*, d.lang, d.source, d.n_chars AS n FROM f JOIN documents d USING (doc_id))""")
def display_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display forms of paths, spans, texts and numbers; ids and names in a workspace; places of callers."""
    f = _files(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("n")), "doc_id")
    loc = N.caller_location(F.concat_ws(":", "file_path", "n"))
    return f.select(
        "file_path", N.normalized_path(F.replace("file_path", F.lit("/"), F.lit(chr(92)))).alias("path"), N.line_range(F.col("doc_id"), F.col("doc_id") + F.col("n")).alias("span"), N.shortened(F.col("text"), 30).alias("short"),
        N.grouped_number(F.col("n")).alias("number"), N.workspace_id(F.col("lang"), F.col("file_path")).alias("workspace_id"), N.member_name(F.when(F.col("lang") != "en", F.col("lang")), F.concat(F.lit("libs/"), "source", F.lit("/"))).alias("member"),
        loc["file"].alias("loc_file"), loc["line"].alias("loc_line"), N.second_last_part(F.replace("file_path", F.lit("/"), F.lit("::"))).alias("parent"), F.endswith("file_path", F.lit(".md")).alias("is_md"),
    )


@query(WITH + " SELECT kind, CASE kind WHEN 'instantiates' THEN 'creates' WHEN 'references_type' THEN 'uses type' ELSE kind END AS label, count(*) AS n FROM edges GROUP BY ALL")
def edge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).edges.groupBy("kind").agg(F.count("*").alias("n")).select("kind", N.edge_label(F.col("kind")).alias("label"), "n")


@query(_sql["trace_paths"].replace("SELECT array_to_string(path, ' > ')", "SELECT p.path, u.i AS pos, u.id, coalesce(s.name, string_split(u.id, '::')[2]) AS name, coalesce(s.line_start, 0)::INT AS line FROM (SELECT array_to_string(path, ' > ')", 1) + ") p, (SELECT unnest(string_split(p.path, ' > ')) AS id, unnest(range(len(string_split(p.path, ' > '))))::INT AS i) u LEFT JOIN symbols s ON s.id = u.id")
def path_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return g.path_steps(g.trace(SUPPLIER, 3)).select(F.array_join("path", " > ").alias("path"), "pos", "id", "name", "line")


@query(WITH + f", {SQL_TEXT}, {sql_bm25('docs', ['interface', 'old', 'rod'], None, 30)} SELECT page.symbol_id, page.name, page.rank, s.line_start::INT AS line_start, s.line_end::INT AS line_end FROM page JOIN symbols s ON s.id = page.symbol_id")
def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    found = search.bm25(search.graph_index(g), "interface old rod", None, 30)
    return search.with_lines(found, g.symbols).select("symbol_id", "name", F.round("rank", 6).alias("rank"), "line_start", "line_end")


@query("SELECT count(*) AS members, sum(s)::BIGINT AS symbol_count, sum(f)::BIGINT AS file_count, sum(e)::BIGINT AS edge_count, max(t) AS last_indexed, bool_and(t IS NOT NULL) AS indexed FROM (SELECT lang, count(*) AS s, count(DISTINCT source) AS f, sum(n_chars) AS e, max(doc_id) AS t FROM documents GROUP BY lang)")
def workspace_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("symbol_count"), F.countDistinct("source").alias("file_count"), F.sum("n_chars").alias("edge_count"), F.max("doc_id").alias("last_indexed"))
    return workspace.workspace_status(members)


# Streams of changes


@query("""WITH o AS (SELECT user_id, ts, event_type, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id AS project, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS ended, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths, count(*) AS events FROM s GROUP BY user_id, k""")
def debounce_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), "ts", F.col("event_type").alias("path"))
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return debounced(events, "6 hours").select("project", when("start").alias("started"), when("end").alias("ended"), F.array_join("paths", ",").alias("paths"), "events")


@query(r"""SELECT page_id, regexp_extract(x, 'href="([^"]*)"', 1) AS to_id, 'imports' AS kind, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="[^"]*"')) AS x FROM pages) GROUP BY ALL""")
def html_link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("to_id"))
    return links.groupBy("page_id", "to_id").agg(F.count("*").alias("n")).select("page_id", "to_id", F.lit("imports").alias("kind"), "n")


# Runs of agents


@query("SELECT conv_id AS run_id, sum(length(text))::BIGINT AS input_tokens, sum(turn)::BIGINT AS output_tokens, sum(CASE WHEN turn % 2 = 0 THEN 5 ELSE 0 END)::BIGINT AS cache_read_input_tokens FROM conversations WHERE turn % 5 <> 4 GROUP BY conv_id")
def ndjson_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    numbers = F.struct(F.char_length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"), F.when(F.col("turn") % 2 == 0, 5).alias("cache_read_input_tokens"))
    event = F.when(F.col("turn") % 5 == 4, F.lit("{broken")).when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.lit("message").alias("type"), F.struct(numbers.alias("usage")).alias("message")))).otherwise(F.to_json(F.struct(F.lit("delta").alias("type"), numbers.alias("usage"))))
    return runs.usage(runs.parse_stream(c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), event.alias("value")))).select("run_id", "input_tokens", "output_tokens", "cache_read_input_tokens")


SQL_CALLS = """c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Read' WHEN 'assistant' THEN 'Bash' ELSE 'Task' END AS tool, text FROM conversations WHERE text IS NOT NULL)"""


@query(f"""WITH {SQL_CALLS}, s AS (SELECT *, CASE tool WHEN 'Task' THEN to_json({{'prompt': text}})::VARCHAR ELSE text END AS picked FROM c),
b AS (SELECT *, encode(picked) AS bytes FROM s WHERE tool = 'Read' OR octet_length(encode(picked)) <= 100 OR octet_length(encode(picked)) = length(picked))
SELECT conv_id, turn, tool, CASE WHEN tool <> 'Read' AND octet_length(bytes) > 100 THEN left(picked, 100) || '...' ELSE picked END AS summary FROM b""")
def argument_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as calls of tools; those whose cut could fall within a character are left to the tests."""
    tool = F.when(F.col("role") == "user", "Read").when(F.col("role") == "assistant", "Bash").otherwise("Task")
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", tool.alias("tool"), "text")
    args = F.when(F.col("tool") == "Read", F.to_json(F.struct(F.col("text").alias("file_path")))).when(F.col("tool") == "Bash", F.to_json(F.struct(F.col("text").alias("command")))).otherwise(F.to_json(F.struct(F.col("text").alias("prompt"))))
    rows = c.withColumn("args", args).withColumn("whole", F.when(F.col("tool") == "Task", F.col("args")).otherwise(F.col("text")))
    plain = (F.col("tool") == "Read") | (F.octet_length("whole") <= 100) | (F.octet_length("whole") == F.char_length("whole"))
    return rows.where(plain).select("conv_id", "turn", "tool", runs.argument_summary(F.col("tool"), F.col("args")).alias("summary"))


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind, third = F.col("event_type"), F.col("event_id") % 3
    command = F.when(third == 0, F.concat(F.lit("grove find f"), (k % 5).cast("string"))).when(third == 1, F.concat(F.lit("grove callers s"), (k % 3).cast("string"))).otherwise(F.concat(F.lit("grove refs s"), (k % 3).cast("string")))
    return e.select(
        F.col("user_id").alias("run_id"), F.struct("ts", "event_id").alias("sequence"),
        F.when(kind == "view", "Read").when(kind == "click", "Glob").when(kind == "purchase", "Edit").when(kind == "signup", "Bash").otherwise("Grep").alias("tool_name"),
        F.when(kind == "signup", command).otherwise(F.concat(F.lit("f"), (k % 5).cast("string"))).alias("summary"),
        kind.isin("view", "click", "error").alias("is_navigation"), (kind == "purchase").alias("is_edit"), (kind == "signup").alias("is_tool_command"),
    )


SQL_ACTIONS = r"""ev AS (SELECT user_id AS run_id, ts, event_id, event_type AS t, regexp_extract(props, '"k": (\d+)', 1)::INT AS k FROM events),
ac AS (SELECT *, row_number() OVER w - 1 AS i, CASE WHEN t = 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'grove find f' || (k % 5) WHEN 1 THEN 'grove callers s' || (k % 3) ELSE 'grove refs s' || (k % 3) END ELSE 'f' || (k % 5) END AS s,
    coalesce(sum((t = 'purchase')::INT) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS eb, max((t = 'error')::INT) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS gn FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)),
fe AS (SELECT run_id, coalesce(min(i) FILTER (t = 'purchase'), count(*)) AS b FROM ac GROUP BY run_id),
bm AS (SELECT a.run_id, max(b)::BIGINT AS actions_before_first_edit, CASE WHEN count(*) FILTER (t = 'purchase') = 0 THEN 'infinity'::DOUBLE ELSE count(*) FILTER (t IN ('view', 'click', 'error')) / (count(*) FILTER (t = 'purchase'))::DOUBLE END AS navigation_to_edit_ratio,
    count(DISTINCT s) FILTER (t = 'view') AS unique_files_read, count(*) FILTER (t = 'view') - count(DISTINCT s) FILTER (t = 'view') AS redundant_reads, count(*) AS total_actions, count(*) FILTER (t = 'signup') AS tool_commands, count(*) FILTER (t = 'signup' AND i < b) AS tool_commands_before_first_edit,
    (SELECT count(*) FROM (SELECT DISTINCT c.i FROM ac c JOIN ac r ON r.run_id = c.run_id AND r.eb = c.eb AND r.i > c.i AND r.t = 'view' AND contains(c.s, r.s) WHERE c.run_id = a.run_id AND c.t = 'signup')) AS command_then_read,
    count(*) FILTER (t = 'signup' AND contains(s, 'grove find') AND gn = 1) AS grep_after_find,
    EXISTS (SELECT 1 FROM ac c JOIN ac r ON r.run_id = c.run_id AND r.t = 'signup' AND c.t = 'signup' AND starts_with(c.s, 'grove callers ') AND starts_with(r.s, 'grove refs ') AND c.s[15:] = r.s[12:] WHERE c.run_id = a.run_id) AS callers_and_refs
FROM ac a JOIN fe USING (run_id) GROUP BY a.run_id)"""


@query(f"WITH {SQL_ACTIONS} SELECT run_id, actions_before_first_edit, round(navigation_to_edit_ratio, 9) AS navigation_to_edit_ratio, unique_files_read, redundant_reads, total_actions, tool_commands, tool_commands_before_first_edit, command_then_read, grep_after_find, callers_and_refs FROM bm")
def behavior_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = "actions_before_first_edit unique_files_read redundant_reads total_actions tool_commands tool_commands_before_first_edit command_then_read grep_after_find".split()
    return runs.behaviour(_actions(spark, sf_dir)).withColumn("navigation_to_edit_ratio", F.round("navigation_to_edit_ratio", 9)).withColumns({c: F.col(c).cast("long") for c in whole})


@query(f"""WITH {SQL_ACTIONS}, c AS (SELECT *, CASE WHEN run_id % 2 = 0 THEN 'with' ELSE 'without' END AS condition FROM bm), x AS (SELECT condition, max(navigation_to_edit_ratio) FILTER (isfinite(navigation_to_edit_ratio)) AS m FROM c GROUP BY condition)
SELECT c.condition, round(avg(actions_before_first_edit), 6) AS mean_actions_before_edit, round(avg(unique_files_read), 6) AS mean_unique_reads, round(avg(redundant_reads), 6) AS mean_redundant_reads, round(avg(tool_commands), 6) AS mean_tool_commands, sum(command_then_read)::BIGINT AS command_then_read_count,
    sum(grep_after_find)::BIGINT AS grep_after_find_count, sum(callers_and_refs::INT)::BIGINT AS callers_and_refs_count, round(avg(CASE WHEN isfinite(navigation_to_edit_ratio) THEN navigation_to_edit_ratio ELSE m END), 6) AS mean_navigation_ratio FROM c JOIN x USING (condition) GROUP BY c.condition""")
def behavior_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = runs.behaviour(_actions(spark, sf_dir)).withColumn("condition", F.when(F.col("run_id") % 2 == 0, "with").otherwise("without"))
    out = runs.compare_behaviour(metrics)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("mean_")})


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("task-"), F.col("o_orderpriority").substr(1, 1), F.lit("-"), (k % 7).cast("string")).alias("task_id"), F.when(k % 2 == 0, "with").otherwise("without").alias("condition"),
        (k % 1000 * 10 + F.when(k % 2 == 0, 500).otherwise(900)).alias("input_tokens"), (k % 37).alias("output_tokens"), (k % 11).alias("file_reads"), (k % 1000 * 3).alias("cache_read"),
        (k % 3 > 0).alias("compilation_pass"), (k % 4 > 0).alias("tests_pass"), F.when(k % 5 > 0, k % 10 / 10).alias("coverage"), F.lit(0.8).alias("threshold"),
    )


SQL_RUNS = """r AS (SELECT 'task-' || o_orderpriority[1] || '-' || (o_orderkey % 7) AS task_id, CASE WHEN o_orderkey % 2 = 0 THEN 'with' ELSE 'without' END AS condition, o_orderkey % 1000 * 10 + CASE WHEN o_orderkey % 2 = 0 THEN 500 ELSE 900 END AS input_tokens, o_orderkey % 37 AS output_tokens, o_orderkey % 11 AS file_reads, o_orderkey % 1000 * 3 AS cache_read,
    o_orderkey % 3 > 0 AS compilation_pass, o_orderkey % 4 > 0 AS tests_pass, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 10) / 10.0::DOUBLE END AS coverage, 0.8::DOUBLE AS threshold FROM orders), sc AS (SELECT *, (CASE WHEN coverage IS NULL THEN compilation_pass::INT * 50 + tests_pass::INT * 50 ELSE compilation_pass::INT * 40 + tests_pass::INT * 40 + CASE WHEN coverage >= threshold THEN 20 ELSE floor(coverage / threshold * 20) END END)::INT AS score FROM r)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


@query(f"WITH {SQL_RUNS} SELECT condition, task_id, count(*) AS runs, round(avg(input_tokens), 6) AS mean_input, round(coalesce(stddev_samp(input_tokens), 0), 6) AS stddev_input, round(avg(output_tokens), 6) AS mean_output, round(avg(file_reads), 6) AS mean_file_reads FROM r GROUP BY ALL")
def run_report_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(runs.token_report(_runs(spark, sf_dir), ["condition", "task_id"]))


@query(f"WITH {SQL_RUNS} SELECT condition, round(100 * avg(compilation_pass::INT), 6) AS compilation_pct, round(100 * avg(tests_pass::INT), 6) AS tests_pct, round(avg(score), 6) AS mean_score FROM sc GROUP BY condition")
def run_report_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _runs(spark, sf_dir).withColumn("overall_score", runs.score(F.col("compilation_pass"), F.col("tests_pass"), F.col("coverage"), F.col("threshold")))
    return _rounded(runs.correctness_report(scored, ["condition"]))


@query(f"WITH {SQL_RUNS}, m AS (SELECT array_to_string(string_split(task_id, '-')[1:2], '-') AS category, avg(input_tokens) FILTER (condition = 'with') AS a, avg(input_tokens) FILTER (condition = 'without') AS b FROM r GROUP BY 1) SELECT category, round(a, 6) AS mean_with, round(b, 6) AS mean_without, round((1 - a / nullif(b, 0)) * 100, 6) AS reduction_pct FROM m")
def run_report_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(runs.category_report(_runs(spark, sf_dir).withColumn("category", N.task_category(F.col("task_id"))), "with", "without"))


@query(f"WITH {SQL_RUNS} SELECT condition, round(avg(input_tokens), 6) AS mean_total, round(avg(input_tokens - cache_read), 6) AS mean_fresh, round(avg(cache_read), 6) AS mean_cache_read, round(sum(cache_read) / sum(input_tokens)::DOUBLE, 6) AS cache_hit_rate FROM r GROUP BY condition")
def token_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(runs.token_decomposition(_runs(spark, sf_dir), ["condition"]))


@query(f"WITH {SQL_RUNS} SELECT score, count(*) AS runs FROM sc GROUP BY score")
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select(runs.score(F.col("compilation_pass"), F.col("tests_pass"), F.col("coverage"), F.col("threshold")).alias("score")).groupBy("score").agg(F.count("*").alias("runs"))


@query("""WITH c AS (SELECT DISTINCT 'f' || (l_suppkey % 50) AS file_path, (l_orderkey % 2000)::INT AS line FROM lineitem), m AS (SELECT DISTINCT 'f' || (user_id % 50) AS file_path, (event_id % 2000)::INT AS line FROM events)
SELECT count(*) FILTER (h) AS covered, count(*) AS total, round(count(*) FILTER (h) / count(*)::DOUBLE, 4) AS coverage FROM (SELECT EXISTS (SELECT 1 FROM m WHERE m.file_path = c.file_path AND abs(m.line - c.line) <= 5) AS h FROM c)""")
def caller_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("f"), (F.col(c) % 50).cast("string")).alias("file_path")
    calls = table(spark, sf_dir, "lineitem").select(name("l_suppkey"), (F.col("l_orderkey") % 2000).cast("int").alias("line"))
    return change.caller_coverage(calls, table(spark, sf_dir, "events").select(name("user_id"), (F.col("event_id") % 2000).cast("int").alias("line")))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)

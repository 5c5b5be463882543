"""From source files to answers: extraction, full and incremental indexing, ignore rules, envelopes, streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from grove.api import NotFoundError, Project, Workspace, envelope, stream_envelope, write_envelope
from grove.operators import change
from grove.sources import tree
from grove.sources.extract import REGISTRY, extract_python
from grove.sources.index import KEPT, TABLES, Index
from grove.streaming import watch

SERVICE = """import { Request } from './types';

export class Shop {
  private log: Log;

  constructor(log: Log) {
    this.log = log;
  }

  /** Sells one. */
  async sell(request: Request): Promise<void> {
    this.log.info('selling { a } thing');
    const item = new Item(request);
    price(item);
  }
}

export const price = (item: Item) => item.cost();
"""
PYTHON = '''import os
from shop import Shop as S


class Till(S):
    """Takes money."""

    def take(self, amount: int, *, tip=0) -> bool:
        return self.shop.sell(amount) and os.getcwd()


async def _main():
    Till().take(1)
'''


def edges(found):
    return {(s and s.split("::")[1], t, k) for s, t, k, _ in found.edges}


def test_typescript():
    f = REGISTRY["typescript"]("src/shop.ts", SERVICE)
    assert [(s["name"], s["kind"], s["line_start"], s["line_end"]) for s in f.symbols] == [("Shop", "class", 3, 16), ("log", "property", 4, 4), ("constructor", "method", 6, 8), ("sell", "method", 11, 15), ("price", "function", 18, 18)]
    assert f.symbols[3]["parent_id"] == "src/shop.ts::Shop::class::3" and f.symbols[3]["docstring"] == "/** Sells one. */" and json.loads(f.symbols[3]["metadata"])["is_async"]
    assert edges(f) >= {(None, "./types::Request", "imports"), ("Shop", "Log", "references_type"), ("constructor", "Log", "references_type"), ("sell", "log.info", "calls"), ("sell", "Item", "instantiates"), ("sell", "price", "calls"), ("price", "item.cost", "calls")}


def test_python():
    f = extract_python("a.py", PYTHON)
    assert [(s["name"], s["kind"], s["parent_id"]) for s in f.symbols] == [("Till", "class", None), ("take", "function", None), ("_main", "function", None)]
    assert f.symbols[0]["docstring"] == "Takes money."
    m = json.loads(f.symbols[1]["metadata"])
    assert m["parameters"] == [{"name": "amount", "type": "int", "has_default": False}, {"name": "tip", "type": None, "has_default": True}] and m["return_type"] == "bool"
    assert edges(f) == {(None, "os", "imports"), (None, "shop::Shop", "imports"), ("Till", "S", "extends"), ("take", "shop.sell", "calls"), ("take", "os.getcwd", "calls"), ("_main", "Till", "calls")}
    assert extract_python("b.py", "def broken(:").symbols == []


SAMPLES = {
    "csharp": ("namespace A {\npublic class Cart : ICart {\n  private int n;\n  public Cart(int n) {\n    this.n = n;\n  }\n  public bool Add(Item i) {\n    _log.Info(1);\n    return Check(i);\n  }\n} }", {"Cart", "Add"}, {("Cart", "ICart", "implements"), ("Add", "_log.Info", "calls"), ("Add", "Check", "calls")}),
    "java": ("import a.b.C;\npublic class Cart extends Base implements One, Two {\n  private int n = 1;\n  public boolean add(Item i) {\n    log.info(i);\n    return new Box(i).ok();\n  }\n}", {"Cart", "n", "add"}, {("Cart", "Base", "extends"), ("Cart", "One", "implements"), ("Cart", "Two", "implements"), ("add", "log.info", "calls"), ("add", "Box", "instantiates"), (None, "a.b.C", "imports")}),
    "kotlin": ("class Cart(val n: Int) : Base(n), Other {\n  fun add(i: Item): Boolean {\n    return log.info(i)\n  }\n}", {"Cart", "add"}, {("Cart", "Base", "implements"), ("Cart", "Other", "implements"), ("add", "log.info", "calls")}),
    "swift": ("protocol Sellable {\n  func sell()\n}\nclass Cart: Sellable {\n  var n = 1\n  func sell() {\n    log.info(n)\n  }\n}", {"Sellable", "Cart", "n", "sell"}, {("Cart", "Sellable", "implements"), ("sell", "log.info", "calls")}),
    "rust": ("use a::b::C;\npub struct Cart { n: u8 }\nimpl Cart {\n  pub fn add(&self, i: Item) -> bool {\n    println!(\"x\");\n    check(i)\n  }\n}", {"Cart", "add"}, {(None, "a::b::C", "imports"), ("add", "println!", "calls"), ("add", "check", "calls"), ("add", "Item", "references_type")}),
    "go": ("package a\nimport \"fmt\"\ntype Cart struct {\n\tn int\n}\nfunc (c *Cart) Add(i Item) bool {\n\tc.log.Info(i)\n\treturn check(i)\n}\n", {"Cart", "Add"}, {(None, "fmt", "imports"), ("Add", "log.Info", "calls"), ("Add", "check", "calls")}),
    "php": ("<?php\nnamespace A;\nuse B\\C;\nclass Cart extends Base {\n  use Counts;\n  private int $n = 1;\n  public function add($i) {\n    $this->log->info($i);\n    return new Box($i);\n  }\n}", {"A", "Cart", "n", "add"}, {("Cart", "Base", "extends"), ("Cart", "Counts", "includes"), ("add", "log.info", "calls"), ("add", "Box", "instantiates")}),
    "ruby": ("require 'a'\nmodule Shop\n  class Cart < Base\n    include Counts\n    attr_reader :n\n    def add(i)\n      if i\n        log.info(i)\n      end\n      check(i)\n    end\n  end\nend\n", {"Shop", "Cart", "n", "add"}, {(None, "a", "imports"), ("Cart", "Base", "extends"), ("Cart", "Counts", "includes"), ("add", "log.info", "calls"), ("add", "check", "calls")}),
    "lua": ("local a = require('b')\nlocal function add(i)\n  if i then\n    log.info(i)\n  end\n  return check(i)\nend\n", {"add"}, {(None, "b", "imports"), ("add", "log.info", "calls"), ("add", "check", "calls")}),
    "bash": ("source ./a.sh\nadd() {\n  echo hi\n  check \"$1\"\n}\n", {"add"}, {(None, "./a.sh", "imports"), ("add", "check", "calls")}),
    "c": ("#include \"a.h\"\nstruct Cart {\n  int n;\n};\nint add(int i) {\n  printf(\"x\");\n  return check(i);\n}\n", {"Cart", "add"}, {(None, "a.h", "imports"), ("add", "check", "calls")}),
    "cpp": ("#include <a>\nnamespace shop {\nclass Cart : public Base {\n public:\n  bool add(int i) {\n    return log->check(i);\n  }\n};\n}\n", {"shop", "Cart", "add"}, {(None, "a", "imports"), ("Cart", "Base", "extends"), ("add", "check", "calls")}),
    "protobuf": ("import \"a.proto\";\nmessage Cart {\n  repeated Item items = 1;\n}\nservice Shop {\n  rpc Add(Cart) returns (Reply);\n}\n", {"Cart", "items", "Shop", "Add"}, {(None, "a.proto", "imports"), ("Cart", "Item", "references_type"), ("Add", "Cart", "references_type"), ("Add", "Reply", "references_type")}),
    "sql": ("CREATE TABLE carts (\n  id INTEGER,\n  item INTEGER REFERENCES items(id)\n);\nCREATE VIEW v AS SELECT price(id) FROM carts JOIN items ON 1 = 1;\n", {"carts", "id", "item", "v"}, {("carts", "items", "references_type"), ("v", "carts", "references_type"), ("v", "items", "references_type"), ("v", "price", "calls")}),
}


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_language(language):
    text, symbols, wanted = SAMPLES[language]
    f = REGISTRY[language]("f", text)
    assert {s["name"] for s in f.symbols} >= symbols
    assert edges(f) >= wanted
    for broken in ("", text[: len(text) // 2], "}}}{{{((("):
        REGISTRY[language]("f", broken)


@pytest.fixture
def shop(tmp_path):
    for path, text in {"src/shop.ts": SERVICE, "src/till.py": PYTHON, "node_modules/x.ts": "function no() {}", "src/gen/big.ts": "function gen() {}", ".gitignore": "# made\ngen/\n", "lib/own/.grove/config.toml": "", "lib/own/a.py": "def own(): pass"}.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(text)
    return tmp_path


def test_project(spark, shop):
    p = Project(spark, str(shop))
    assert p.init()["languages"] == [] and p.reindex(full=True)["added"] == 2
    with pytest.raises(FileExistsError):
        p.init()
    assert p.reindex() == {"added": 0, "modified": 0, "deleted": 0}
    assert {r["name"] for r in p.sketch("Shop").where("section IN ('symbol', 'member')").collect()} == {"Shop", "log", "constructor", "sell"}
    assert [(r["from_name"], r["snippet"].strip()) for r in p.callers("sell").collect()] == [("take", "return self.shop.sell(amount) and os.getcwd()")]
    assert {r["name"] for r in p.find("selling price").collect()} >= {"price", "sell"}
    assert [r["line"] for r in p.source("price").collect()] == ["export const price = (item: Item) => item.cost();"]
    assert "Shop" not in {r["name"] for r in p.similar("Shop").collect()}
    assert p.status().first()["file_count"] == 2 and p.trace("sell").count() == 2
    with pytest.raises(NotFoundError):
        p.refs("nobody")
    (shop / "src/till.py").write_text("def one(): two()\n")
    (shop / "src/new.py").write_text("def two(): pass\n")
    os.unlink(shop / "src/shop.ts")
    done = p.reindex()
    assert (done["added"], done["modified"], done["deleted"]) == (1, 1, 1)
    assert {r["name"] for r in p.index.table("symbols").collect()} == {"one", "two"}
    e = json.loads(envelope("callers", p.callers("two"), "two", 5))
    assert e["total"] == 1 and not e["truncated"] and e["symbol"] == "two"
    p.index.delete_files(["src/new.py"])
    assert {r["name"] for r in p.index.table("symbols").collect()} == {"one"}
    p.map()["core_symbols"].collect()


def test_workspace(spark, tmp_path):
    for m, text in (("a", "def one(): shared()\n"), ("b", "def shared(): pass\ndef two(): shared()\n")):
        os.makedirs(tmp_path / m / ".grove")
        (tmp_path / m / ".grove/config.toml").write_text("")
        (tmp_path / m / "x.py").write_text(text)
    w = Workspace(spark, str(tmp_path))
    assert w.init("both")["members"] == ["a", "b"]
    w.reindex()
    s = w.status().first()
    assert (s["members"], s["symbol_count"], s["indexed"]) == (2, 3, True)
    assert w.refs("shared").count() == 1  # only where the member knows the symbol
    assert [r["project"] for r in w.core_symbols(5).collect()] == ["b"]
    assert {r["project"] for r in w.find("shared").collect()} <= {"a", "b"}
    with pytest.raises(ValueError):
        tree.load_workspace("[workspace]\nversion = 2\n")


@pytest.mark.parametrize(("patterns", "path", "want"), [
    (["gen/"], "src/gen/a.ts", True), (["*.min.js"], "a/b.min.js", True), (["src/*.ts"], "src/a.ts", True), (["src/*.ts"], "src/x/a.ts", False), (["**/x/*.ts"], "q/x/a.ts", True),
    (["*.ts", "!keep.ts"], "a/keep.ts", False), (["!keep.ts", "*.ts"], "a/keep.ts", True), (["a[12].ts"], "a2.ts", True), (["a?.ts"], "ab/c.ts", False), ([], "a", False),
])
def test_ignore(spark, patterns, path, want):
    assert tree.ignored_path(path, patterns) is want
    assert spark.range(1).select(tree.ignored(F.lit(path), patterns)).first()[0] is want


def test_diff_and_coverage(spark):
    text = "--- a/x.ts\n+++ b/x.ts\n@@ -10,3 +10,4 @@\n a\n+b\n c\n-d\n+e\n@@ -40 +41,2 @@\n+z\n y\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-q\n"
    lines = change.diff_lines(spark.createDataFrame([(1, text)], "diff_id int, text string"))
    assert {(r["file_path"], r["line"]) for r in lines.collect()} == {("x.ts", 11), ("x.ts", 13), ("x.ts", 41)}
    callers = spark.createDataFrame([("x.ts", 6), ("x.ts", 5), ("x.ts", 46), ("x.ts", 47), ("y.ts", 11)], "file_path string, line int")
    assert change.caller_coverage(callers, lines).first().asDict() == {"covered": 2, "total": 5, "coverage": 0.4}
    assert change.caller_coverage(callers.limit(0), lines).first()["coverage"] == 1.0


def test_manifest(spark):
    files = spark.createDataFrame([("a b.ts", "1"), ("c", "2")], "file_path string, hash string")
    again = change.parse_manifest(change.manifest_lines(files).withColumnRenamed("line", "value"))
    assert {tuple(r) for r in again.collect()} == {("a b.ts", "1"), ("c", "2")}
    assert change.verify_manifest(again, files).count() == 0


def test_stream_of_changes(spark, tmp_path):
    src, seen = tmp_path / "events", []
    spark.createDataFrame([("p", "a.ts", 0), ("p", "b.ts", 100), ("p", "a.ts", 200), ("p", "c.ts", 5000), ("p", "z", 999999)], "project string, path string, ms long").selectExpr("project", "path", "timestamp_millis(ms) AS ts").write.parquet(str(src))
    stream = spark.readStream.schema("project string, path string, ts timestamp").parquet(str(src))
    log = []
    q = watch.watch(watch.debounced(watch.relevant(stream, ["dist"], ["ts", "z"]), "300 milliseconds", "1 second"), lambda df: seen.extend(r["paths"] for r in df.collect()) or {}, log.append, str(tmp_path / "ck"), once=True)
    q.awaitTermination(60)
    assert sorted(seen) == [["a.ts", "b.ts"], ["c.ts"]] and log[0] == {"event": "start"}
    release = watch.claim(str(tmp_path))
    with pytest.raises(RuntimeError):
        watch.claim(str(tmp_path))
    release()
    (tmp_path / "watch.lock").write_text("999999999")
    watch.claim(str(tmp_path))()


@pytest.mark.parametrize("size", [10, 5_000, 50_000])
def test_long_comment_is_kept(size):
    words = "word " * size
    found = REGISTRY["java"]("A.java", f'String s = "/* no comment */";\n/* {words}*/\npublic class A {{}}\n')
    assert [s["docstring"] for s in found.symbols if s["name"] == "A"] == [f"/* {words}*/"]


def test_versions(spark, tmp_path):
    """A version without its mark doesn't count, the newest with one does, and old ones go."""
    index = Index(spark, str(tmp_path / "ix"))
    assert index.version() is None and index.table("symbols").count() == 0
    tables = [spark.createDataFrame([], TABLES[t]) for t in ("symbols", "edges", "files")]
    seen = []
    for _ in range(KEPT + 2):
        index.publish(*tables)
        seen.append(index.version())
    assert seen == sorted(set(seen)) and sorted(index._versions()) == seen[-KEPT:]
    (tmp_path / "ix" / "v-999999999999999-abcdef").mkdir()
    assert index.version() == seen[-1]


def test_owners_and_nested_projects(spark, tmp_path):
    for d in ("a", "a/in", "b/c", "x/y/z", "x/y/z/deep", "node_modules/m", ".hidden"):
        (tmp_path / d / ".grove").mkdir(parents=True)
        (tmp_path / d / ".grove" / "config.toml").write_text("")
    assert tree.project_configs(spark, str(tmp_path)) == ["a", "a/in", "b/c", "x/y/z"]
    assert tree.nested_projects(spark, f"file://{tmp_path}/") == ["a", "b/c", "x/y/z"]
    assert tree.nested_projects(spark, str(tmp_path / "b" / "c")) == []
    projects = spark.createDataFrame([("a",), ("a/in",), ("a/in",), ("b/c",)], "project string")
    paths = spark.createDataFrame([("a/1",), ("a/in/2",), ("a/inner/3",), ("b/4",), ("b/c/d/5",), ("top",), ("a",)], "file_path string")
    assert {tuple(r) for r in tree.owners(paths, projects).select("file_path", "project").collect()} == {("a/1", "a"), ("a/in/2", "a/in"), ("a/inner/3", "a"), ("b/4", ""), ("b/c/d/5", "b/c"), ("top", ""), ("a", "")}


@pytest.mark.parametrize("n", [0, 1, 7])
def test_envelopes(spark, tmp_path, n):
    rows = spark.range(n, numPartitions=3).select("id", F.concat(F.lit("é\n\"x"), "id").alias("name"), F.lit(None).cast("int").alias("line")).orderBy("id")
    want = [{"id": i, "name": f'é\n"x{i}', "line": None} for i in range(n)]
    total = write_envelope(str(tmp_path / "all.json"), "refs", rows, "a\"b")
    assert json.loads((tmp_path / "all.json").read_text()) == {"command": "refs", "symbol": 'a"b', "data": want, "truncated": False, "total": n} and total == n
    assert json.loads(envelope("refs", rows, limit=3)) == {"command": "refs", "data": want[:3], "truncated": n > 3, "total": n}


def test_a_large_envelope_passes_by_partitions(spark, tmp_path):
    """Half a million rows: the driver's Python holds a partition of them when they are streamed, and none when they are written."""
    import tracemalloc

    rows = spark.range(500_000, numPartitions=40).select("id", F.repeat(F.lit("x"), 40).alias("pad"))
    tracemalloc.start()
    assert write_envelope(str(tmp_path / "big.json"), "refs", rows) == 500_000
    assert tracemalloc.get_traced_memory()[1] < 5 << 20
    with open(tmp_path / "stream.json", "w") as f:
        assert stream_envelope(f.write, "refs", rows) == 500_000
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    assert json.loads((tmp_path / "big.json").read_text()) == json.loads((tmp_path / "stream.json").read_text())

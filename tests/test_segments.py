"""Buckets and segments: a refresh writes what changed, and answers are those of an index made at once."""

import random

from pyspark.sql import functions as F

from grove.operators import search
from grove.sources import index as ix
from grove.sources import segments
from grove.sources.index import Index
from grove.sources.segments import SegmentedText

DOCS = "symbol_id string, name string, kind string, file_path string, body string"
WORDS = "order orders priced stock store river item items total totals".split()


def page(text, query):
    return [(r["symbol_id"], round(r["rank"], 9), round(r["score"], 9)) for r in search.bm25(text, query, None, 50).orderBy("rank", "symbol_id").collect()]


def test_segments_answer_as_one_index(spark, tmp_path):
    r, stemmed = random.Random(1), True
    body = lambda: " ".join(r.choice(WORDS) for _ in range(r.randrange(12)))
    docs = {f"d{i}": body() for i in range(24)}
    text = SegmentedText.of(spark, str(tmp_path / "text"), stemmed=stemmed)
    sizes = []
    for step in range(5):
        if step:
            for k in r.sample(sorted(docs), 2):
                docs[k] = body()
            docs.pop(r.choice(sorted(docs)))
            docs[f"new{step}"] = body()
        df = spark.createDataFrame([(k, k + "Item", "function", "f", b) for k, b in docs.items()], DOCS)
        text = SegmentedText.of(spark, text.path, text.updated(df).state(), stemmed)
        sizes.append([s.docs for s in text.segments])
        if step in (1, 4):
            whole = search.build_index(df, stemmed, stemmed)
            for q in ("order stock", "ite"):
                assert page(text.index(), q) == page(whole, q) and page(whole, q)
            n, total = whole.lengths.agg(F.count("*"), F.sum("length")).first()
            assert (text.n, text.total) == (n, total)
    assert all(a > segments.GROWTH * b for each in sizes for a, b in zip(each, each[1:], strict=False)), sizes
    assert max(map(len, sizes)) > 1
    assert text.updated(df).segments == text.segments  # nothing changed: nothing is written
    assert page(text.updated(df.limit(0)).index(), "order") == []


def written(root):
    return {p.relative_to(root) for p in root.rglob("*.parquet")}


def test_a_refresh_writes_the_buckets_of_changed_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "LEAST_BUCKETS", 16)
    src = tmp_path / "src"
    src.mkdir()
    for i in range(20):
        (src / f"m{i}.py").write_text(f"def first{i}():\n    return shared()\n\n\ndef second{i}():\n    return first{i}()\n")
    index = Index(spark, str(tmp_path / "ix"))
    assert index.refresh(str(src))["added"] == 20
    root = tmp_path / "ix"
    for step in range(2):
        before, last = written(root), index.manifest()
        (src / f"m{step}.py").write_text(f"def first{step}():\n    return 1\n\n\ndef third{step}():\n    return first{step}()\n")
        assert {k: v for k, v in index.refresh(str(src)).items() if k in ("added", "modified", "deleted")} == {"added": 0, "modified": 1, "deleted": 0}
        new, now = written(root) - before, index.manifest()
        for t in ix.TABLES:
            moved = {b for b, v in now["tables"][t].items() if last["tables"][t].get(b) != v}
            assert len(moved) == 1, (t, moved)
            assert len([p for p in new if p.parts[:2] == ("data", t)]) == 1
        assert sum(s["docs"] for s in now["text"]["segments"] if s not in last["text"]["segments"]) <= 6
    (src / "m7.py").unlink()
    assert index.refresh(str(src))["deleted"] == 1
    index.delete_files(["m8.py", "nothing.py"])
    fresh = Index(spark, str(tmp_path / "again"))
    (src / "m8.py").unlink()
    fresh.refresh(str(src), full=True)
    for t in ("symbols", "edges"):
        rows = lambda i: sorted(map(str, i.table(t).collect()))  # noqa: B023, E731
        assert rows(index) == rows(fresh) and rows(fresh)
    assert {r["file_path"] for r in index.table("files").collect()} == {r["file_path"] for r in fresh.table("files").collect()}
    for q in ("first", "third1"):
        assert page(index.text(), q) == page(fresh.text(), q)
    assert sum(len(list((root / "data" / t).rglob("bucket=*"))) for t in ix.TABLES) <= 3 * (16 + 2 * ix.KEPT)

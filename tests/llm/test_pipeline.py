"""The pipeline's stages, one by one, against plain versions, and on odd rows."""

import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from grove.llm import quality, secrets, toxicity  # noqa: E402
from grove.llm.simhash import shingle_hashes  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name in ("toxicity", "quality"):
            module = {"toxicity": toxicity, "quality": quality}[name]
            model = module.fit(docs, labels)
            rejected = {r["doc_id"] for r in module.score(docs, model).collect() if (r["predicted"] == 1) == (name == "toxicity")}
            assert rejected and {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()} - rejected
        if name == "near_dedup":
            sets = {r["doc_id"]: set(shingle_hashes(r["text"], 5).tolist()) for r in docs.collect()}
            first = {d: d for d in sets}
            by = {}
            for d, s in sets.items():
                for h in s:
                    by.setdefault(h, []).append(d)
            pairs = {(a, b) for v in by.values() for a in v for b in v if a < b}
            pairs = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            for _ in range(20):
                for a, b in pairs:
                    first[a] = first[b] = min(first[a], first[b])
            assert pairs and {r["doc_id"] for r in out.collect()} == {d for d, f in first.items() if d == f}
        if name == "secrets":
            assert secrets.report(out).where("n_assign + n_access + n_hex > 0").count() == 0
            assert secrets.report(docs).where("n_assign + n_access + n_hex > 0").count() > 0
            assert out.count() == docs.count()
        if name == "packing":
            n = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).where("`sum(length)` <> `max(doc_tokens)`").count()
            assert n == 0 and out.select("doc_id").distinct().count() == docs.count()
        else:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_odd_rows(spark, request, rows):
    docs = request.getfixturevalue(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == docs.columns
        assert out.count() <= docs.count() or name == "packing"
        docs = out if name != "packing" else docs


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0

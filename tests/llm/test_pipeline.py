import os

import pytest

import corpus_pipeline
from tallyweave.llm import exact_dedup, odd_sketch
from tests.llm.helpers import awkward, docs, edited, prose

DATA = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_run_against_its_stages_by_hand(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    good = {r["doc_id"] for r in corpus_pipeline.quality(spark, d, DATA).select("doc_id").collect()}
    first: dict = {}
    for i in sorted(good):
        first.setdefault(texts[i], i)
    unique = set(first.values())
    kept = d.filter(d["doc_id"].isin(sorted(unique)))
    near = {r["doc_id"] for r in odd_sketch.near_duplicates(kept).collect()}
    bench = [" ".join(w for w in r["text"].lower().replace(".", " ").replace(",", " ").split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    flat = {i: " ".join(texts[i].lower().replace(".", " ").replace(",", " ").split()) for i in unique - near}
    leaked = {i for i, t in flat.items() if any(b in t for b in bench)}
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == unique - near - leaked and leaked


def test_stages_keep_the_columns(spark, tmp_path):
    base = prose(1, 200)
    d = docs(spark, [(1, base), (2, base), (3, edited(base, 1, 0.01)), (4, prose(2, 100)), (None, "x"), (5, None)])
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        d = stage(spark, d, DATA)
        path = os.path.join(tmp_path, stage.__name__)
        d.write.parquet(path)
        d = spark.read.parquet(path)
    assert sorted(str(r["doc_id"]) for r in d.collect()) == ["1", "4", "5", "None"]
    assert d.columns == docs(spark, []).columns
    assert corpus_pipeline.packed(spark, d, DATA).columns[0] == "doc_id"
    assert exact_dedup.exact_duplicates(d).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_every_stage_on_awkward_rows(spark, name):
    """Nulls, empty and very long texts, repeated rows, clashing names, an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    d = awkward(spark).withColumnRenamed("lang", "Text").withColumnRenamed("keep", "_tw_text").withColumnRenamed("shard", "DOC_ID")
    got = stage(spark, d, DATA)
    rows = got.collect()
    if name == "packing":
        assert sorted(r["doc_id"] for r in rows) == [2, 3, 4, 5, 5, 6]
    else:
        assert got.columns == d.columns and sum(r[0] is None for r in rows) == 2 and sum(r[1] is None for r in rows) == 2
        kept = {"exact_dedup": [1, 2, 4, 6], "near_dedup": [1, 2, 3, 4, 6]}.get(name, [1, 2, 3, 4, 5, 5, 6])
        if name != "quality_rules":
            assert sorted(r[0] for r in rows if r[0] is not None) == kept
    assert stage(spark, d.limit(0), DATA).count() == 0


def test_run_on_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""The stages one by one against plain versions, each on what the one before kept."""

import collections

import __spark_entry__
import corpus_pipeline
from convoy.llm import classifier, decontaminate, mixing, simhash
from convoy.llm.common import stored


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, kept[-1], sf_dir), "stage")
        assert k == 4 or out.columns == columns
        kept.append(out)
    raw, good, single, clean, mixed, files = kept
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = {r["doc_id"]: r["score"] for r in classifier.scored(raw, classifier.fit(classifier.training_rows(raw, labels))).collect()}
    assert {r["doc_id"] for r in good.collect()} == {d for d, s in score.items() if s >= 0.5}
    groups = simhash.near_duplicates(good).collect()
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({r["component_id"] for r in groups})
    report = decontaminate.report(single, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in report if not r["contaminated"])
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter({d: n for d, n in copies.items() if n})
    rows = files.orderBy("start").collect()
    assert len(rows) == mixed.count() and rows[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] and a["doc_id"] <= b["doc_id"] for a, b in zip(rows, rows[1:]))


def test_registered(spark, sf_dir):
    assert {f"op{k}" for k in range(1, 14)} == {n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()}
    assert "pipeline" in __spark_entry__.queries()

"""The corpus pipeline, stage by stage, against brute-force versions."""

import re
from collections import defaultdict

import corpus_pipeline
from edge_fixtures import SF_SMALL, edge_docs, no_docs  # noqa: F401

from plexnet.llm import ngram_join, quality_rules, toxicity


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    cols, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        if name != "packing":
            assert out.columns == cols
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept[name] = (docs, spark.read.parquet(path))
        docs = kept[name][1]
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = kept["quality_rules"]
    judged = quality_rules.judge(spark, before, labels).where("kept")
    assert ids(after) == ids(judged)
    before, after = kept["toxicity"]
    score = toxicity.scorer(spark, toxicity.train(spark, before, labels))
    assert ids(after) == ids(before.where(score(before.text) < 0.7))
    before, after = kept["exact_dedup"]
    first = {}
    for r in before.collect():
        k = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        first[k] = min(first.get(k, r.doc_id), r.doc_id)
    assert ids(after) == sorted(first.values())
    before, after = kept["ngram_join"]
    hashes = ngram_join._Hashes()
    sets = {r.doc_id: set(ngram_join.shingles(r.text, hashes).tolist()) for r in before.collect()}
    comp = {d: d for d in sets}
    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[i + 1:]:
            n = len(sets[a] & sets[b])
            if n and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
                ca, cb = comp[a], comp[b]
                comp = {d: min(ca, cb) if c in (ca, cb) else c for d, c in comp.items()}
    assert ids(after) == sorted(set(comp.values()))
    before, after = kept["packing"]
    total = defaultdict(int)
    for r in after.collect():
        total[r.doc_id] += r.length
        assert r.doc_tokens >= r.length
    assert sorted(total) == ids(before)
    whole = {r.doc_id: r.doc_tokens for r in after.collect()}
    assert total == whole


def test_edge_rows_pass_through_every_stage(spark, edge_docs, no_docs, tmp_path):
    for name, start in (("edge", edge_docs), ("none", no_docs)):
        docs = start
        for stage, f in corpus_pipeline.STAGES:
            f(spark, docs, SF_SMALL).write.parquet(str(tmp_path / name / stage))
            docs = spark.read.parquet(str(tmp_path / name / stage))
            if stage != "packing":
                assert docs.columns == start.columns
        assert docs.count() >= 0

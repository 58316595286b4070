"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing extra columns, for every operator and pipeline stage."""

import pytest

from edge_fixtures import edge_docs, edge_labels, no_docs  # noqa: F401

from plexnet.llm import bpe, chat, ctw, exact_dedup, ngram_join, packing, quality_classifier, quality_rules, toxicity, url_filter
from pyspark.sql import functions as F


def by_text(rows):
    return sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))


def test_quality_rules(spark, edge_docs, no_docs, edge_labels):
    rows = quality_rules.judge(spark, edge_docs, edge_labels).collect()
    assert len(rows) == 13
    r = {x.doc_id: x for x in rows if x.doc_id is not None}
    assert r[2].n_words == r[3].n_words == r[4].n_words == 0 and r[2].base_failed and not r[2].kept
    assert r[5].n_words == 30001 and r[5].n_repeat_words == 30000 and r[5].base_failed
    assert r[1].n_words == 90 and r[1].n_repeat_words == 90 and r[9].n_words == 90 and not r[9].base_failed
    assert quality_rules.judge(spark, no_docs, edge_labels).count() == 0
    out = quality_rules.keep_good(spark, edge_docs, edge_labels)
    assert out.columns == edge_docs.columns
    assert sorted(x.doc_id for x in out.collect()) == sorted(x.doc_id for x in rows if x.kept)
    assert quality_rules.judge(spark, edge_docs, edge_labels.limit(0)).where("kept").count() >= 1


def test_exact_dedup(spark, edge_docs, no_docs):
    rows = exact_dedup.dedup(spark, edge_docs).collect()
    assert len(rows) == 13 and sum(r.kept for r in rows) == 7
    body = [r for r in rows if r.keep_id == 1]
    assert len(body) == 5 and {r.group_size for r in body} == {5}  # white space runs and null ids included
    empty = [r for r in rows if r.keep_id == 2]
    assert {r.doc_id for r in empty} == {2, 3, None} and sum(r.kept for r in empty) == 1
    assert exact_dedup.dedup(spark, no_docs).count() == 0
    assert exact_dedup.drop_copies(spark, edge_docs).columns == edge_docs.columns
    assert exact_dedup.drop_copies(spark, edge_docs).count() == 7


def test_ngram_join(spark, edge_docs, no_docs):
    rows = ngram_join.classes(spark, edge_docs).collect()
    assert len(rows) == 13
    same = [r for r in rows if r.class_id == 1]
    assert len(same) >= 5 and sum(r.kept for r in same) == 1
    assert all(r.kept and r.class_size == 1 for r in rows if r.doc_id in (2, 3, 4))
    assert ngram_join.classes(spark, no_docs).count() == 0
    out = ngram_join.drop_near_copies(spark, edge_docs)
    assert out.columns == edge_docs.columns and out.count() == sum(r.kept for r in rows)


def test_bpe(spark, edge_docs, no_docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(bpe.vocabulary_path())
    got = by_text(bpe.encode(spark, edge_docs).collect())
    texts = by_text(edge_docs.select("doc_id", "text").collect())
    want = sorted(tok.encode(r.text or "", add_special_tokens=False).ids for r in texts)
    assert sorted(r.ids for r in got) == want
    back = bpe.decode(spark, bpe.encode(spark, edge_docs)).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in texts)
    assert bpe.round_trip(spark, no_docs).count() == 0


def test_packing(spark, edge_docs, no_docs):
    rows = packing.pack(spark, edge_docs).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in edge_docs.collect()}
    assert sum(r.length for r in rows if r.doc_id == 2) == 1  # null text: the end id only
    assert packing.pack(spark, no_docs).count() == 0


def test_toxicity(spark, edge_docs, no_docs, edge_labels):
    score = toxicity.scorer(spark, toxicity.train(spark, edge_docs, edge_labels))
    rows = edge_docs.select("doc_id", score(F.col("text")).alias("s")).collect()
    assert len(rows) == 13 and all(0 <= r.s <= 1 for r in rows)
    assert toxicity.train(spark, edge_docs, edge_labels.limit(0)) == []
    assert toxicity.train(spark, no_docs, edge_labels) is not None
    out = toxicity.drop_toxic(spark, edge_docs, edge_labels.limit(0))
    assert out.columns == edge_docs.columns and out.count() == 13
    assert toxicity.drop_toxic(spark, no_docs, edge_labels).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_quality_classifier(spark, edge_docs, no_docs, edge_labels, empty):
    model = quality_classifier.train(spark, edge_docs, edge_labels.limit(0) if empty else edge_labels)
    rows = edge_docs.select("doc_id", quality_classifier.score(spark, model).alias("s")).collect()
    assert len(rows) == 13 and all(0 <= r.s <= 1 for r in rows)
    assert no_docs.select(quality_classifier.score(spark, model).alias("s")).count() == 0


def test_ctw(spark, edge_docs, no_docs):
    docs = edge_docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    rows = ctw.scores(spark, docs, F.lit(True)).collect()
    assert len(rows) == 13 and all(r.score < 0 for r in rows)
    none = no_docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    assert ctw.scores(spark, none, F.lit(True)).count() == 0
    got = {r.row: r.score for r in ctw.scores(spark, docs, F.lit(False)).collect()}  # nothing known: every bit has probability 1/2
    size = {r.row: len((r.text or "").encode()) + 1 for r in docs.collect()}
    assert all(abs(got[k] + 8 * size[k] * 0.30102999566398) < 1e-6 * size[k] for k in got)
    base = {r.row: r for r in ctw.scores(spark, docs, F.lit(True)).collect()}
    assert len(base) == 13 and {base[r.row].n_tokens for r in docs.collect() if r.doc_id in (2, 3, 4)} == {1}


def test_url_filter(spark):
    pages = [(1, "http://a.org/x", None), (2, None, "<html>"), (3, "no scheme", ""), (None, "HTTPS://WWW.Example.COM/en/1?q#f", None),
             (5, "http://x.net", '<LINK href="http://b.net/es/1" rel=canonical>'), (5, "http://x.net", None),
             (6, "http://c.dev/a/b", '<meta http-equiv="refresh" content="0; url=../c">'), (7, "http://", None),
             (8, "http://sub.example.com/en/", "x" * 200000 + '<link rel="canonical" href="/en/">')]
    df = spark.createDataFrame([p + ("x",) for p in pages], "page_id bigint, url string, html string, host string")
    rows = url_filter.judge(spark, df).collect()
    assert len(rows) == 9
    v = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows]
    assert (None, "www.example.com", "/en/1", "www.example.com/en/", "allow") in v
    assert (8, "sub.example.com", "/en/", "example.com/en/", "block") in v
    assert v.count((5, "x.net", "", None, "block")) == 2  # its canonical page is blocked, its repeated row too
    assert (2, "", "", None, "allow") in v and (3, "", "", None, "allow") in v and (7, "", "", None, "allow") in v
    assert url_filter.judge(spark, df.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "Hello there?", "x"), (1, 1, "assistant", "Hi.\n\nHow are you", "x"), (1, 1, "assistant", "Hi.\n\nHow are you", "x"),
            (None, 0, "user", "no id", "x"), (2, 0, "user", None, "x"), (3, None, None, "", "x"), (4, 0, "system", "word " * 50000, "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, obs string").drop("obs")
    observed = chat.observe(chat.write_transcripts(df))
    model = chat.train(chat.with_first(observed))
    assert chat.render(chat.turns_of(spark, chat.recover(spark, observed, model))).count() >= 4
    raw = spark.createDataFrame([(1, "User: hi there\n\nAssistant: hello\nmore\n\nUser: bye"), (2, None), (3, "\n \n")], "conv_id bigint, text string")
    turns = chat.parse(spark, chat.split_transcripts(raw), model).orderBy("conv_id", "first_line").collect()
    assert {t.conv_id for t in turns} == {1}
    none = chat.split_transcripts(raw.limit(0))
    assert chat.parse(spark, none, model).count() == 0

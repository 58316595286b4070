"""The two trained classifiers against plain Python versions of their formulas, and held-out figures with floors."""

import re
import zlib

import numpy as np
import pytest
import zstandard
from edge_fixtures import SF_SMALL

from plexnet.llm import catalog, quality_classifier, toxicity
from pyspark.sql import functions as F

SF_LARGE = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):  # ties share their mean rank
        ranks[score == s] = ranks[score == s].mean()
    n = label.sum()
    return (ranks[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize("name,label,floors", [("op6_toxicity", "toxic", {"recall": 0.82, "precision": 0.9, "auc": 0.94}),
                                               ("op7_quality_classifier", "quality", {"recall": 0.97, "precision": 0.95, "auc": 0.97, "rejected": 0.8})])
def test_held_out_figures(spark, name, label, floors):
    labels = spark.read.parquet(f"{SF_LARGE}/labels.parquet").where(f"{label} IS NOT NULL").select("doc_id", label)
    rows = catalog.QUERIES[name](spark, SF_LARGE).where("held_out").join(labels, "doc_id").toPandas()
    y, p = rows[label].to_numpy(), rows.predicted.to_numpy()
    got = {"recall": p[y == 1].mean(), "precision": y[p == 1].mean(), "auc": auc(rows.score.to_numpy(), y), "rejected": 1 - p[y == 0].mean()}
    assert all(got[k] >= v for k, v in floors.items()), got
    assert rows.score.between(0, 1).all()


def plain_features(text):
    out = set()
    for word in re.findall(r"[^\W\d_]+", " ".join((text or "").split()).lower()):
        out.add(zlib.crc32(word.encode()) % toxicity.SPACE)
        out |= {zlib.crc32(b"<" + word[:n].encode()) % toxicity.SPACE for n in range(3, min(len(word), 7))}
    return out


def test_toxicity_scores_are_the_formula(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 50_000)], "doc_id bigint, text string"))
    models = toxicity.train(spark, docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", "toxic"))
    assert len(models) == toxicity.PARTS
    got = docs.select("doc_id", "text", toxicity.scorer(spark, models)(F.col("text")).alias("s")).collect()
    for r in got:
        found = plain_features(r.text)
        ps = [1 / (1 + np.exp(-(b + sum(w for f, w in zip(fs, ws, strict=True) if f in found)))) for fs, ws, b in models]
        assert r.s == pytest.approx(np.mean(ps), rel=1e-9)


def nnpu_risk(rows, positive, prior, feats, w, b):
    place = {int(f): i for i, f in enumerate(feats)}
    f = np.array([b + sum(w[place[x]] for x in r if x in place) for r in rows])
    loss = lambda z: np.logaddexp(0, -z)
    return prior * loss(f[positive]).mean() + max(0.0, loss(-f[~positive]).mean() - prior * loss(-f[positive]).mean())


def test_nnpu_minimises_the_non_negative_risk():
    """The fitted weights beat the prior alone, random directions from them, and training that takes U for negatives, on hidden labels."""
    rng = np.random.default_rng(4)
    toxic_words, other = np.arange(30), np.arange(100, 1000)

    def text(toxic):
        return np.unique(np.concatenate([rng.choice(other, 40), rng.choice(toxic_words, 4)] if toxic else [rng.choice(other, 40)]))
    prior = 0.2
    hidden = rng.random(1500) < prior
    rows = [text(True) for _ in range(300)] + [text(h) for h in hidden]
    positive = np.arange(1800) < 300
    feats, w, b = toxicity.nnpu_fit(rows, positive, prior)
    assert set(feats.tolist()) <= set(toxic_words.tolist()) and len(feats) > 20
    risk = nnpu_risk(rows, positive, prior, feats, w, b)
    assert risk < 0.5 * nnpu_risk(rows, positive, prior, feats, np.zeros(len(feats)), np.log(prior / (1 - prior)))
    for _ in range(20):
        d = rng.normal(size=len(feats))
        assert risk <= nnpu_risk(rows, positive, prior, feats, w + d, b) + 1e-3
    place = {int(f): i for i, f in enumerate(feats)}
    f = np.array([b + sum(w[place[x]] for x in r if x in place) for r in rows[300:]])
    assert ((f > 0) == hidden).mean() > 0.97


def test_quality_scores_are_the_formula(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 50_000)], "doc_id bigint, text string"))
    model = quality_classifier.train(spark, docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", "quality"))
    good, bad, slope, offset = model
    pack = [zstandard.ZstdCompressor(level=quality_classifier.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress
            for d in (bad, good)]
    for r in docs.select("doc_id", "text", quality_classifier.score(spark, model).alias("s")).collect():
        raw = (r.text or "").encode()
        blocks = [raw[i:i + quality_classifier.BLOCK] for i in range(0, len(raw), quality_classifier.BLOCK)]
        b, g = (sum(len(c(x)) for x in blocks) for c in pack)
        assert r.s == pytest.approx(1 / (1 + np.exp(-(slope * (b - g) / max(1, len(raw)) + offset))), rel=1e-9, abs=1e-12)


def test_curve_is_the_penalised_maximum():
    """Newton's result against a fine search around it."""
    rng = np.random.default_rng(2)
    x = rng.normal(0.01, 0.02, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(120 * x - 0.5)))).astype(float)
    slope, offset = quality_classifier.fit_curve(x, y)

    def cost(s, o):
        z = s * x + o
        return np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * 0.05 * (s * x.std()) ** 2 + 0.5 * 1e-6 * o ** 2
    best = cost(slope, offset)
    for ds in np.linspace(-5, 5, 21):
        for do in np.linspace(-0.3, 0.3, 21):
            assert best <= cost(slope + ds, offset + do) + 1e-9

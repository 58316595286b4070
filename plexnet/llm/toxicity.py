"""Toxicity by non-negative positive-unlabelled learning (operator 6).

Confirmed toxic texts (P) and a sample of all texts without regard to labels
(U) train linear numpy classifiers on the presence of hashed words and word
beginnings. With class prior pi the risk is

    pi * E_P[l(f, +1)] + max(0, E_U[l(f, -1)] - pi * E_P[l(f, -1)])

with the logistic loss l: unlabelled texts count as negatives, less the toxic
share among them, and the corrected negative risk may not fall below zero.
When it does, a step is taken to raise it again.

PARTS classifiers are trained at once on overlapping parts of the sample, each
in its own task; a text's score is their mean probability.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexnet.llm.common import crc_mod, read_table
from plexnet.shipping import ensure_importable

#: Bounds of the training sample (expected sizes; texts are drawn by a hash of their id).
MAX_POSITIVE, MAX_UNLABELLED = 6_000, 15_000
PARTS = 3
SPACE = 1 << 20  # hashed feature space
KEEP = 4096  # features a classifier may use
THRESHOLD = 0.7
LIFT, EVIDENCE = 10.0, 10.0
CACHE = 400_000  # chunks whose features a worker remembers

_LETTERS = re.compile(r"[^\W\d_]+")


def chunk_features(chunk: str) -> list[int]:
    """Hashed features of one white-space separated chunk: its words and
    their first 3 to 6 letters, lower-cased."""
    out = []
    for w in _LETTERS.findall(chunk.lower()):
        out.append(zlib.crc32(w.encode()) % SPACE)
        out.extend(zlib.crc32(b"<" + w[:n].encode()) % SPACE for n in range(3, min(len(w), 7)))
    return out


def _active(text: str | None, cache: dict, wanted=None) -> set[int]:
    found: set[int] = set()
    for c in set((text or "").split()):
        f = cache.get(c)
        if f is None:
            if len(cache) > CACHE:
                cache.clear()
            f = tuple(chunk_features(c))
            cache[c] = f = f if wanted is None else tuple(x for x in f if x in wanted)
        if f:
            found.update(f)
    return found



def nnpu_fit(rows: list, positive: np.ndarray, prior: float, steps: int = 800, rate: float = 0.05,
             l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """Train on ``rows`` (integer feature arrays) with flags ``positive``;
    returns (features, weights, bias).

    A feature is used if it is LIFT times as frequent in P as among negatives,
    whose rate is (rate in U - pi * rate in P) / (1 - pi), and if its count in
    P would be that high by chance with a Poisson log-likelihood ratio below
    EVIDENCE only.
    """
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    bias = float(np.log(prior / (1 - prior)))
    if not n_p or not n_u:
        return np.zeros(0, np.int64), np.zeros(0), bias
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    d_p = np.bincount(flat[positive[owner]], minlength=SPACE) / n_p
    d_u = np.bincount(flat[~positive[owner]], minlength=SPACE) / n_u
    neg = np.maximum((d_u - prior * d_p) / (1 - prior), 1 / n_u)
    seen, due = d_p * n_p, neg * n_p
    evidence = np.where(seen > LIFT * due, seen * np.log(np.maximum(seen, 1) / due) - seen + due, 0)
    order = np.argsort(-evidence, kind="stable")[:KEEP]
    feats = np.sort(order[evidence[order] > EVIDENCE])
    if not len(feats):
        return feats, np.zeros(0), bias
    place = np.full(SPACE, -1)
    place[feats] = np.arange(len(feats))
    use = place[flat] >= 0
    cols, own = place[flat[use]], owner[use]
    dot = lambda w: np.bincount(own, w[cols], len(rows))
    back = lambda g: np.bincount(cols, g[own], len(feats))
    w, b = np.zeros(len(feats)), bias
    m, v, t = np.zeros(len(feats) + 1), np.zeros(len(feats) + 1), 0
    weight_p, weight_u = positive * prior / n_p, ~positive / n_u
    for t in range(1, steps + 1):
        f = dot(w) + b
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        negative = np.sum((weight_u - weight_p) * np.logaddexp(0, f))  # E_U[l(f,-1)] - pi E_P[l(f,-1)]
        if negative >= 0:
            g = weight_p * (p - 1) + (weight_u - weight_p) * p
        else:
            g = -(weight_u - weight_p) * p
        grad = np.append(back(g) + l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return feats, w, float(b)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> list[tuple]:
    """Classifiers [(features, weights, bias)] from the rows of ``docs`` that
    satisfy ``learn`` (a condition on doc_id; all rows if None).

    ``labels(doc_id, toxic)`` names the confirmed toxic texts; its other rows
    only tell the class prior, their toxic share (within 0.005 and 0.5). Null
    ids and null labels teach nothing. Without a confirmed text the list is
    empty.
    """
    ensure_importable(spark)
    learn = F.lit(True) if learn is None else learn
    lab = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    n_lab, n_pos = lab.agg(F.count("*"), F.count_if(F.col("toxic") > 0)).first()
    if not n_pos:
        return []
    prior = float(np.clip(n_pos / n_lab, 0.005, 0.5))
    n_docs = docs.where(learn).count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    slim = docs.where(learn).select("doc_id", "text")
    p = lab.where("toxic > 0").where(draw < MAX_POSITIVE / n_pos).select("doc_id")
    pos = slim.join(F.broadcast(p), "doc_id", "left_semi")  # some MAX_POSITIVE ids, whatever the data
    pos = pos.withColumn("positive", F.lit(True))
    unl = slim.where(draw < MAX_UNLABELLED / max(n_docs, 1)).withColumn("positive", F.lit(False))
    own = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS))
    parts = F.filter(F.array(*map(F.lit, range(PARTS))), lambda i: i != own)
    sample = pos.union(unl).select("positive", "text", F.explode(parts).alias("part"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        cache: dict = {}
        rows = [np.fromiter(_active(t, cache), np.int64) for t in pdf["text"]]
        f, w, b = nnpu_fit(rows, pdf["positive"].to_numpy(bool), prior)
        return pd.DataFrame({"part": int(pdf["part"].iloc[0]), "features": [f.tolist()], "weights": [w.tolist()], "bias": [b]})

    fitted = sample.groupBy("part").applyInPandas(fit, "part int, features array<bigint>, weights array<double>, bias double")
    return [(r.features, r.weights, r.bias) for r in sorted(fitted.collect(), key=lambda r: r.part)]


def scorer(spark: SparkSession, models: list[tuple]):
    """A column function text -> probability of being toxic (null as empty;
    0 without a model). The model is at most PARTS * KEEP weights."""
    ensure_importable(spark)
    index = sorted({f for fs, _, _ in models for f in fs})
    place = {f: i for i, f in enumerate(index)}
    table = np.zeros((len(index) + 1, max(1, len(models))))
    for j, (fs, ws, _) in enumerate(models):
        table[[place[f] for f in fs], j] = ws
    bias = np.array([b for _, _, b in models])
    shared = spark.sparkContext.broadcast((place, table, bias))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place, table, bias = shared.value
        cache: dict = {}
        for s in texts:
            out = np.zeros(len(s))
            if len(bias):
                for i, t in enumerate(s):
                    hit = [place[f] for f in _active(t, cache, place)]
                    out[i] = np.mean(1 / (1 + np.exp(-np.clip(table[hit].sum(0) + bias, -30, 30))))
            yield pd.Series(out)
    return score


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """``docs`` without the rows scored THRESHOLD or more, columns unchanged.
    Null and empty texts score by the bias alone and stay; repeated rows are
    judged alike; an empty table gives an empty result."""
    score = scorer(spark, train(spark, docs, labels, learn))
    return docs.where(score(F.col("text")) < THRESHOLD)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learns from rows whose crc32 remainder by 3 is not 1,
    scores the whole ``documents`` table."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held = crc_mod(F.col("doc_id"), 3) == 1
    score = scorer(spark, train(spark, docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), ~held))
    return docs.select("doc_id", held.alias("held_out"), score(F.col("text")).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))

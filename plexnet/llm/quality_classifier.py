"""Quality by compression (operator 7).

Two zstandard dictionaries are built, one from good and one from bad labelled
texts. A text is compressed with both, in blocks small enough that the
dictionary and not the text itself explains most of a block. The difference
of the two compressed sizes, divided by the text's size, goes through a
logistic curve that is fitted on labelled texts the dictionaries have not
seen; the outcome is the probability that the text is good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexnet.llm.common import crc_mod, materialize, read_table
from plexnet.shipping import ensure_importable

#: Expected texts drawn per class for its dictionary, and in all for the curve.
MAX_DICTIONARY_TEXTS, MAX_CURVE_TEXTS = 2_000, 20_000
DICTIONARY_BYTES, BLOCK, LEVEL = 112 * 1024, 512, 3
THRESHOLD = 0.3


def blocks_of(text: str | None) -> list[bytes]:
    """The whole text in UTF-8, cut into blocks; none for null or empty text."""
    raw = (text or "").encode()
    return [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]


def build_dictionary(texts: Iterator[str]) -> bytes:
    """A trained dictionary; with too little text to train on, the text itself
    serves as a raw dictionary (empty without any text)."""
    import zstandard as zstd
    samples = [b for t in texts for b in blocks_of(t)]
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class Differ:
    """Normalised difference of the compressed sizes, bad less good, per text."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as zstd
        self.compress = []
        for d in (bad, good):
            zd = zstd.ZstdCompressionDict(d) if len(d) >= 8 else None
            if zd is not None:
                zd.precompute_compress(level=LEVEL)
            self.compress.append(zstd.ZstdCompressor(level=LEVEL, dict_data=zd, write_content_size=False,
                                                     write_dict_id=False).compress)

    def __call__(self, text: str | None) -> float:
        blocks = blocks_of(text)
        bad, good = (sum(len(c(b)) for b in blocks) for c in self.compress)
        return (bad - good) / max(1, sum(map(len, blocks)))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y (0/1) on x by Newton steps, slope and offset,
    with a weak ridge that keeps separable classes finite."""
    if not len(x) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return 0.0, float(np.log(rate / (1 - rate)))
    scale = x.std() or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    w, ridge = np.zeros(2), np.array([0.05, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def differ_column(spark: SparkSession, good: bytes, bad: bytes):
    """A column function text -> difference; the dictionaries are DICTIONARY_BYTES each."""
    ensure_importable(spark)
    shared = spark.sparkContext.broadcast((good, bad))

    @F.pandas_udf("double")
    def difference(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        differ = Differ(*shared.value)
        for s in texts:
            yield pd.Series([differ(t) for t in s], dtype="float64")
    return difference


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> tuple:
    """(good dictionary, bad dictionary, slope, offset) from labelled texts
    whose doc_id satisfies ``learn``. Half of them (crc32 of the id even) feed
    the dictionaries, the rest the curve. Null ids and labels teach nothing;
    of repeated labels of an id the lowest counts."""
    ensure_importable(spark)
    learn = F.lit(True) if learn is None else learn
    lab = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & learn).groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    lab = lab.select("doc_id", (F.col("quality") > 0).alias("good"), (crc_mod(F.col("doc_id"), 2) == 0).alias("seen"))
    lab = materialize(spark, lab, "quality-labels")
    sizes = {(r.good, r.seen): r["count"] for r in lab.groupBy("good", "seen").count().collect()}
    curve_size = sizes.get((True, False), 0) + sizes.get((False, False), 0)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("seen") & F.col("good"), MAX_DICTIONARY_TEXTS / max(1, sizes.get((True, True), 0))).when(
        F.col("seen"), MAX_DICTIONARY_TEXTS / max(1, sizes.get((False, True), 0))).otherwise(
        MAX_CURVE_TEXTS / max(1, curve_size))
    chosen = F.broadcast(lab.where(draw < rate))  # some 2 * MAX_DICTIONARY_TEXTS + MAX_CURVE_TEXTS ids, whatever the data
    sample = materialize(spark, docs.select("doc_id", "text").join(chosen, "doc_id"), "quality-sample")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"good": [bool(pdf["good"].iloc[0])], "d": [build_dictionary(pdf["text"])]})

    built = sample.where("seen").groupBy("good").applyInPandas(build, "good boolean, d binary")
    dicts = {r.good: bytes(r.d) for r in built.collect()}
    good, bad = dicts.get(True, b""), dicts.get(False, b"")
    diff = differ_column(spark, good, bad)
    pairs = sample.where("NOT seen").select(diff(F.col("text")).alias("x"), "good").toPandas()
    slope, offset = fit_curve(pairs["x"].to_numpy(float), pairs["good"].to_numpy(float))
    return good, bad, slope, offset


def score(spark: SparkSession, model: tuple) -> Column:
    """Probability of good quality as a column over ``text``. Null and
    empty texts get the curve's value at 0; ties and repeated rows score alike."""
    good, bad, slope, offset = model
    z = differ_column(spark, good, bad)(F.col("text")) * F.lit(slope) + F.lit(offset)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), -z))))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learns from rows whose crc32 remainder by 5 is not 0,
    scores the whole ``documents`` table."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = train(spark, docs, labels, ~held)
    return docs.select("doc_id", held.alias("held_out"), score(spark, model).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))

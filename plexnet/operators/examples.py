"""Operators on the examples table: counts, width, checks, split, sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexnet.functions.random import md5_bits, mix_uniform, np_mix_uniform
from plexnet.shipping import ensure_importable
from plexnet.sources.tables import split_column

# Fixed value: online ("olGD") draws use the seed epoch + 10, as in the reference.
ONLINE_SEED_OFFSET = 10


def cache_examples(df: DataFrame, batch_seed: int | None = None, max_partitions: int | None = None) -> DataFrame:
    """Persist only the columns the passes read; spills to disk instead of
    failing, and lost blocks are recomputed from the Parquet lineage. With
    ``batch_seed`` the per-row key of the mini-batch draws is hashed once
    here, so epochs draw their batches with integer arithmetic only. The
    input's own partitions stay; ``max_partitions`` merges them without a
    shuffle. Each task of a pass emits one partial sum per weight, so fewer
    tasks shuffle less, but a lost partition is longer to recompute."""
    out = df.select("id", "features", "label", "split")
    if max_partitions is not None and not df.isStreaming:
        out = out.coalesce(int(max_partitions))
    if batch_seed is not None:
        out = out.withColumn("bkey", batch_key(int(batch_seed)))
    return out.persist(StorageLevel.MEMORY_AND_DISK)


def batch_key(seed: int) -> Column:
    """48-bit row key of the mini-batch draws: md5 of (id, seed)."""
    return md5_bits(F.col("id"), F.lit(int(seed)))


def split_stats(df: DataFrame, outputs: int) -> DataFrame:
    """Per split in one job: rows, widths and the bad-row counts of
    ``validate_examples`` (the training loop's only setup scan)."""
    return validate_examples(df, outputs, by="split")


def count_examples(df: DataFrame) -> DataFrame:
    """Rows per split in one aggregate."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def feature_width(df: DataFrame) -> DataFrame:
    """min and max feature width over all splits (one aggregate)."""
    return df.agg(F.min(F.size("features")).alias("min_width"),
                  F.max(F.size("features")).alias("max_width"),
                  F.count(F.lit(1)).alias("n"))


def feature_width_value(df: DataFrame) -> int:
    r = feature_width(df).first()
    if r["n"] == 0:
        raise ValueError("no examples")
    if r["min_width"] != r["max_width"]:
        raise ValueError(f"ragged features: widths from {r['min_width']} to {r['max_width']}")
    return int(r["max_width"])


def validate_examples(df: DataFrame, outputs: int, by: str | None = None) -> DataFrame:
    """Bad-row counts in one aggregate: null or empty features, null/NaN
    values, label outside the classes, non-integer class labels, NaN labels,
    and the width range (ragged when min != max)."""
    feats = F.col("features")
    lab = F.col("label")
    has_bad_value = F.exists(feats, lambda x: x.isNull() | F.isnan(x))
    if outputs > 1:
        out_of_range = (lab < 0) | (lab >= outputs)
    else:
        out_of_range = (lab != 0.0) & (lab != 1.0)
    non_int = lab != F.floor(lab)
    grouped = df.groupBy(by) if by else df
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(feats.isNull() | (F.size(feats) == 0)).alias("null_features"),
        F.count_if(feats.isNotNull() & has_bad_value).alias("bad_values"),
        F.count_if(lab.isNull() | F.isnan(lab)).alias("bad_labels"),
        F.count_if(lab.isNotNull() & ~F.isnan(lab) & out_of_range).alias("label_out_of_range"),
        F.count_if(lab.isNotNull() & ~F.isnan(lab) & non_int).alias("label_not_integer"),
        F.min(F.size(feats)).alias("min_width"),
        F.max(F.size(feats)).alias("max_width"))


def check_examples(df: DataFrame, outputs: int) -> int:
    """Raise on any bad row; return the feature width."""
    r = validate_examples(df, outputs).first().asDict()
    problems = {k: v for k, v in r.items()
                if k not in ("n", "min_width", "max_width") and v}
    if r["n"] == 0:
        raise ValueError("no examples")
    if r["min_width"] != r["max_width"]:
        problems["ragged"] = (r["min_width"], r["max_width"])
    if problems:
        raise ValueError(f"bad examples: {problems}")
    return int(r["max_width"])


def split_examples(df: DataFrame, val_fraction: float = 0.2, seed=None) -> DataFrame:
    """Deterministic train/val split by md5 of the id (independent of the
    partition layout, unlike randomSplit)."""
    return df.withColumn("split", split_column(F.col("id"), val_fraction, seed))


def batch_fraction(n_train: int, size: int) -> float:
    return min(1.0, float(size) / float(n_train)) if n_train > 0 else 0.0


def in_batch(epoch: int, fraction: float, seed: int, key: Column | str | None = None) -> Column:
    """Bernoulli draw of the mini-batch of one epoch, per row: the row key
    (``bkey`` of cached examples, else md5 of (id, seed)) mixed with the epoch."""
    k = key if key is not None else batch_key(seed)
    return mix_uniform(k, seed, epoch) < F.lit(float(fraction))


def minibatch(df: DataFrame, epoch: int, n_train: int, size: int = 512, seed: int = 2332) -> DataFrame:
    """Train rows drawn for the epoch's gradient (about ``size`` rows)."""
    frac = batch_fraction(n_train, size)
    return df.where((F.col("split") == "train") & in_batch(epoch, frac, seed))


def online_pick(df: DataFrame, epoch: int, seed: int = 2332, key: Column | str | None = None) -> DataFrame:
    """The one train example of an online epoch: the row with the smallest
    draw (a global min_by, no sort)."""
    k = key if key is not None else batch_key(seed)
    u = mix_uniform(k, seed, int(epoch) + ONLINE_SEED_OFFSET)
    return (df.where(F.col("split") == "train")
            .agg(F.min_by(F.col("id"), F.struct(u, F.col("id"))).alias("id")))


def online_picks(df: DataFrame, epochs: range, seed: int = 2332, key: str = "bkey") -> DataFrame:
    """(epoch, id): the train example of every online epoch, as ``online_pick``
    finds it, in one scan. Each task keeps the smallest draw of each epoch;
    these meet in one min per epoch."""
    many = [int(e) for e in epochs]

    def run(batches):
        best_u, best_id = np.full(len(many), np.inf), np.zeros(len(many), np.int64)
        for b in batches:
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k, e in enumerate(many if len(ids) else []):
                u = np_mix_uniform(keys, seed, e + ONLINE_SEED_OFFSET)
                low = u.min()
                if low <= best_u[k]:
                    first = int(ids[u == low].min())
                    best_id[k] = first if low < best_u[k] else min(first, best_id[k])
                    best_u[k] = low
        met = np.isfinite(best_u)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(many, np.int32)[met], pa.int32()), pa.array(best_u[met]), pa.array(best_id[met])], ["epoch", "u", "id"])
    ensure_importable(df.sparkSession)
    found = df.where(F.col("split") == "train").select(F.col("id").cast("bigint"), key).mapInArrow(run, "epoch int, u double, id bigint")
    return found.groupBy("epoch").agg(F.min(F.struct("u", "id")).alias("m")).select("epoch", F.col("m.id").alias("id"))


def online_example(df: DataFrame, epoch: int, seed: int = 2332) -> DataFrame:
    """The picked example itself (one row)."""
    pick = online_pick(df, epoch, seed)
    return df.join(F.broadcast(pick), "id")   # one-row side

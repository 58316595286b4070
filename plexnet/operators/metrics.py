"""Predictions and metrics of scored rows.

Every function takes the output of ``passes.score``; those that need the true
label take scores made with ``keep=("label",)``, so labels travel with the
scores and no join is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexnet.functions import activations as A
from plexnet.operators import params as P


def predict(scores: DataFrame, multi: bool) -> DataFrame:
    """bin: p >= 0.5 -> 1; multi: first index of the maximum."""
    if multi:
        pred = (F.array_position("p", F.array_max("p")) - 1).cast("double")
    else:
        pred = F.when(F.element_at("p", 1) >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))
    return scores.withColumn("pred", pred)


def log_loss(scores: DataFrame) -> DataFrame:
    """Binary cross entropy of the clipped probability, per model."""
    pc = A.clip_prob(F.element_at("p", 1))
    y = F.col("label")
    return scores.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(-(y * F.log(pc) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - pc))).alias("log_loss"))


def cross_entropy(scores: DataFrame) -> DataFrame:
    """-ln of the true class's probability, per model."""
    p = F.get(F.col("p"), F.col("label").cast("int"))
    return scores.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(-F.log(p)).alias("cross_entropy"))


def accuracy(scores: DataFrame, multi: bool) -> DataFrame:
    """Share of correct predictions, per model."""
    return predict(scores, multi).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))


def squared_error(scores: DataFrame) -> DataFrame:
    """Squared error, variation around the label mean and R2, per model."""
    y, p = F.col("label"), F.element_at("p", 1)
    agg = scores.groupBy("model_id").agg(
        F.sum((y - p) * (y - p)).alias("sqe"),
        (F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(F.lit(1))).alias("sst"))
    return agg.withColumn("r2", F.lit(1.0) - F.try_divide(F.col("sqe"), F.col("sst")))


def output_error(scores: DataFrame, multi: bool) -> DataFrame:
    """Error of the output units, column ``e``: p - y; with classes, p with 1
    taken off the true class."""
    if multi:
        e = F.transform("p", lambda x, i: x - (i == F.col("label").cast("int")).cast("double"))
    else:
        e = F.transform("p", lambda x: x - F.col("label"))
    return scores.withColumn("e", e)


def reg_cost(cost: DataFrame, params: DataFrame, models: DataFrame) -> DataFrame:
    """cost + lambda/2 * sum of squared weights without bias rows."""
    n = P.weight_norms(params).join(models.select("model_id", "lmbda"), "model_id")
    return cost.join(n, "model_id").withColumn(
        "reg_cost", F.col("cost") + F.col("lmbda") / 2.0 * F.col("sq_weights"))

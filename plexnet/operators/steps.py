"""Optimiser steps as expressions on the parameter table.

Inputs are ``params`` (model_id, layer, row, col, theta, velocity, gacc) and
the output of a pass (gradient sums plus layer -1 scalar rows). Per-layer
norms are two small aggregates joined back with a broadcast whose size is
bounded by (models x layers) rows. Everything is parameter sized.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexnet.operators.kernel import S_BATCH_N, S_TRAIN_N
from plexnet.operators.params import KEYS

# ---------------------------------------------------------------------------
# Fixed values of the optimiser
#   gradient clip threshold (L1 matrix norm, max abs column sum) ... 1.0
#   Hessian-product step epsilon ................................. 1e-4
#   perturbation epsilon ......................................... 1e-4
#   momentum schedule  mu = min(1 - 2^(-1 - log2(epoch/itert + 1)), maxmu)
#   Nesterov schedule  mu = min(1 - 3/(epoch + 5), maxmu)
# ---------------------------------------------------------------------------
CLIP_THRESHOLD = 1.0
HESSIAN_EPS = 1e-4
PERTURB_EPS = 1e-4


def momentum_schedule(epoch: Column, itert: Column, maxmu: Column) -> Column:
    e = F.lit(-1.0) - F.log2(epoch.cast("double") / itert + 1.0)
    return F.least(F.lit(1.0) - F.pow(F.lit(2.0), e), maxmu)


def nesterov_schedule(epoch: Column, maxmu: Column) -> Column:
    return F.least(F.lit(1.0) - F.lit(3.0) / (epoch.cast("double") + 5.0), maxmu)


def momentum_value(epoch: int, itert: float, maxmu: float) -> float:
    return min(1.0 - 2.0 ** (-1.0 - math.log2(epoch / itert + 1.0)), maxmu)


def batch_counts(sums: DataFrame) -> DataFrame:
    """(model_id, m, n_train): mini-batch events and train rows of a pass."""
    sc = sums.where(F.col("layer") == -1)
    return sc.groupBy("model_id").agg(
        F.sum(F.when(F.col("row") == S_BATCH_N, F.col("value"))).alias("m"),
        F.sum(F.when(F.col("row") == S_TRAIN_N, F.col("value"))).alias("n_train"))


def mean_gradient(sums: DataFrame, params: DataFrame, models: DataFrame,
                  add_velocity: bool = False) -> DataFrame:
    """g = sum / m + lambda * theta on weight rows (bias rows undecayed).
    ``add_velocity`` is the reference's unused variant sum / m + v + lambda*theta.
    m = 0 (empty batch) gives g = NULL: no update follows from it."""
    gs = sums.where(F.col("layer") >= 0).select(*KEYS, F.col("value").alias("gsum"))
    cnt = batch_counts(sums)
    cfg = models.select("model_id", "lmbda").join(cnt, "model_id", "left")
    j = params.join(gs, KEYS, "left").join(cfg, "model_id")
    base = F.when(F.col("m") > 0, F.coalesce(F.col("gsum"), F.lit(0.0)) / F.col("m"))
    if add_velocity:
        base = base + F.col("velocity")
    g = base + F.when(F.col("row") > 0, F.col("lmbda") * F.col("theta")).otherwise(F.lit(0.0))
    return j.select(*KEYS, "theta", "velocity", "gacc", g.alias("g"))


def layer_norms(grads: DataFrame, g: str = "g", acc: str | None = None) -> DataFrame:
    """(model_id, layer, l1, l2[, acc_norm]): max absolute column sum and
    Frobenius norm of g, and the Frobenius norm of the accumulated column."""
    per_col = [F.sum(F.abs(F.col(g))).alias("colsum"), F.sum(F.col(g) * F.col(g)).alias("sq")]
    if acc:
        per_col.append(F.sum(F.col(acc) * F.col(acc)).alias("asq"))
    c = grads.groupBy("model_id", "layer", "col").agg(*per_col)
    outs = [F.max("colsum").alias("l1"), F.sqrt(F.sum("sq")).alias("l2")]
    if acc:
        outs.append(F.sqrt(F.sum("asq")).alias("acc_norm"))
    return c.groupBy("model_id", "layer").agg(*outs)


def l1_norm(grads: DataFrame, g: str = "g") -> DataFrame:
    return layer_norms(grads, g).select("model_id", "layer", "l1")


def _clip(grads: DataFrame, norm_col: str, g: str) -> DataFrame:
    norms = layer_norms(grads, g).select("model_id", "layer", norm_col)
    j = grads.join(norms, ["model_id", "layer"])
    gc = F.when(F.col(norm_col) > CLIP_THRESHOLD, F.col(g) * CLIP_THRESHOLD / F.col(norm_col)) \
        .otherwise(F.col(g))
    return j.withColumn("gc", gc).drop(norm_col)


def clip_l1(grads: DataFrame, g: str = "g") -> DataFrame:
    """Divide a layer's gradient by its L1 matrix norm when that is above 1."""
    return _clip(grads, "l1", g)


def clip_l2(grads: DataFrame, g: str = "g") -> DataFrame:
    """Vector L2 clip of a layer's gradient (the reference's unused variant)."""
    return _clip(grads, "l2", g)


def accumulate_gradients(grads: DataFrame) -> DataFrame:
    """gacc += g (raw, unclipped gradients; not their squares)."""
    return grads.withColumn("gacc", F.col("gacc") + F.coalesce(F.col("g"), F.lit(0.0)))


def adaptive_rate(grads: DataFrame, models: DataFrame) -> DataFrame:
    """(model_id, layer, ada_rate) = rate / ||gacc||_F per layer; NULL when the
    norm is 0 (the layer is then left unchanged instead of becoming NaN)."""
    c = grads.groupBy("model_id", "layer").agg(F.sqrt(F.sum(F.col("gacc") * F.col("gacc"))).alias("nrm"))
    c = c.join(models.select("model_id", "rate"), "model_id")
    return c.select("model_id", "layer",
                    F.when(F.col("nrm") > 0, F.col("rate") / F.col("nrm")).alias("ada_rate"))


def _update(j: DataFrame, optimizer: Column, eta: Column, mu: Column, n_train: Column) -> DataFrame:
    skip = F.col("g").isNull() | eta.isNull()
    decay = F.when(F.col("row") > 0, F.lit(1.0) - eta * F.col("lmbda") / n_train).otherwise(F.lit(1.0))
    theta_vanilla = F.col("theta") * decay - eta * F.col("gc")
    v_new = mu * F.col("velocity") - eta * F.col("gc")
    is_vanilla = optimizer == "vanilla"
    theta = F.when(skip, F.col("theta")).when(is_vanilla, theta_vanilla) \
        .otherwise(F.col("theta") + v_new)
    vel = F.when(skip | is_vanilla, F.col("velocity")).otherwise(v_new)
    return j.select(*KEYS, theta.alias("theta"), vel.alias("velocity"), "gacc")


def _prepared(grads: DataFrame, models: DataFrame) -> DataFrame:
    """grads (with g) -> accumulated, clipped, with per-layer rates attached."""
    acc = accumulate_gradients(grads)
    norms = layer_norms(acc, "g", "gacc")
    cfg = models.select("model_id", "rate", "lmbda", "optimizer", "learning_mod", "maxmu", "itert")
    j = (acc.join(norms, ["model_id", "layer"]).join(cfg, "model_id"))
    gc = F.when(F.col("l1") > CLIP_THRESHOLD, F.col("g") * CLIP_THRESHOLD / F.col("l1")) \
        .otherwise(F.col("g"))
    ada = F.when(F.col("acc_norm") > 0, F.col("rate") / F.col("acc_norm"))
    return j.withColumn("gc", gc).withColumn("ada_rate", ada)


def step_vanilla(grads: DataFrame, models: DataFrame, n_train) -> DataFrame:
    """Always the adaptive rate eta = rate/||gacc||: weights decay by
    (1 - eta*lambda/n) (bias rows do not), then theta -= eta * clipped g."""
    j = _prepared(grads, models)
    n = F.lit(float(n_train)) if not isinstance(n_train, Column) else n_train
    return _update(j, F.lit("vanilla"), F.col("ada_rate"), F.lit(0.0), n)


def step_momentum(grads: DataFrame, models: DataFrame, mu) -> DataFrame:
    """v = mu*v - eta*clipped g; theta += v. eta is the rate, or the adaptive
    rate when learning_mod = 'ADA'."""
    j = _prepared(grads, models)
    eta = F.when(F.col("learning_mod") == "ADA", F.col("ada_rate")).otherwise(F.col("rate"))
    mu_c = F.lit(float(mu)) if not isinstance(mu, Column) else mu
    return _update(j, F.lit("momentum"), eta, mu_c, F.lit(1.0))


def lookahead(params: DataFrame, mu) -> DataFrame:
    """theta + mu * v: where Nesterov evaluates the gradient."""
    mu_c = F.lit(float(mu)) if not isinstance(mu, Column) else mu
    return params.withColumn("theta", F.col("theta") + mu_c * F.col("velocity"))


def perturb(params: DataFrame, grads: DataFrame, eps: float = PERTURB_EPS, g: str = "g") -> DataFrame:
    """theta - eps * g (the step along d = -g used by the Hessian product)."""
    gg = grads.select(*KEYS, F.col(g).alias("_g"))
    j = params.join(gg, KEYS, "left")
    return j.select(*KEYS, (F.col("theta") - F.lit(float(eps)) * F.coalesce("_g", F.lit(0.0))).alias("theta"),
                    "velocity", "gacc")


def optimizer_step(params: DataFrame, sums: DataFrame, models: DataFrame, epoch: int,
                   scalars_wide: DataFrame | None = None) -> DataFrame:
    """One update of every model from one pass: mean gradient, accumulate,
    L1 clip, rate, then the model's own rule (vanilla / momentum /
    nesterov). Per-model scalars of the pass ride along as extra columns so
    one action returns both the new parameters and the epoch's sums."""
    grads = mean_gradient(sums, params, models)
    j = _prepared(grads, models)
    cnt = batch_counts(sums)
    j = j.join(cnt.select("model_id", "n_train"), "model_id", "left")
    mu = momentum_schedule(F.lit(int(epoch)), F.col("itert"), F.col("maxmu"))
    eta = (F.when((F.col("optimizer") == "vanilla") | (F.col("learning_mod") == "ADA"), F.col("ada_rate"))
           .otherwise(F.col("rate")))
    out = _update(j, F.col("optimizer"), eta, mu, F.col("n_train"))
    if scalars_wide is not None:
        out = out.join(scalars_wide, "model_id", "left")
    return out

"""Diagnostics: numerical gradient check and the Hessian-vector product.

``gradient_check`` is distributed over the weights: a small sample of
examples (its size is bounded by ``n_examples``) travels in a broadcast, and
each task checks the weights of its partition of the parameter table by
central differences. It compares per weight instead of the difference of
two sums (opposite errors would cancel there).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexnet.operators import kernel as K
from plexnet.operators.params import KEYS
from plexnet.operators.passes import gradient_sums, specs_from_frames, stored_sums
from plexnet.operators.steps import HESSIAN_EPS, mean_gradient, perturb
from plexnet.shipping import ensure_importable

# ---------------------------------------------------------------------------
# Fixed values of the reference gradient check
#   network [F, 4, 4, 1], sigmoid, seed 754, init deeplearning / fan_in,
#   lambda 1e-10, epsilon 1e-3 (written 10.e-4)
# ---------------------------------------------------------------------------
CHECK_HIDDEN = "4,4"
CHECK_SEED = 754
CHECK_LAMBDA = 1e-10
CHECK_EPS = 1e-3

# Gradients below REL_NOISE / eps are compared absolutely: central
# differences carry rounding noise of about 1e-16 * cost / eps, so the
# relative error of two near-zero numbers says nothing.
REL_NOISE = 1e-10

CHECK_SCHEMA = ("model_id string, layer int, row int, col int, analytic double, numeric double, "
                "rel_error double")


_CHECK_ARROW = pa.schema([("model_id", pa.string()), ("layer", pa.int32()), ("row", pa.int32()),
                          ("col", pa.int32()), ("analytic", pa.float64()), ("numeric", pa.float64()),
                          ("rel_error", pa.float64())])


def _cost(spec: K.NetSpec, x, y, weights, lam) -> float:
    _, _, z = K.forward(spec, x, weights)
    p = K.output_probs(spec, z)
    c = K.row_costs(spec, z, p, y).mean()
    return float(c + lam / 2.0 * sum((w[1:] ** 2).sum() for w in weights))


def _check_kernel(batches, spec_bc, sample_bc, lam, eps):
    specs = {s.model_id: s for s in spec_bc.value}
    x, y = sample_bc.value
    analytic = {}
    for rb in batches:
        pdf = rb.to_pandas()
        out = []
        for r in pdf.itertuples(index=False):
            spec = specs[r.model_id]
            if r.model_id not in analytic:
                zs, acts, z = K.forward(spec, x)
                e = K.output_error(spec, K.output_probs(spec, z), y)
                g = K.backprop(spec, zs, acts, e)
                analytic[r.model_id] = [gl / len(y) + np.vstack([np.zeros((1, w.shape[1])), lam * w[1:]])
                                        for gl, w in zip(g, spec.weights)]
            plus = [w.copy() for w in spec.weights]
            minus = [w.copy() for w in spec.weights]
            plus[r.layer][r.row, r.col] += eps
            minus[r.layer][r.row, r.col] -= eps
            num = (_cost(spec, x, y, plus, lam) - _cost(spec, x, y, minus, lam)) / (2 * eps)
            ana = float(analytic[r.model_id][r.layer][r.row, r.col])
            den = max(abs(ana) + abs(num), REL_NOISE / eps)
            out.append((r.model_id, r.layer, r.row, r.col, ana, num, abs(ana - num) / den))
        if out:
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(out, columns=_CHECK_ARROW.names), schema=_CHECK_ARROW, preserve_index=False)


def gradient_check(examples: DataFrame, params: DataFrame, models: DataFrame, n_examples: int = 1,
                   lam: float = CHECK_LAMBDA, eps: float = CHECK_EPS) -> DataFrame:
    """One row per weight: analytic gradient (backprop + lambda*theta),
    central-difference gradient of the regularised cost, relative error.
    The sample is the ``n_examples`` rows with the smallest ids."""
    spark = examples.sparkSession
    ensure_importable(spark)
    sample = examples.orderBy("id").limit(int(n_examples)).select("features", "label").collect()
    x = np.array([r["features"] for r in sample], dtype=np.float64)
    y = np.array([r["label"] for r in sample], dtype=np.float64)
    specs = specs_from_frames(params, models)
    spec_bc = spark.sparkContext.broadcast(specs)
    sample_bc = spark.sparkContext.broadcast((x, y))

    def fn(batches):
        return _check_kernel(batches, spec_bc, sample_bc, lam, eps)

    return params.select(*KEYS).mapInArrow(fn, CHECK_SCHEMA)


def hessian_product(examples: DataFrame, params: DataFrame, models: DataFrame,
                    eps: float = HESSIAN_EPS) -> DataFrame:
    """Hd = (g(theta + eps d) - g(theta)) / eps + lambda g with d = -g: two
    gradient passes and a join on the weight keys."""
    g0 = mean_gradient(stored_sums(gradient_sums(examples, params, models)), params, models)
    p1 = perturb(params, g0, eps)
    g1 = mean_gradient(stored_sums(gradient_sums(examples, p1, models)), p1, models)
    lam = models.select("model_id", "lmbda")
    j = (g0.select(*KEYS, F.col("g").alias("g0")).join(g1.select(*KEYS, F.col("g").alias("g1")), KEYS)
         .join(lam, "model_id"))
    return j.select(*KEYS, ((F.col("g1") - F.col("g0")) / F.lit(float(eps))
                            + F.col("lmbda") * F.col("g0")).alias("hd"))

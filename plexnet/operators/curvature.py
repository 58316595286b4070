"""Exact curvature and a gradient check over whole tables.

``hessian_vector`` differentiates the backward pass once more in a given
direction (forward-over-reverse): every quantity of the pass gets a twin, its
derivative along the direction, so one scan gives H v for any v, without a
step size.

``check_gradients`` compares every weight's gradient with a central difference
of the summed cost over all rows. Changing one weight of layer l into unit c
changes only that unit's pre-activation, by epsilon times the input. So one
batch product per unit gives the costs for all weights into it, and the next
layers are computed for these variants together; cost sums per weight are
merged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexnet.functions.activations import get_activation
from plexnet.operators import kernel as K
from plexnet.operators.diagnose import CHECK_EPS, REL_NOISE
from plexnet.operators.params import KEYS
from plexnet.operators.passes import _broadcast, _union, _width, activations_of, group_specs, merged_sums, specs_from_frames

#: Values of perturbed activations that a task holds at once.
HELD_VALUES = 4_000_000


def _keyed(spec: K.NetSpec, values: list[np.ndarray], scalars: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Rows (model_id, layer, row, col, ...) of flat per-weight values, and the event count as layer -1."""
    layer, row, col = spec.index_arrays()
    extra = [np.concatenate([[scalars[i]], v]) for i, v in enumerate(values)]
    return pa.RecordBatch.from_arrays(
        [pa.array([spec.model_id] * (len(layer) + 1), pa.string()), *(pa.array(np.concatenate([[a], b]).astype(np.int32)) for a, b in ((-1, layer), (0, row), (0, col))),
         *(pa.array(v) for v in extra)], ["model_id", "layer", "row", "col", *names])


def _flat(gs: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([g.ravel() for g in gs])


def _hv_batch(spec: K.NetSpec, x: np.ndarray, y: np.ndarray, acts: dict) -> list[np.ndarray]:
    """Derivative along ``spec.lookahead`` (the direction) of the gradient sums of a batch."""
    f, df, ddf = acts[spec.activation]
    ws, vs = spec.weights, spec.lookahead
    a, ra, zs, rzs = [x], [np.zeros_like(x)], [], []
    for w, v in zip(ws, vs, strict=True):
        z, rz = a[-1] @ w[1:] + w[0], ra[-1] @ w[1:] + a[-1] @ v[1:] + v[0]
        zs.append(z)
        rzs.append(rz)
        a.append(f(z))
        ra.append(df(z) * rz)
    p = K.output_probs(spec, zs[-1])
    rp = p * (rzs[-1] - (p * rzs[-1]).sum(1, keepdims=True)) if spec.multi else p * (1 - p) * rzs[-1]
    e = K.output_error(spec, p, y)
    re = rp
    if spec.loss == "squared" and not spec.multi:
        re = rp * p * (1 - p) + (p - y[:, None]) * (1 - 2 * p) * rp
    out = [None] * len(ws)
    for k in range(len(ws) - 1, -1, -1):
        g = np.empty_like(ws[k])
        g[0], g[1:] = re.sum(0), ra[k].T @ e + a[k].T @ re
        out[k] = g
        if k:
            back = e @ ws[k][1:].T
            re = (re @ ws[k][1:].T + e @ vs[k][1:].T) * df(zs[k - 1]) + back * ddf(zs[k - 1]) * rzs[k - 1]
            e = back * df(zs[k - 1])
    return out


def hessian_vector(examples: DataFrame, params: DataFrame, models: DataFrame, direction: DataFrame, value: str = "value") -> DataFrame:
    """(model_id, layer, row, col, hv): the Hessian of the mean regularised cost
    of all ``examples``, times ``direction(model_id, layer, row, col, <value>)``
    (absent weights have direction 0), in one scan. The direction is shipped
    with the weights and counts for the broadcast bound. Activations need a
    second derivative (``register_activation(..., dd_numpy_fn=...)``). A table
    without rows gives no rows."""
    along = params.select(*KEYS, "theta").join(direction.select(*KEYS, F.col(value).alias("velocity")), KEYS, "left").fillna(0.0, ["velocity"])
    specs = specs_from_frames(along, models, lookahead_mu={r["model_id"]: 1.0 for r in models.select("model_id").collect()})
    for s in specs:
        s.lookahead = [both - w for both, w in zip(s.lookahead, s.weights, strict=True)]
        if get_activation(s.activation).dd_numpy is None:
            raise ValueError(f"activation {s.activation!r} has no second derivative")
    sums = _union([_hv_sums(examples, g) for g in group_specs(specs)])
    n = sums.where("layer = -1").select("model_id", F.col("value").alias("_n"))
    out = sums.where("layer >= 0").join(n, "model_id").join(models.select("model_id", "lmbda"), "model_id").join(along.select(*KEYS, "velocity"), KEYS)
    return out.select(*KEYS, (F.col("value") / F.col("_n") + F.when(F.col("row") > 0, F.col("lmbda") * F.col("velocity")).otherwise(0.0)).alias("hv"))


def _hv_sums(examples: DataFrame, specs: list[K.NetSpec]) -> DataFrame:
    width, bc = _width(examples, specs), _broadcast(examples.sparkSession, specs)
    acts = {s.activation: (*activations_of([s])[s.activation], get_activation(s.activation).dd_numpy) for s in specs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = None, 0
        for b in K.merged(batches, max(sum(w.shape[1] for w in s.weights) for s in bc.value)):
            x, y = K.features_matrix(b, width), b.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
            parts = []
            for s in bc.value:
                K.check_labels(s, y)
                parts.append(_flat(_hv_batch(s, x, y, acts)))
            held = parts if held is None else [a + b for a, b in zip(held, parts, strict=True)]
            n += len(y)
        for s, v in zip(bc.value, held or [], strict=False):
            yield _keyed(s, [v], np.array([float(n)]), ["value"])
    return merged_sums(examples.select("features", "label").mapInArrow(run, K.SUMS_SCHEMA), [*KEYS], ["value"])


def _cost_sums(spec: K.NetSpec, z: np.ndarray, layer: int, y: np.ndarray, acts: dict) -> np.ndarray:
    """Summed cost for each of the variants z[:, variant, :] of a layer's pre-activations."""
    n, many, _ = z.shape
    flat, labels = z.reshape(n * many, -1), np.repeat(y, many)
    for w in spec.weights[layer + 1:]:
        flat = acts[spec.activation][0](flat) @ w[1:] + w[0]
    return K.row_costs(spec, flat, K.output_probs(spec, flat), labels).reshape(n, many).sum(0)


def _perturbed(spec: K.NetSpec, x: np.ndarray, y: np.ndarray, eps: float, acts: dict) -> tuple[np.ndarray, np.ndarray]:
    """Summed costs with each weight raised and lowered by ``eps``, flat."""
    act = acts[spec.activation][0]
    plus, minus, a = [], [], x
    for layer, w in enumerate(spec.weights):
        inputs = np.hstack([np.ones((len(a), 1)), a])
        z = inputs @ w
        up, down = np.zeros(w.shape), np.zeros(w.shape)
        at_once = max(1, HELD_VALUES // max(1, len(a) * max(v.shape[1] for v in spec.weights)))
        for c in range(w.shape[1]):
            for lo in range(0, w.shape[0], at_once):
                step = eps * inputs[:, lo:lo + at_once]
                for sign, out in ((1, up), (-1, down)):
                    variants = np.repeat(z[:, None, :], step.shape[1], axis=1)
                    variants[:, :, c] += sign * step
                    out[lo:lo + at_once, c] = _cost_sums(spec, variants, layer, y, acts)
        plus.append(up)
        minus.append(down)
        a = act(z)
    return _flat(plus), _flat(minus)


def check_gradients(examples: DataFrame, params: DataFrame, models: DataFrame, eps: float = CHECK_EPS, rows_at_once: int = 2000) -> DataFrame:
    """One row per weight: (model_id, layer, row, col, analytic, numeric,
    rel_error) of the mean cost over all ``examples``, without its regularising
    part. A model's check costs as many forward passes as twice its weights.
    Gradients below the rounding noise of the difference are compared
    absolutely. A table without rows gives no rows."""
    specs = specs_from_frames(params, models)
    out = []
    for group in group_specs(specs):
        width, bc, acts = _width(examples, group), _broadcast(examples.sparkSession, group), activations_of(group)

        def run(batches, width=width, bc=bc, acts=acts):
            held, n = None, 0
            for b in batches:
                for at in range(0, len(b), rows_at_once):
                    part = b.slice(at, rows_at_once)
                    x, y = K.features_matrix(part, width), part.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
                    sums = []
                    for s in bc.value:
                        K.check_labels(s, y)
                        zs, a, z = K.forward(s, x, acts_of=acts)
                        g = K.backprop(s, zs, a, K.output_error(s, K.output_probs(s, z), y), acts_of=acts)
                        sums.append([_flat(g), *_perturbed(s, x, y, eps, acts)])
                    held = sums if held is None else [[p + q for p, q in zip(u, v, strict=True)] for u, v in zip(held, sums, strict=True)]
                    n += len(y)
            for s, v in zip(bc.value, held or [], strict=False):
                yield _keyed(s, v, np.array([float(n), 0.0, 0.0]), ["g", "plus", "minus"])
        schema = "model_id string, layer int, row int, col int, g double, plus double, minus double"
        out.append(merged_sums(examples.select("features", "label").mapInArrow(run, schema), [*KEYS], ["g", "plus", "minus"]))
    sums = _union(out)
    n = sums.where("layer = -1").select("model_id", F.col("g").alias("_n"))
    both = sums.where("layer >= 0").join(n, "model_id").select(
        *KEYS, (F.col("g") / F.col("_n")).alias("analytic"), ((F.col("plus") - F.col("minus")) / (2 * eps) / F.col("_n")).alias("numeric"))
    gap = F.abs(F.col("analytic") - F.col("numeric"))
    return both.withColumn("rel_error", gap / F.greatest(F.abs("analytic") + F.abs("numeric"), F.lit(REL_NOISE / eps)))

"""Passes over wide sparse examples (compressed rows).

Batches stay compressed from the source to the kernel. The first layer is a
sparse-by-dense product: the weight rows of the entries are gathered, scaled
and summed per example. Its gradient has rows only for features that occur, so
a task sends sums of *touched* weight rows; a row that no example touches
costs nothing. Everything above the first layer is the dense kernel.

A weight row travels as up to PART sums side by side, (model_id, layer, row,
part, v0, v1, ...), merged by one built-in ``sum`` per column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from plexnet.operators import kernel as K
from plexnet.operators.passes import _broadcast, _union, activations_of, group_specs, specs_from_frames

#: Sums that stand side by side in one row.
PART = 64
#: Products held at once in a task (entries times units).
HELD_PRODUCTS = 4_000_000
#: Touched rows times units that a task holds unmerged.
HELD_SUMS = 8_000_000


@dataclass
class Rows:
    """A batch of compressed rows: row i has the entries ptr[i] to ptr[i+1]."""

    ptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def cut(self, lo: int, hi: int) -> "Rows":
        a, b = self.ptr[lo], self.ptr[hi]
        return Rows(self.ptr[lo:hi + 1] - a, self.indices[a:b], self.values[a:b])

    def pieces(self, units: int) -> Iterator["Rows"]:
        """Consecutive rows of at most HELD_PRODUCTS products (one row at least)."""
        lo, most = 0, max(1, HELD_PRODUCTS // max(1, units))
        while lo < len(self):
            hi = max(lo + 1, int(np.searchsorted(self.ptr, self.ptr[lo] + most, "right")) - 1)
            yield self.cut(lo, hi)
            lo = hi

    @property
    def of(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self)), np.diff(self.ptr))


def rows_of(batch: pa.RecordBatch, n_features: int) -> Rows:
    """The batch's columns ``indices`` and ``values``; null lists, lists of
    different lengths and indices out of range raise."""
    idx, val = batch.column("indices"), batch.column("values")
    if idx.null_count or val.null_count:
        raise ValueError("null sparse features; filter them first")
    ptr = np.concatenate([[0], np.cumsum(idx.value_lengths().to_numpy())]).astype(np.int64)
    flat, values = idx.flatten(), val.flatten()
    if not np.array_equal(idx.value_lengths().to_numpy(), val.value_lengths().to_numpy()) or flat.null_count or values.null_count:
        raise ValueError("indices and values of a sparse example do not pair up")
    flat = flat.to_numpy()
    if len(flat) and (flat.min() < 0 or flat.max() >= n_features):
        raise ValueError(f"feature {flat.max() if flat.max() >= n_features else flat.min()} is not one of 0..{n_features - 1}")
    return Rows(ptr, flat, values.to_numpy().astype(np.float64))


def times(x: Rows, w: np.ndarray) -> np.ndarray:
    """x . w for compressed rows and a dense matrix (features, units)."""
    out = np.zeros((len(x), w.shape[1]))
    at = 0
    for part in x.pieces(w.shape[1]):
        full = np.flatnonzero(np.diff(part.ptr))
        if len(full):
            out[at + full] = np.add.reduceat(part.values[:, None] * w[part.indices], part.ptr[full], axis=0)
        at += len(part)
    return out


def touched(x: Rows, e: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Transposed product x' . e as (features, sums) of the features that occur."""
    at = 0
    for part in x.pieces(e.shape[1]):
        order = np.argsort(part.indices, kind="stable")
        if len(order):
            found, first = np.unique(part.indices[order], return_index=True)
            yield found, np.add.reduceat(part.values[order, None] * e[at + part.of[order]], first, axis=0)
        at += len(part)


class _Touched:
    """Sums by feature, merged whenever HELD_SUMS are held."""

    def __init__(self, units: int):
        self.units, self.held, self.size = units, [], 0

    def add(self, parts) -> None:
        for found, sums in parts:
            self.held.append((found, sums))
            self.size += sums.size
            if self.size > HELD_SUMS:
                self.held = [self.total()]
                self.size = self.held[0][1].size

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros((0, self.units))
        rows = np.concatenate([r for r, _ in self.held])
        sums = np.concatenate([s for _, s in self.held])
        order = np.argsort(rows, kind="stable")
        found, first = np.unique(rows[order], return_index=True)
        return found, np.add.reduceat(sums[order], first, axis=0)


def forward(spec: K.NetSpec, x: Rows, acts_of: dict | None = None):
    """(pre-activations of hidden layers, their activations, output pre-activation)."""
    act, _ = K._functions(spec, acts_of)
    z = times(x, spec.weights[0][1:]) + spec.weights[0][0]
    zs, acts = [], []
    for w in spec.weights[1:]:
        zs.append(z)
        acts.append(act(z))
        z = acts[-1] @ w[1:] + w[0]
    return zs, acts, z


def _backprop(spec: K.NetSpec, x: Rows, zs, acts, e, grads: list, first: _Touched, acts_of: dict | None) -> None:
    """Adds gradient sums: ``grads`` of the dense rows, ``first`` of touched rows of layer 0."""
    _, d_act = K._functions(spec, acts_of)
    for layer in range(len(spec.weights) - 1, -1, -1):
        grads[layer][0] += e.sum(0)
        if layer == 0:
            first.add(touched(x, e))
            return
        grads[layer][1:] += acts[layer - 1].T @ e
        e = (e @ spec.weights[layer][1:].T) * d_act(zs[layer - 1])


def _width(spec: K.NetSpec) -> int:
    return min(PART, max(K.N_SCALARS, *(w.shape[1] for w in spec.weights)))


def _emit(spec: K.NetSpec, layer: int, rows: np.ndarray, sums: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    parts = -(-sums.shape[1] // width)
    padded = np.full((len(rows), parts * width), np.nan)
    padded[:, :sums.shape[1]] = sums
    flat = padded.reshape(-1, width)
    beyond = np.tile(np.arange(parts * width).reshape(parts, width) >= sums.shape[1], (len(rows), 1))
    n = len(flat)
    yield pa.RecordBatch.from_arrays(
        [pa.array([spec.model_id] * n, pa.string()), pa.array(np.full(n, layer, np.int32)), pa.array(np.repeat(rows, parts).astype(np.int32)),
         pa.array(np.tile(np.arange(parts, dtype=np.int32), len(rows))), *(pa.array(np.ascontiguousarray(flat[:, i]), mask=beyond[:, i]) for i in range(width))],
        ["model_id", "layer", "row", "part", *(f"v{i}" for i in range(width))])


def _sums_kernel(batches, specs, n_features: int, with_grads: bool, width: int, acts_of: dict):
    held = [([np.zeros((1 if layer == 0 else len(w), w.shape[1])) for layer, w in enumerate(s.weights)], _Touched(s.weights[0].shape[1]),
             np.zeros(K.N_SCALARS)) for s in specs]
    for b in batches:
        if not len(b):
            continue
        x = rows_of(b, n_features)
        y = b.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
        for spec, (grads, first, scalars) in zip(specs, held, strict=True):
            K.check_labels(spec, y)
            zs, acts, z_out = forward(spec, x, acts_of)
            p = K.output_probs(spec, z_out)
            cost = K.row_costs(spec, z_out, p, y).sum()
            for k, v in ((K.S_VAL_COST, cost), (K.S_VAL_N, len(y)), (K.S_VAL_CORRECT, (K.predictions(spec, p) == y).sum()),
                         (K.S_VAL_SUM_Y, y.sum()), (K.S_VAL_SUM_Y2, (y * y).sum()), (K.S_BATCH_N, len(y)), (K.S_BATCH_COST, cost),
                         (K.S_VAL_SQE, 0.0 if spec.multi else ((y - p[:, 0]) ** 2).sum())):
                scalars[k] += v
            if with_grads:
                _backprop(spec, x, zs, acts, K.output_error(spec, p, y), grads, first, acts_of)
    for spec, (grads, first, scalars) in zip(specs, held, strict=True):
        if not scalars[K.S_BATCH_N]:
            continue
        yield from _emit(spec, -1, np.arange(K.N_SCALARS), scalars[:, None], width)
        if with_grads:
            for layer, g in enumerate(grads):
                yield from _emit(spec, layer, np.arange(len(g)), g, width)
            rows, sums = first.total()
            for at in range(0, len(rows), 50_000):
                yield from _emit(spec, 0, rows[at:at + 50_000] + 1, sums[at:at + 50_000], width)


def _specs(params: DataFrame | None, models: DataFrame | None, specs, n_features: int) -> list[K.NetSpec]:
    specs = specs if specs is not None else specs_from_frames(params, models)
    for s in specs:
        if len(s.weights[0]) != n_features + 1:
            raise ValueError(f"model {s.model_id} takes {len(s.weights[0]) - 1} features, not {n_features}")
    return specs


def sums_pass(examples: DataFrame, specs: list[K.NetSpec], n_features: int, with_grads: bool = True) -> DataFrame:
    """(model_id, layer, row, part, v0, ...): sums over all ``examples`` (indices,
    values, label), in one scan for all models. Layer -1 holds the scalar sums
    named in ``kernel.SCALAR_NAMES``; a weight row of no example is absent."""
    groups = group_specs(specs)
    if len(groups) > 1:
        return _union([sums_pass(examples, g, n_features, with_grads) for g in groups])
    bc, width, acts = _broadcast(examples.sparkSession, specs), max(map(_width, specs)), activations_of(specs)
    cols = [f"v{i}" for i in range(width)]

    def run(batches):
        return _sums_kernel(batches, bc.value, n_features, with_grads, width, acts)
    schema = "model_id string, layer int, row int, part int, " + ", ".join(f"{c} double" for c in cols)
    key = ["model_id", "layer", "row", "part"]
    return examples.select("indices", "values", "label").mapInArrow(run, schema).groupBy(*key).sum(*cols).toDF(*key, *cols)


def gradient_sums(examples: DataFrame, params: DataFrame | None, models: DataFrame | None, n_features: int,
                  rows: Column | None = None, specs: list[K.NetSpec] | None = None) -> DataFrame:
    """Summed gradients (model_id, layer, row, col, value) of the touched weight
    rows and of all dense ones, with the scalar rows of layer -1; the form that
    the steps take. ``rows`` narrows the examples."""
    specs = _specs(params, models, specs, n_features)
    wide = sums_pass(examples.where(rows) if rows is not None else examples, specs, n_features)
    cols = [c for c in wide.columns if c.startswith("v")]
    each = wide.select("model_id", "layer", "row", "part", F.posexplode(F.array(*cols)).alias("at", "value")).where("value IS NOT NULL")
    return each.select("model_id", "layer", "row", (F.col("part") * len(cols) + F.col("at")).alias("col"), "value")


def evaluate(examples: DataFrame, params: DataFrame | None, models: DataFrame | None, n_features: int,
             specs: list[K.NetSpec] | None = None) -> DataFrame:
    """Count, mean cost, accuracy and squared errors per model, in one scan."""
    specs = _specs(params, models, specs, n_features)
    s = sums_pass(examples, specs, n_features, with_grads=False).where("layer = -1")
    s = s.groupBy("model_id").agg(*(F.sum(F.when(F.col("row") == i, F.col("v0"))).alias(c) for i, c in enumerate(K.SCALAR_NAMES)))
    n = F.col("val_n")
    return s.select("model_id", n.cast("bigint").alias("n"), (F.col("val_cost") / n).alias("cost"), (F.col("val_correct") / n).alias("accuracy"),
                    F.col("val_sqe").alias("sqe"), (F.col("val_sum_y2") - F.col("val_sum_y") * F.col("val_sum_y") / n).alias("sst"))


def score(examples: DataFrame, params: DataFrame | None, models: DataFrame | None, n_features: int,
          what: str = "p", specs: list[K.NetSpec] | None = None, keep: tuple[str, ...] = (), id_col: str = "id") -> DataFrame:
    """(id, model_id, p ARRAY<DOUBLE>, *keep) of every example and model;
    ``what="z1"`` gives the first layer's pre-activations (the linear layer)."""
    specs = _specs(params, models, specs, n_features)
    groups = group_specs(specs)
    if len(groups) > 1:
        return _union([score(examples, params, models, n_features, what, g, keep, id_col) for g in groups])
    bc, acts = _broadcast(examples.sparkSession, specs), activations_of(specs)
    src = examples.select("indices", "values", id_col, *keep)
    kept = src.schema

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            x = rows_of(b, n_features)
            for spec in bc.value:
                if what == "z1":
                    out = times(x, spec.weights[0][1:]) + spec.weights[0][0]
                else:
                    out = K.output_probs(spec, forward(spec, x, acts)[2])
                offsets = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(2), pa.array([spec.model_id] * len(b), pa.string()), pa.ListArray.from_arrays(offsets, pa.array(out.ravel())),
                     *(b.column(i) for i in range(3, b.num_columns))], [id_col, "model_id", "p", *keep])
    return src.mapInArrow(run, StructType([kept[id_col], StructField("model_id", StringType()), StructField("p", ArrayType(DoubleType())), *(kept[c] for c in keep)]))

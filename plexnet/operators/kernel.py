"""NumPy batch kernel of the distributed pass.

Runs inside ``mapInArrow`` tasks: one forward pass per Arrow batch and per
model (a matrix product per layer), backpropagation on the rows flagged as
mini-batch rows, and partial sums kept per task. Nothing here touches Spark;
Spark partitions the rows and merges the per-task sums with a built-in
aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from plexnet.functions import activations as A

# ---------------------------------------------------------------------------
# Fixed layout of the scalar sums (rows of layer -1 in the pass output)
# ---------------------------------------------------------------------------
S_TRAIN_COST, S_TRAIN_N, S_BATCH_N, S_VAL_COST, S_VAL_N, S_VAL_CORRECT, \
    S_VAL_SQE, S_VAL_SUM_Y, S_VAL_SUM_Y2, S_BATCH_COST = range(10)
N_SCALARS = 10
SCALAR_NAMES = ("train_cost", "train_n", "batch_n", "val_cost", "val_n", "val_correct",
                "val_sqe", "val_sum_y", "val_sum_y2", "batch_cost")

SUMS_SCHEMA = "model_id string, layer int, row int, col int, value double"

# Block layout: the flat gradient of a model (layers in order, row-major) in
# blocks of BLOCK values, one double column per value, so a plain
# sum-per-column aggregate merges the blocks (64x fewer shuffle rows than one
# row per weight). Block -1 holds the scalar sums in its first columns.
BLOCK = 64
BLOCK_COLS = [f"v{i}" for i in range(BLOCK)]
BLOCKS_SCHEMA = "model_id string, block int, " + ", ".join(f"{c} double" for c in BLOCK_COLS)


@dataclass
class NetSpec:
    """One network as shipped to the executors (parameter sized)."""
    model_id: str
    weights: list                 # layer l: array (n_in + 1, n_out), row 0 = bias
    activation: str = "sigmoid"
    multi: bool = False
    loss: str = "log"             # "log" (cross entropy) or "squared"
    lookahead: list | None = None  # Nesterov: weights at theta + mu * v for the gradient
    _index: tuple | None = field(default=None, repr=False)

    @property
    def n_outputs(self) -> int:
        return int(self.weights[-1].shape[1])

    def index_arrays(self):
        """(layer, row, col) of every weight in (layer, row, col) order."""
        if self._index is None:
            ls, rs, cs = [], [], []
            for l, w in enumerate(self.weights):
                r, c = np.indices(w.shape)
                ls.append(np.full(w.size, l, dtype=np.int32))
                rs.append(r.ravel().astype(np.int32))
                cs.append(c.ravel().astype(np.int32))
            self._index = (np.concatenate(ls), np.concatenate(rs), np.concatenate(cs))
        return self._index


def features_matrix(rb: pa.RecordBatch, n_features: int, col: str = "features") -> np.ndarray:
    arr = rb.column(col)
    n = rb.num_rows
    if arr.null_count:
        raise ValueError("null feature vector in a batch; run validate_examples first")
    flat = arr.flatten()
    if len(flat) != n * n_features:
        raise ValueError(f"ragged features: {len(flat)} values for {n} rows of width {n_features}")
    x = flat.to_numpy(zero_copy_only=False)
    if x.dtype != np.float64:
        x = x.astype(np.float64)
    return x.reshape(n, n_features)


def _bool(rb: pa.RecordBatch, name: str, n: int) -> np.ndarray:
    if name not in rb.schema.names:
        return np.zeros(n, dtype=bool)
    return rb.column(name).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


def check_labels(spec: NetSpec, y: np.ndarray) -> None:
    """Raise on labels that the loss cannot take: null or NaN, and for class
    probabilities anything but 0 .. outputs - 1 (0 and 1 with one output)."""
    if np.isnan(y).any():
        raise ValueError("null or NaN label; run validate_examples first")
    if spec.loss != "squared" or spec.multi:
        classes = spec.n_outputs if spec.multi else 2
        bad = (y < 0) | (y >= classes) | (y != np.floor(y))
        if bad.any():
            raise ValueError(f"label {y[bad][0]} is not one of the classes 0..{classes - 1} of model {spec.model_id}")


def _functions(spec: NetSpec, acts: dict | None) -> tuple:
    if acts is not None and spec.activation in acts:
        return acts[spec.activation]
    a = A.get_activation(spec.activation)
    return a.numpy, a.d_numpy


def forward(spec: NetSpec, x: np.ndarray, weights=None, acts_of: dict | None = None):
    """Return (pre-activations Z per hidden layer, activations A per layer
    including the input, output pre-activation z_out)."""
    act, _ = _functions(spec, acts_of)
    ws = weights if weights is not None else spec.weights
    acts, zs = [x], []
    a = x
    for w in ws[:-1]:
        z = a @ w[1:] + w[0]
        zs.append(z)
        a = act(z)
        acts.append(a)
    z_out = a @ ws[-1][1:] + ws[-1][0]
    return zs, acts, z_out


def output_probs(spec: NetSpec, z_out: np.ndarray) -> np.ndarray:
    return A.np_softmax(z_out) if spec.multi else A.np_sigmoid(z_out)


def row_costs(spec: NetSpec, z_out: np.ndarray, p: np.ndarray, y: np.ndarray) -> np.ndarray:
    if spec.multi:
        cls = y.astype(np.int64)
        return -A.np_log_softmax(z_out)[np.arange(len(y)), cls]
    p0 = p[:, 0]
    if spec.loss == "squared":
        return (y - p0) ** 2 / 2.0
    pc = A.np_clip_prob(p0)
    return -(y * np.log(pc) + (1.0 - y) * np.log(1.0 - pc))


def output_error(spec: NetSpec, p: np.ndarray, y: np.ndarray) -> np.ndarray:
    if spec.multi:
        e = p.copy()
        e[np.arange(len(y)), y.astype(np.int64)] -= 1.0
        return e
    e = p - y[:, None]
    if spec.loss == "squared":
        e = e * p * (1.0 - p)
    return e


def predictions(spec: NetSpec, p: np.ndarray) -> np.ndarray:
    if spec.multi:
        return np.argmax(p, axis=1).astype(np.float64)   # first index of the maximum
    return (p[:, 0] >= 0.5).astype(np.float64)


def backprop(spec: NetSpec, zs, acts, err_out, weights=None, acts_of: dict | None = None) -> list:
    """Gradient sums per layer: [1, a_{l-1}]^T e_l, errors pushed back through
    W[1:]^T and the activation derivative."""
    _, d_act = _functions(spec, acts_of)
    ws = weights if weights is not None else spec.weights
    grads = [None] * len(ws)
    e = err_out
    for l in range(len(ws) - 1, -1, -1):
        a_prev = acts[l]
        g = np.empty_like(ws[l])
        g[0] = e.sum(axis=0)
        g[1:] = a_prev.T @ e
        grads[l] = g
        if l > 0:
            e = (e @ ws[l][1:].T) * d_act(zs[l - 1])
    return grads


class _Acc:
    def __init__(self, spec: NetSpec, with_grads: bool):
        self.grads = [np.zeros_like(w) for w in spec.weights] if with_grads else None
        self.scalars = np.zeros(N_SCALARS)


def _accumulate(spec: NetSpec, acc: _Acc, x, y, t, b, v, fns=None):
    used = t | b | v
    if not used.all():   # rows that no flag asks for cost nothing and need no label
        if not used.any():
            return
        x, y, t, b, v = x[used], y[used], t[used], b[used], v[used]
    check_labels(spec, y)
    zs, acts, z_out = forward(spec, x, acts_of=fns)
    p = output_probs(spec, z_out)
    cost = row_costs(spec, z_out, p, y)
    s = acc.scalars
    if t.any():
        s[S_TRAIN_COST] += cost[t].sum()
        s[S_TRAIN_N] += t.sum()
    if v.any():
        s[S_VAL_COST] += cost[v].sum()
        s[S_VAL_N] += v.sum()
        s[S_VAL_CORRECT] += (predictions(spec, p[v]) == y[v]).sum()
        yv = y[v]
        if not spec.multi:
            s[S_VAL_SQE] += ((yv - p[v][:, 0]) ** 2).sum()
        s[S_VAL_SUM_Y] += yv.sum()
        s[S_VAL_SUM_Y2] += (yv * yv).sum()
    if acc.grads is not None and b.any():
        s[S_BATCH_N] += b.sum()
        s[S_BATCH_COST] += cost[b].sum()
        xb, yb = x[b], y[b]
        if spec.lookahead is not None:
            zs_b, acts_b, z_b = forward(spec, xb, spec.lookahead, fns)
            e = output_error(spec, output_probs(spec, z_b), yb)
            grads = backprop(spec, zs_b, acts_b, e, spec.lookahead, fns)
        else:
            zs_b = [z[b] for z in zs]
            acts_b = [a[b] for a in acts]
            e = output_error(spec, p[b], yb)
            grads = backprop(spec, zs_b, acts_b, e, acts_of=fns)
        for ga, g in zip(acc.grads, grads):
            ga += g


def _emit_blocks(spec: NetSpec, acc: "_Acc"):
    parts = [acc.scalars]
    if acc.grads is not None and acc.scalars[S_BATCH_N] > 0:
        flat = np.concatenate([g.ravel() for g in acc.grads])
        nb = -(-len(flat) // BLOCK)
        mat = np.zeros((nb + 1, BLOCK))
        mat[0, :N_SCALARS] = acc.scalars
        mat[1:].ravel()[:len(flat)] = flat
        ids = np.arange(-1, nb, dtype=np.int32)
    else:
        mat = np.zeros((1, BLOCK))
        mat[0, :N_SCALARS] = parts[0]
        ids = np.array([-1], dtype=np.int32)
    cols = [pa.array(np.full(len(ids), spec.model_id, dtype=object), pa.string()), pa.array(ids)]
    cols += [pa.array(np.ascontiguousarray(mat[:, i])) for i in range(BLOCK)]
    return pa.RecordBatch.from_arrays(cols, names=["model_id", "block"] + BLOCK_COLS)


MERGED_VALUES = 500_000   # doubles of a piece: features and units of all layers (4 MB each way)


def merged(batches, units: int = 0, values: int = MERGED_VALUES):
    """The non-empty batches of a task, small ones joined and large ones cut:
    NumPy products of about ``values`` doubles (features and ``units`` a row),
    whatever the session's batch size and the size of the task's input."""
    held, size = [], 0
    for rb in batches:
        if not rb.num_rows:
            continue
        each = -(-len(rb.column("features").flatten()) // rb.num_rows) + units
        most = max(1, values // max(1, each))
        for at in range(0, rb.num_rows, most):
            held.append(rb.slice(at, most))
            size += held[-1].num_rows * each
            if size >= values:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def sums_kernel(batches, specs, n_features: int, with_grads: bool = True, layout: str = "keyed",
                draw: tuple | None = None, acts: dict | None = None):
    """mapInArrow body: partial sums of one task (all models), emitted once.

    Input columns: features, label, and the row flags _t (train cost),
    _b (mini-batch gradient) and _v (validation metrics). ``layout`` is
    "keyed" (one row per weight) or "blocks" (see BLOCK). ``draw`` =
    (fraction, seed, epoch) keeps only the _b rows whose key column _k draws
    below the fraction (the mini-batch, drawn here so that the Spark plan is
    the same in every epoch)."""
    accs = None
    for rb in merged(batches, max(sum(w.shape[1] for w in s.weights) for s in specs)):
        n = rb.num_rows
        if accs is None:
            accs = [_Acc(s, with_grads) for s in specs]
        x = features_matrix(rb, n_features)
        y = rb.column("label").to_numpy(zero_copy_only=False).astype(np.float64)   # null becomes NaN
        t, b, v = _bool(rb, "_t", n), _bool(rb, "_b", n), _bool(rb, "_v", n)
        if draw is not None:
            from plexnet.functions.random import np_mix_uniform
            frac, seed, epoch = draw
            keys = rb.column("_k").to_numpy(zero_copy_only=False)
            b = b & (np_mix_uniform(keys, seed, epoch) < frac)
        for spec, acc in zip(specs, accs):
            _accumulate(spec, acc, x, y, t, b, v, acts)
    if accs is None:
        return
    if layout == "blocks":
        for spec, acc in zip(specs, accs):
            yield _emit_blocks(spec, acc)
        return
    for spec, acc in zip(specs, accs):
        parts_l, parts_r, parts_c, parts_v = [], [], [], []
        if acc.grads is not None and acc.scalars[S_BATCH_N] > 0:
            li, ri, ci = spec.index_arrays()
            parts_l.append(li)
            parts_r.append(ri)
            parts_c.append(ci)
            parts_v.append(np.concatenate([g.ravel() for g in acc.grads]))
        parts_l.append(np.full(N_SCALARS, -1, dtype=np.int32))
        parts_r.append(np.arange(N_SCALARS, dtype=np.int32))
        parts_c.append(np.zeros(N_SCALARS, dtype=np.int32))
        parts_v.append(acc.scalars)
        vals = np.concatenate(parts_v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(vals), spec.model_id, dtype=object), pa.string()),
             pa.array(np.concatenate(parts_l)), pa.array(np.concatenate(parts_r)),
             pa.array(np.concatenate(parts_c)), pa.array(vals)],
            names=["model_id", "layer", "row", "col", "value"])


def score_kernel(batches, specs, n_features: int, what: str = "p", acts: dict | None = None):
    """mapInArrow body for scoring: (id, model_id, p ARRAY<DOUBLE>, kept
    columns) per row and model; the input holds features, the id and the
    kept columns in this order. ``what='z1'`` returns the first layer's pre-activations."""
    for rb in batches:
        n = rb.num_rows
        if n == 0:
            continue
        x = features_matrix(rb, n_features)
        names = rb.schema.names
        for spec in specs:
            if what == "z1":
                w = spec.weights[0]
                out = x @ w[1:] + w[0]
            else:
                _, _, z_out = forward(spec, x, acts_of=acts)
                out = output_probs(spec, z_out)
            k = out.shape[1]
            offsets = pa.array(np.arange(0, n * k + 1, k, dtype=np.int32))
            p = pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays(
                [rb.column(1), pa.array(np.full(n, spec.model_id, dtype=object), pa.string()), p,
                 *(rb.column(i) for i in range(2, len(names)))],
                names=[names[1], "model_id", "p", *names[2:]])

"""The batch kernel against an independent per-row trainer written from the
formulas (loops, one example at a time, as the reference computes)."""

import math

import numpy as np
import pyarrow as pa
import pytest

from plexnet.functions import activations as A
from plexnet.operators import kernel as K

ACTS = {
    "sigmoid": (lambda z: 1 / (1 + math.exp(-z)), lambda z: (1 / (1 + math.exp(-z))) * (1 - 1 / (1 + math.exp(-z)))),
    "tanh": (math.tanh, lambda z: 1 - math.tanh(z) ** 2),
    "ReLU": (lambda z: max(0.0, z), lambda z: 1.0 if z >= 0 else 0.0),
    "LReLU": (lambda z: z if z >= 0 else 0.01 * z, lambda z: 1.0 if z >= 0 else 0.01),
    "ELU": (lambda z: z if z >= 0 else 0.05 * (math.exp(z) - 1),
            lambda z: 1.0 if z >= 0 else 0.05 * (math.exp(z) - 1) + 0.05),
}


def per_row(weights, x, y, act, multi):
    """Cost and gradient sums by explicit loops over rows, units, weights."""
    f, df = ACTS[act]
    grads = [np.zeros_like(w) for w in weights]
    cost = 0.0
    for xi, yi in zip(x, y):
        a = [1.0] + list(xi)
        A_, Z_ = [a], []
        for w in weights[:-1]:
            z = [sum(a[r] * w[r][c] for r in range(len(a))) for c in range(w.shape[1])]
            Z_.append(z)
            a = [1.0] + [f(v) for v in z]
            A_.append(a)
        w = weights[-1]
        zo = [sum(a[r] * w[r][c] for r in range(len(a))) for c in range(w.shape[1])]
        if multi:
            m = max(zo)
            e = [math.exp(v - m) for v in zo]
            s = sum(e)
            p = [v / s for v in e]
            cost += -math.log(p[int(yi)])
            err = list(p)
            err[int(yi)] -= 1
        else:
            p = [1 / (1 + math.exp(-zo[0]))]
            pc = min(max(p[0], 1e-14), 1 - 1e-14)
            cost += -(yi * math.log(pc) + (1 - yi) * math.log(1 - pc))
            err = [p[0] - yi]
        for l in range(len(weights) - 1, -1, -1):
            a = A_[l]
            for r in range(len(a)):
                for c in range(len(err)):
                    grads[l][r][c] += a[r] * err[c]
            if l > 0:
                w = weights[l]
                err = [sum(w[j + 1][k] * err[k] for k in range(len(err))) * df(Z_[l - 1][j])
                       for j in range(w.shape[0] - 1)]
    return cost, grads


def _batch(x, y):
    n, f = x.shape
    feats = pa.ListArray.from_arrays(pa.array(np.arange(0, n * f + 1, f, dtype=np.int32)),
                                     pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays(
        [feats, pa.array(y), pa.array(np.ones(n, bool)), pa.array(np.ones(n, bool)),
         pa.array(np.zeros(n, bool))], names=["features", "label", "_t", "_b", "_v"])


@pytest.mark.parametrize("act", sorted(ACTS))
@pytest.mark.parametrize("multi", [False, True])
def test_kernel_equals_per_row(act, multi):
    rng = np.random.default_rng(7)
    sizes = [3, 5, 4, 3 if multi else 1]
    weights = [rng.normal(0, 0.7, (sizes[i] + 1, sizes[i + 1])) for i in range(len(sizes) - 1)]
    x = rng.normal(0, 1, (23, 3))
    y = rng.integers(0, 3, 23).astype(float) if multi else rng.integers(0, 2, 23).astype(float)
    spec = K.NetSpec("m", weights, act, multi)
    out = list(K.sums_kernel(iter([_batch(x[:10], y[:10]), _batch(x[10:], y[10:])]), [spec], 3))
    tab = pa.Table.from_batches(out).to_pandas()
    cost, grads = per_row(weights, x, y, act, multi)
    sc = tab[tab.layer == -1].set_index("row")["value"]
    assert sc[K.S_TRAIN_COST] == pytest.approx(cost, rel=1e-10)
    assert sc[K.S_TRAIN_N] == 23 and sc[K.S_BATCH_N] == 23
    g = tab[tab.layer >= 0]
    for r in g.itertuples():
        assert r.value == pytest.approx(grads[r.layer][r.row][r.col], rel=1e-9, abs=1e-12)


def test_ragged_batch_raises():
    feats = pa.array([[1.0, 2.0], [3.0]], pa.list_(pa.float64()))
    rb = pa.RecordBatch.from_arrays([feats, pa.array([0.0, 1.0])], names=["features", "label"])
    with pytest.raises(ValueError, match="ragged"):
        K.features_matrix(rb, 2)


def test_features_matrix_respects_slices():
    x = np.arange(12, dtype=float).reshape(6, 2)
    rb = _batch(x, np.zeros(6)).slice(2, 3)
    assert np.array_equal(K.features_matrix(rb, 2), x[2:5])


def test_multi_prediction_ties_first_index():
    spec = K.NetSpec("m", [np.zeros((2, 3))], "sigmoid", True)
    assert K.predictions(spec, np.array([[0.4, 0.4, 0.2]]))[0] == 0.0


def test_log_softmax_matches_log_of_softmax():
    z = np.array([[1.0, 2.0, 3.0], [-700.0, 0.0, 700.0]])
    assert np.allclose(A.np_log_softmax(z)[0], np.log(A.np_softmax(z)[0]))
    assert np.isfinite(A.np_log_softmax(z)).all()


def test_block_layout_equals_keyed_layout():
    rng = np.random.default_rng(3)
    sizes = [3, 40, 7, 2]          # 160 + 287 + 16 weights: several blocks, last one padded
    weights = [rng.normal(0, 0.5, (sizes[i] + 1, sizes[i + 1])) for i in range(3)]
    x = rng.normal(0, 1, (50, 3))
    y = rng.integers(0, 2, 50).astype(float)
    spec = K.NetSpec("m", weights, "tanh", True)
    keyed = pa.Table.from_batches(list(K.sums_kernel(iter([_batch(x, y)]), [spec], 3))).to_pandas()
    blocks = pa.Table.from_batches(
        list(K.sums_kernel(iter([_batch(x, y)]), [spec], 3, layout="blocks"))).to_pandas()
    from plexnet.plans.fit import NetState, grads_from_blocks
    st = {"m": NetState(weights, [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights])}
    grads, sc = grads_from_blocks(blocks, st)
    for r in keyed[keyed.layer >= 0].itertuples():
        assert grads["m"][r.layer][r.row, r.col] == r.value
    ks = keyed[keyed.layer == -1].set_index("row")["value"]
    assert list(sc.loc["m"].values) == list(ks.sort_index().values)

"""Activation functions: one registry holding a Spark Column builder and a
NumPy twin for every function and its derivative.

The Column builders are plain built-in expressions (they stay inside
whole-stage codegen); the NumPy twins run inside the Arrow batch kernel of
the training pass, one matrix per batch.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from typing import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results)
#   leaky ReLU slope for z < 0 ........ 0.01
#   ELU alpha for z < 0 ............... 0.05
#   probability clip (written 10e-15) . 1e-14, i.e. p in [1e-14, 1 - 1e-14]
#   derivative of the ReLU family at z = 0 is the z >= 0 branch (1.0)
# ---------------------------------------------------------------------------
LRELU_SLOPE = 0.01
ELU_ALPHA = 0.05
PROB_EPS = 1e-14


def _lit(x: float) -> Column:
    return F.lit(float(x))


# --- Column builders -------------------------------------------------------

def sigmoid(z: Column) -> Column:
    return _lit(1.0) / (_lit(1.0) + F.exp(-z))


def d_sigmoid(z: Column) -> Column:
    s = sigmoid(z)
    return s * (_lit(1.0) - s)


def tanh(z: Column) -> Column:
    return F.tanh(z)


def d_tanh(z: Column) -> Column:
    return _lit(1.0) - F.pow(F.tanh(z), 2)


def relu(z: Column) -> Column:
    return F.when(z >= 0, z).otherwise(_lit(0.0))


def d_relu(z: Column) -> Column:
    return F.when(z >= 0, _lit(1.0)).otherwise(_lit(0.0))


def lrelu(z: Column) -> Column:
    return F.when(z >= 0, z).otherwise(_lit(LRELU_SLOPE) * z)


def d_lrelu(z: Column) -> Column:
    return F.when(z >= 0, _lit(1.0)).otherwise(_lit(LRELU_SLOPE))


def elu(z: Column) -> Column:
    return F.when(z >= 0, z).otherwise(_lit(ELU_ALPHA) * (F.exp(z) - 1.0))


def d_elu(z: Column) -> Column:
    return F.when(z >= 0, _lit(1.0)).otherwise(
        _lit(ELU_ALPHA) * (F.exp(z) - 1.0) + _lit(ELU_ALPHA))


def clip_prob(p: Column) -> Column:
    return F.greatest(F.least(p, _lit(1.0 - PROB_EPS)), _lit(PROB_EPS))


def softmax(z: Column) -> Column:
    """Softmax of an ARRAY<DOUBLE> column, shifted by its maximum (same value
    as the unshifted form wherever that one is finite)."""
    shifted = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    total = F.aggregate(shifted, _lit(0.0), lambda acc, x: acc + x)
    return F.transform(shifted, lambda x: x / total)


# --- NumPy twins -------------------------------------------------------------

def np_sigmoid(z: np.ndarray) -> np.ndarray:
    # piecewise form: no overflow warning for large |z|
    out = np.empty_like(z, dtype=np.float64)
    pos = z >= 0
    out[pos] = 1.0 / (1.0 + np.exp(-z[pos]))
    ez = np.exp(z[~pos])
    out[~pos] = ez / (1.0 + ez)
    return out


def np_d_sigmoid(z: np.ndarray) -> np.ndarray:
    s = np_sigmoid(z)
    return s * (1.0 - s)


def np_tanh(z: np.ndarray) -> np.ndarray:
    return np.tanh(z)


def np_d_tanh(z: np.ndarray) -> np.ndarray:
    return 1.0 - np.tanh(z) ** 2


def np_relu(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, z, 0.0)


def np_d_relu(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 1.0, 0.0)


def np_lrelu(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, z, LRELU_SLOPE * z)


def np_d_lrelu(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 1.0, LRELU_SLOPE)


def np_elu(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, z, ELU_ALPHA * np.expm1(np.minimum(z, 0.0)))


def np_d_elu(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 1.0, ELU_ALPHA * np.expm1(np.minimum(z, 0.0)) + ELU_ALPHA)


def np_dd_sigmoid(z: np.ndarray) -> np.ndarray:
    s = np_sigmoid(z)
    return s * (1.0 - s) * (1.0 - 2.0 * s)


def np_dd_tanh(z: np.ndarray) -> np.ndarray:
    t = np.tanh(z)
    return -2.0 * t * (1.0 - t * t)


def np_dd_elu(z: np.ndarray) -> np.ndarray:
    return np.where(z >= 0, 0.0, ELU_ALPHA * np.exp(np.minimum(z, 0.0)))


def np_clip_prob(p: np.ndarray) -> np.ndarray:
    return np.clip(p, PROB_EPS, 1.0 - PROB_EPS)


def np_softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def np_log_softmax(z: np.ndarray) -> np.ndarray:
    m = z.max(axis=1, keepdims=True)
    return z - m - np.log(np.exp(z - m).sum(axis=1, keepdims=True))


# --- registry -----------------------------------------------------------------

@dataclass(frozen=True)
class Activation:
    name: str
    column: Callable[[Column], Column]
    d_column: Callable[[Column], Column]
    numpy: Callable[[np.ndarray], np.ndarray]
    d_numpy: Callable[[np.ndarray], np.ndarray]
    dd_numpy: Callable[[np.ndarray], np.ndarray] | None = None


_REGISTRY: dict[str, Activation] = {}


def register_activation(name: str, column_fn, numpy_fn, d_column_fn, d_numpy_fn, dd_numpy_fn=None) -> None:
    """The extension point: add an activation usable by every operator (the
    second derivative is for Hessian products only).
    The NumPy twins travel to the executors with each pass; functions of a
    module outside this package are shipped by value."""
    for fn in filter(None, (numpy_fn, d_numpy_fn, dd_numpy_fn)):
        module = sys.modules.get(getattr(fn, "__module__", None) or "")
        if module is not None and module.__name__ != "__main__" and module.__name__.split(".")[0] not in ("plexnet", "numpy"):
            cloudpickle.register_pickle_by_value(module)
    _REGISTRY[name] = Activation(name, column_fn, d_column_fn, numpy_fn, d_numpy_fn, dd_numpy_fn)


# names accepted by the reference settings, plus the plain "tanh"
register_activation("sigmoid", sigmoid, np_sigmoid, d_sigmoid, np_d_sigmoid, np_dd_sigmoid)
register_activation("tanh", tanh, np_tanh, d_tanh, np_d_tanh, np_dd_tanh)
register_activation("ReLU", relu, np_relu, d_relu, np_d_relu, np.zeros_like)
register_activation("LReLU", lrelu, np_lrelu, d_lrelu, np_d_lrelu, np.zeros_like)
register_activation("ELU", elu, np_elu, d_elu, np_d_elu, np_dd_elu)


def get_activation(name: str) -> Activation:
    try:
        return _REGISTRY[name]
    except KeyError:
        raise ValueError(f"unknown activation {name!r}; known: {sorted(_REGISTRY)}") from None


def activation_names() -> list[str]:
    return sorted(_REGISTRY)


def apply_activation(df, col: str, name: str, derivative: bool = False, out: str | None = None):
    """Apply a registered activation (or its derivative) to a DOUBLE column or
    to every element of an ARRAY<DOUBLE> column."""
    act = get_activation(name)
    fn = act.d_column if derivative else act.column
    c = F.col(col)
    dtype = dict(df.dtypes)[col]
    expr = F.transform(c, fn) if dtype.startswith("array") else fn(c)
    return df.withColumn(out or col, expr)

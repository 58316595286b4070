"""Activation functions: Column builders against their NumPy twins on the
hand-made extremes of FIXTURES.md (z of +-0, +-40, +-800)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexnet.functions import activations as A

EXTREMES = [0.0, -0.0, 40.0, -40.0, 800.0, -800.0, 0.5, -0.5, 3.0]


@pytest.mark.parametrize("name", A.activation_names())
@pytest.mark.parametrize("derivative", [False, True])
def test_column_equals_numpy(spark, name, derivative):
    act = A.get_activation(name)
    df = spark.createDataFrame([(z,) for z in EXTREMES], "z double")
    fn = act.d_column if derivative else act.column
    got = [r[0] for r in df.select(fn(F.col("z"))).collect()]
    want = (act.d_numpy if derivative else act.numpy)(np.array(EXTREMES))
    for g, w, z in zip(got, want, EXTREMES):
        assert g is not None and math.isfinite(g), (name, z, g)
        assert g == pytest.approx(w, rel=1e-12, abs=1e-300), (name, derivative, z)


def test_relu_family_derivative_is_one_at_zero():
    for name in ("ReLU", "LReLU", "ELU"):
        d = A.get_activation(name).d_numpy(np.array([0.0, -0.0]))
        assert list(d) == [1.0, 1.0], name


def test_stable_tanh_and_sigmoid_at_800():
    assert A.np_tanh(np.array([800.0]))[0] == 1.0
    assert A.np_sigmoid(np.array([-800.0]))[0] == 0.0
    assert A.np_sigmoid(np.array([800.0]))[0] == 1.0


def test_clip_prob_bounds(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.3,)], "p double")
    got = [r[0] for r in df.select(A.clip_prob(F.col("p"))).collect()]
    assert got == [1e-14, 1.0 - 1e-14, 0.3]


def test_softmax_ties_and_shift(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, 0.0],)], "z array<double>")
    p = df.select(A.softmax(F.col("z"))).first()[0]
    assert p[0] == pytest.approx(0.5) and p[1] == pytest.approx(0.5)
    npp = A.np_softmax(np.array([[1000.0, 1000.0, 0.0]]))[0]
    assert np.argmax(npp) == 0          # ties: first index wins


def test_unknown_activation_raises():
    with pytest.raises(ValueError):
        A.get_activation("swish")


def test_register_activation(spark):
    A.register_activation("identity", lambda z: z, lambda z: z,
                          lambda z: F.lit(1.0) + z * 0, lambda z: np.ones_like(z))
    assert "identity" in A.activation_names()

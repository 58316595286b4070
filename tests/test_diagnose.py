"""Gradient check per activation and the small
hand-made inputs of FIXTURES part 3 that are not covered elsewhere."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from plexnet.operators import params as P
from plexnet.operators.diagnose import gradient_check
from plexnet.plans.fit import NetState, numpy_step
from plexnet.plans.grid import single_model
from plexnet.sources.libsvm import read_libsvm
from plexnet.sources.tables import fixture


@pytest.mark.parametrize("act", ["sigmoid", "tanh", "ReLU", "LReLU", "ELU"])
@pytest.mark.parametrize("outputs", [1, 3])
def test_gradient_check_per_activation(spark, act, outputs):
    name = "L" if outputs == 1 else "LM"
    ex = fixture(spark, SF_SMALL, name)
    m = single_model(spark, "g", hidden="4,4", activation=act, outputs=outputs, seed=754,
                     init="deeplearning", fan="fan_in")
    g = gradient_check(ex, P.init_params(m, 4), m, n_examples=5, eps=1e-5).toPandas()
    assert len(g) == (5 * 4 + 5 * 4 + 5 * outputs)
    # kinks of the ReLU family can sit inside +-eps: judge by the bulk of the weights
    q = 0.9 if act in ("ReLU", "LReLU", "ELU") else 1.0
    assert g.rel_error.quantile(q) < 1e-5, g.sort_values("rel_error").tail(3)


def test_libsvm3_fills_missing_indices(spark, tmp_path):
    d = tmp_path / "svm"
    d.mkdir()
    (d / "train.txt").write_text("1 1:0.5 3:2.0\n0 2:1.5\n1 4:-1.0\n")
    ex = read_libsvm(spark, str(d), num_features=5, split="train").orderBy("label", "id").toPandas()
    assert all(len(f) == 5 for f in ex.features)
    rows = sorted(tuple(f) for f in ex.features)
    assert (0.0, 1.5, 0.0, 0.0, 0.0) in rows and (0.5, 0.0, 2.0, 0.0, 0.0) in rows
    assert set(ex.split) == {"train"}


def test_zero_gradient_leaves_weights(spark):
    """FIXTURES part 3 'zero_grad': zero weights and inputs, adaptive rate."""
    w = [np.zeros((3, 2)), np.zeros((3, 1))]
    st = NetState([a.copy() for a in w], [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w])
    cfg = {"lmbda": 0.0, "rate": 0.1, "optimizer": "vanilla", "learning_mod": "ADA"}
    new = numpy_step(st, [np.zeros_like(a) for a in w], 10.0, 10.0, cfg, 0.5)
    assert all(np.array_equal(a, b) for a, b in zip(new.theta, w))
    assert all(np.isfinite(a).all() for a in new.theta)


def test_split_is_independent_of_partitions(spark):
    L = fixture(spark, SF_SMALL, "L")
    a = L.repartition(1).select("id", "split").toPandas().sort_values("id")
    b = L.repartition(7).select("id", "split").toPandas().sort_values("id")
    assert a.split.tolist() == b.split.tolist()
    share = (a.split == "val").mean()
    assert 0.17 < share < 0.23


def test_numpy_batch_draw_equals_spark_draw(spark):
    from plexnet.functions.random import mix_uniform, np_mix_uniform
    from plexnet.operators.examples import batch_key
    L = fixture(spark, SF_SMALL, "L").withColumn("k", batch_key(2332))
    for epoch in (0, 7, 123):
        pdf = L.select("k", mix_uniform("k", 2332, epoch).alias("u"),
                       mix_uniform(F.col("k"), 2332, epoch).alias("u2")).toPandas()
        assert (pdf.u == pdf.u2).all()
        assert np.array_equal(np_mix_uniform(pdf.k.to_numpy(), 2332, epoch), pdf.u.to_numpy())

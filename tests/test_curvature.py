"""Exact Hessian products against differences of gradients, the gradient check over all rows, and online draws."""

import pytest
from conftest import SF_SMALL

from plexnet.operators import curvature as C
from plexnet.operators import examples as E
from plexnet.operators import params as P
from plexnet.operators import passes as PS
from plexnet.plans.grid import models_from_rows
from plexnet.sources.tables import fixture
from pyspark.sql import functions as F

BASE = dict(init="xnormal", fan="fan_in", seed=5, rate=0.1, lmbda=0.03, optimizer="momentum", learning_mod="", maxmu=0.95, itert=1.0)


def nets(spark, *rows):
    m = models_from_rows(spark, [dict(model_id=i, hidden=h, outputs=o, activation=a, loss=loss, **BASE) for i, h, o, a, loss in rows])
    return m, P.init_params(m, 4)


def small(spark, name, n=300):
    df = fixture(spark, SF_SMALL, name).limit(n)
    return spark.createDataFrame(df.collect(), df.schema).repartition(3)


def vector(df, col):
    return {(r.model_id, r.layer, r.row, r.col): r[col] for r in df.collect()}


@pytest.mark.parametrize("name,outputs,loss", [("L", 1, "log"), ("L", 1, "squared"), ("LM", 3, "log")])
def test_hessian_vector_against_differences(spark, name, outputs, loss):
    ex = small(spark, name)
    m, p = nets(spark, *((a, "5,3", outputs, a, loss) for a in ("sigmoid", "tanh", "ELU", "LReLU")))
    v = p.select(*P.KEYS, (F.pmod(F.xxhash64(*P.KEYS), F.lit(1000)) / 1000.0 - 0.5).alias("value"))
    got = vector(C.hessian_vector(ex, p, m, v), "hv")
    n, eps, direction, theta = 300, 1e-6, vector(v, "value"), vector(p, "theta")

    def gradient(sign):
        moved = p.join(v, P.KEYS).select(*P.KEYS, (F.col("theta") + sign * eps * F.col("value")).alias("theta"), "velocity", "gacc")
        return vector(PS.gradient_sums(ex, moved, m).where("layer >= 0"), "value")
    plus, minus = gradient(1), gradient(-1)
    assert got.keys() == theta.keys()
    for k in got:
        want = (plus[k] - minus[k]) / (2 * eps) / n + (0.03 * direction[k] if k[2] else 0)
        assert got[k] == pytest.approx(want, abs=2e-6), k


def test_absent_weights_have_direction_zero(spark):
    ex = small(spark, "L", 50)
    m, p = nets(spark, ("a", "3", 1, "tanh", "log"))
    one = p.where("layer = 0 AND row = 1 AND col = 2").select(*P.KEYS, F.lit(2.0).alias("value"))
    whole = p.select(*P.KEYS, F.when((F.col("layer") == 0) & (F.col("row") == 1) & (F.col("col") == 2), 2.0).otherwise(0.0).alias("value"))
    a, b = (vector(C.hessian_vector(ex, p, m, v), "hv") for v in (one, whole))
    assert a == b and any(a.values())
    assert C.hessian_vector(ex.limit(0), p, m, one).count() == 0


def test_no_second_derivative_raises(spark):
    from plexnet.functions import activations as A
    A.register_activation("cube", lambda z: z * z * z, lambda z: z ** 3, lambda z: z * z * 3.0, lambda z: 3 * z ** 2)
    m, p = nets(spark, ("a", "3", 1, "cube", "log"))
    with pytest.raises(ValueError, match="second derivative"):
        C.hessian_vector(small(spark, "L", 20), p, m, p.select(*P.KEYS, F.lit(1.0).alias("value")))
    del A._REGISTRY["cube"]


@pytest.mark.parametrize("held", [4_000_000, 50])
def test_every_weight_is_checked_over_all_rows(spark, monkeypatch, held):
    monkeypatch.setattr(C, "HELD_VALUES", held)  # variants come in pieces
    for name, outputs, loss in (("L", 1, "log"), ("L", 1, "squared"), ("LM", 3, "log")):
        ex = small(spark, name, 120)
        m, p = nets(spark, ("a", "4,3", outputs, "sigmoid", loss), ("b", "2,2", outputs, "tanh", loss))
        got = C.check_gradients(ex, p, m, eps=1e-5, rows_at_once=50).toPandas()
        assert len(got) == p.count() and got.rel_error.max() < 1e-5
        sums = vector(PS.gradient_sums(ex, p, m).where("layer >= 0"), "value")
        for r in got.itertuples():
            assert r.analytic == pytest.approx(sums[r.model_id, r.layer, r.row, r.col] / 120, abs=1e-12)
    assert C.check_gradients(ex.limit(0), p, m).count() == 0


def test_a_wrong_gradient_is_found(spark, monkeypatch):
    """Errors of opposite sign do not cancel: every weight is judged by itself."""
    ex = small(spark, "L", 60)
    m, p = nets(spark, ("a", "3", 1, "tanh", "log"))
    sums = vector(C.check_gradients(ex, p, m, eps=1e-5), "analytic")
    numeric = vector(C.check_gradients(ex, p, m, eps=1e-5), "numeric")
    wrong = dict(sums)
    a, b = [k for k in sums if k[1] == 0][:2]
    wrong[a], wrong[b] = sums[a] + 0.01, sums[b] - 0.01
    assert abs(sum(wrong.values()) - sum(numeric.values())) < 1e-6  # the sum hides it
    assert max(abs(wrong[k] - numeric[k]) for k in wrong) > 0.009


def test_online_draws_of_all_epochs_in_one_scan(spark):
    ex = E.cache_examples(fixture(spark, SF_SMALL, "L").limit(400).repartition(5), batch_seed=2332)
    got = {r.epoch: r.id for r in E.online_picks(ex, range(3, 9), 2332).collect()}
    assert got == {e: E.online_pick(ex, e, 2332, key="bkey").first()["id"] for e in range(3, 9)}
    assert E.online_picks(ex.where("split = 'none'"), range(3), 2332).count() == 0
    ex.unpersist()

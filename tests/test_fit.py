"""Training loop invariants and behaviour."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from plexnet.operators import params as P
from plexnet.plans.fit import fit
from plexnet.plans.grid import model_grid, models_from_rows, single_model
from plexnet.sources.tables import fixture


def _p(res):
    return res.params.toPandas().sort_values(["model_id", "layer", "row", "col"]).reset_index(drop=True)


def _h(res):
    return res.history.toPandas().sort_values(["model_id", "epoch"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def L(spark):
    return fixture(spark, SF_SMALL, "L")


def test_same_result_for_1_3_8_partitions(spark, L):
    m = single_model(spark, "a", hidden="4", rate=0.5, epochs=3)
    outs = [_p(fit(L.repartition(n), m)) for n in (1, 3, 8)]
    for o in outs[1:]:
        assert np.allclose(o[["theta", "velocity", "gacc"]].values,
                           outs[0][["theta", "velocity", "gacc"]].values, rtol=1e-10, atol=1e-12)


def test_grid_equals_single_runs(spark, L):
    grid = model_grid(spark, "4-3,3", "0.5,0.1", epochs=3, optimizer="nesterov")
    g = _p(fit(L, grid))
    for mid in ("4@0.5", "3,3@0.1"):
        topo, rate = mid.split("@")
        one = model_grid(spark, topo, rate, epochs=3, optimizer="nesterov")
        s = _p(fit(L, one))
        gg = g[g.model_id == mid].reset_index(drop=True)
        assert np.allclose(gg[["theta", "velocity"]].values, s[["theta", "velocity"]].values,
                           rtol=1e-10, atol=1e-12)


def test_fused_equals_unfused_and_dataframe_step(spark, L):
    m = models_from_rows(spark, [
        dict(model_id="v", hidden="4", optimizer="vanilla", rate=0.3, epochs=3, lmbda=0.01),
        dict(model_id="m", hidden="4,3", optimizer="momentum", learning_mod="ADA", rate=0.3, epochs=3),
        dict(model_id="n", hidden="4", optimizer="nesterov", activation="tanh", epochs=3)])
    a = fit(L, m)
    b = fit(L, m, fuse=False)
    c = fit(L, m, step="dataframe")
    for other in (b, c):
        assert np.allclose(_h(a)[["cost_train", "cost_val", "acc_val"]].values,
                           _h(other)[["cost_train", "cost_val", "acc_val"]].values, rtol=1e-9)
        assert np.allclose(_p(a)[["theta", "velocity", "gacc"]].values,
                           _p(other)[["theta", "velocity", "gacc"]].values, rtol=1e-9, atol=1e-12)


def test_learns_on_documents(spark):
    D = fixture(spark, SF_MID, "D")
    m = single_model(spark, "d", hidden="8", rate=0.5, epochs=30)
    h = _h(fit(D, m, full_batch=True))
    assert h.cost_val.iloc[-1] < h.cost_val.iloc[0]


def test_best_epoch_and_best_params(spark, L):
    m = single_model(spark, "b", hidden="4", rate=2.0, epochs=6)
    r = fit(L, m)
    h = _h(r)
    best = h.cost_val.min()
    s = r.summary.first()
    assert s["best_cost"] == pytest.approx(best)
    last_best = h[h.cost_val == best].epoch.max() + 1
    assert s["best_epoch"] == last_best
    assert r.best_params.count() == r.params.count()


def test_empty_batch_skips_update(spark, L):
    m = single_model(spark, "e", hidden="3", epochs=2, batch_size=0)
    r = fit(L, m)
    p0 = P.init_params(m, 4).toPandas().sort_values(["model_id", "layer", "row", "col"])
    assert np.allclose(_p(r)["theta"].values, p0["theta"].values)
    assert not _h(r)[["cost_train", "cost_val"]].isna().any().any()


def test_label_out_of_range_raises(spark):
    LM = fixture(spark, SF_SMALL, "LM")
    with pytest.raises(ValueError, match="bad examples"):
        fit(LM, single_model(spark, "x", hidden="3", outputs=2, epochs=1))


def test_ragged_features_raise(spark, L):
    bad = L.withColumn("features", F.when(F.col("split") == "val", F.slice("features", 1, 3))
                       .otherwise(F.col("features")))
    with pytest.raises(ValueError, match="width"):
        fit(bad, single_model(spark, "x", hidden="3", epochs=1))


def test_unknown_setting_raises(spark):
    with pytest.raises(ValueError):
        single_model(spark, "x", optimiser="adam")
    with pytest.raises(ValueError):
        single_model(spark, "x", optimizer="adam")


def test_checkpoint_and_resume(spark, L, tmp_path):
    m = single_model(spark, "c", hidden="4", rate=0.5, epochs=4)
    full = fit(L, m)
    run = str(tmp_path / "run")
    m2 = single_model(spark, "c", hidden="4", rate=0.5, epochs=2)
    fit(L, m2, checkpoint_every=1, run_dir=run)
    resumed = fit(L, m, resume_from=run)
    assert np.allclose(_p(full)[["theta", "velocity"]].values, _p(resumed)[["theta", "velocity"]].values,
                       rtol=1e-10, atol=1e-12)


def test_online_mode_runs(spark, L):
    m = single_model(spark, "o", hidden="3", epochs=2, gradient="olGD")
    h = _h(fit(L, m))
    assert len(h) == 2 and h.cost_train.notna().all()


def test_xor_needs_hidden_layer(spark):
    """FIXTURES part 3 'xor': cost falls with a hidden layer."""
    rows = [(i, [float(a), float(b)], float(a ^ b), "train") for i, (a, b) in
            enumerate([(0, 0), (0, 1), (1, 0), (1, 1)] * 8)]
    ex = spark.createDataFrame(pd.DataFrame(rows, columns=["id", "features", "label", "split"]))
    ex = ex.unionByName(ex.withColumn("split", F.lit("val")).withColumn("id", F.col("id") + 100))
    m = single_model(spark, "x", hidden="6", activation="tanh", rate=0.5, epochs=60, init="xuniform")
    h = _h(fit(ex, m, full_batch=True))
    assert h.cost_val.iloc[-1] < h.cost_val.iloc[0] * 0.8


def test_grid_over_broadcast_bound_is_split(spark, L, monkeypatch):
    from plexnet.operators import passes
    m = model_grid(spark, "4-3,3", "0.5", epochs=2)
    whole = _p(fit(L, m))
    monkeypatch.setattr(passes, "MAX_BROADCAST_BYTES", 8 * 40)   # one model per group
    assert len(passes.group_specs(passes.specs_from_frames(P.init_params(m, 4), m))) == 2
    split = _p(fit(L, m))
    assert np.allclose(whole[["theta", "velocity"]].values, split[["theta", "velocity"]].values,
                       rtol=1e-12, atol=1e-14)
    monkeypatch.setattr(passes, "MAX_BROADCAST_BYTES", 8)
    with pytest.raises(ValueError, match="broadcast"):
        fit(L, m)


def test_train_job_end_to_end(spark, tmp_path):
    from plexnet import train_job
    from plexnet.sources.libsvm import write_libsvm
    L = fixture(spark, SF_SMALL, "L")
    write_libsvm(L.where(F.col("split") == "train"), str(tmp_path / "Ltrain"))
    write_libsvm(L.where(F.col("split") == "val"), str(tmp_path / "Lval"))
    out = train_job(spark, str(tmp_path / "Ltrain"), str(tmp_path / "Lval"), str(tmp_path / "out"),
                    topologies="4-3,3", rates="0.5", data_name="L", num_features=4, epochs=2)
    lines = [r[0] for r in spark.read.text(out.summary_path).collect()]
    assert len(lines) == 2 and all(line.startswith("L;") and line.count(";") == 6 for line in lines)
    from plexnet.sources.weights import read_weights_text
    w = read_weights_text(spark, out.weights_path)
    assert w.count() == out.result.params.count()

"""Row identity, restart, guards and released resources of the training loop."""

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from plexnet.functions import activations as A
from plexnet.operators import examples as E
from plexnet.operators import params as P
from plexnet.operators import passes as PS
from plexnet.plans.fit import fit
from plexnet.plans.grid import model_settings, single_model
from plexnet.session import scratch_path
from plexnet.sources.libsvm import read_libsvm
from plexnet.sources.tables import fixture
from plexnet.sources.weights import read_weights_text


def lines(tmp_path, spark, n=1000):
    path = str(tmp_path / "repeated")
    body = [("1 1:0.5 2:1", "0 1:0.25", "1 2:0.75")[i % 3] for i in range(n)]
    spark.createDataFrame([(x,) for x in body], "value string").coalesce(2).write.text(path)
    return read_libsvm(spark, path, num_features=2)


def test_equal_lines_are_rows_of_their_own(spark, tmp_path):
    ex = lines(tmp_path, spark)
    assert ex.select("id").distinct().count() == 1000
    assert ex.orderBy("id").collect() == ex.orderBy("id").collect()
    n_val = ex.where("split = 'val'").count()
    assert 140 < n_val < 260
    train = 1000 - n_val
    for epoch in range(4):
        assert 60 < E.minibatch(ex, epoch, train, size=100).count() < 140
        assert E.online_example(ex, epoch).count() == 1
    m = single_model(spark, "m", hidden="3")
    scores = PS.score(ex, P.init_params(m, 2), m, keep=("label",))
    assert scores.count() == 1000 and scores.columns == ["id", "model_id", "p", "label"]


def small(spark):
    return fixture(spark, SF_SMALL, "ES")


@pytest.fixture(scope="module")
def es(spark):
    return small(spark).cache()


def rows(df, *cols):
    return sorted(tuple(r[c] if not isinstance(r[c], float) else round(r[c], 10) for c in cols) for r in df.collect())


def test_resumed_run_equals_an_uninterrupted_one(spark, es):
    run = scratch_path(spark, "resume-test")
    cfg = dict(hidden="4", rate=0.3, batch_size=100)
    whole = fit(es, single_model(spark, "m", epochs=6, **cfg))
    fit(es, single_model(spark, "m", epochs=4, **cfg), checkpoint_every=2, run_dir=run)
    half = f"{run}/params/epoch=5"  # a checkpoint that was being written when the driver stopped
    spark.read.parquet(f"{run}/params/epoch=4").where("layer = 0").write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(half)
    again = fit(es, single_model(spark, "m", epochs=6, **cfg), resume_from=run, checkpoint_every=2)
    keys = ("model_id", "layer", "row", "col", "theta", "velocity", "gacc")
    assert rows(again.params, *keys) == rows(whole.params, *keys)
    assert rows(again.best_params, *keys) == rows(whole.best_params, *keys)
    hist = ("model_id", "epoch", "cost_train", "cost_val", "acc_val")
    assert rows(again.history, *hist) == rows(whole.history, *hist)
    summary = ("model_id", "best_epoch", "best_cost", "last_epoch")
    assert rows(again.summary, *summary) == rows(whole.summary, *summary)
    with pytest.raises(ValueError, match="do not fit"):
        fit(es, single_model(spark, "m", epochs=6, hidden="5", rate=0.3, batch_size=100), resume_from=run)


def test_no_validation_rows_raise_and_nothing_stays_cached(spark, es):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    with pytest.raises(ValueError, match="no validation rows"):
        fit(es.where("split = 'train'"), single_model(spark, "m", hidden="3", epochs=1))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_broadcasts_are_released_each_epoch(spark, es):
    import os
    folder = spark.sparkContext._temp_dir
    count = lambda: sum(len(f) for _, _, f in os.walk(folder))
    before = count()
    fit(es, single_model(spark, "m", hidden="3", epochs=6))
    assert count() <= before + 1


@pytest.mark.parametrize("label", [None, float("nan"), -1.0, 0.5, 7.0])
def test_bad_labels_raise_in_every_pass(spark, es, label):
    m = single_model(spark, "m", hidden="3", outputs=3)
    p = P.init_params(m, 64)
    bad = es.limit(20).withColumn("label", F.lit(label).cast("double"))
    with pytest.raises(Exception, match="label"):
        PS.evaluate(bad, p, m).collect()
    with pytest.raises(Exception, match="label"):
        PS.gradient_sums(bad, p, m).collect()


def cube(z):
    return z * z * z


def d_cube(z):
    return 3.0 * z * z


def test_registered_activation_runs_on_executors(spark, es):
    A.register_activation("cube", cube, cube, d_cube, d_cube)
    m = single_model(spark, "m", hidden="3", activation="cube")
    p = P.init_params(m, 64)
    got = {r.id: r.p[0] for r in PS.score(es, p, m).collect()}
    spec = PS.specs_from_frames(p, m)[0]
    for r in es.limit(5).collect():
        x = np.array(r.features)
        a = (x @ spec.weights[0][1:] + spec.weights[0][0]) ** 3
        assert got[r.id] == pytest.approx(1 / (1 + np.exp(-(a @ spec.weights[1][1:] + spec.weights[1][0])[0])))
    assert PS.gradient_sums(es, p, m).count() > 0


def test_unknown_settings_raise():
    for k, v in (("learning_mod", "ada"), ("warm", "nonsense"), ("optimizer", "x")):
        with pytest.raises(ValueError):
            model_settings(**{k: v})


def test_plain_weight_files(spark, tmp_path):
    values = [str(i / 4) for i in range(13)]
    path = tmp_path / "net.txt"
    path.write_text("\n".join(["2_3_1_tanh", *values]) + "\n")
    got = read_weights_text(spark, str(path)).orderBy("layer", "row", "col").collect()
    assert [r.theta for r in got] == [float(v) for v in values] and got[0].activation == "tanh"
    assert got[0].model_id.endswith("net.txt")
    (tmp_path / "blank.txt").write_text("\n".join(["2_3_1_tanh", *values[:5], "", *values[5:12]]))
    with pytest.raises(ValueError, match="blank line"):
        read_weights_text(spark, str(tmp_path / "blank.txt"))


def test_steps_run_the_network_once(spark):
    from plexnet.plans import catalog, catalog_fit  # noqa: F401
    for key in ("mean_gradient", "clip_l1", "step_momentum", "hessian_product"):
        plan = catalog.QUERIES[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan  # the passes' sums are stored: one run of each
